"""Land cover on the cube grid: nearest lookup, first-wins mosaic, class join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import cell_x_metres, cell_y_metres, inverse_lat, inverse_lon
from gridloom.sources.workspace import cut, discard, materialize

INDEX_KEYS = ["index_level", "index_x", "index_y"]
#: Rasters of a square that a mosaic asks first, and how many times as many are asked by the next round.
ASKED_FIRST, TIMES = 32, 8


def clip_to_region(
    df: DataFrame, west: float, south: float, east: float, north: float, buffer: float = 0.25,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows within the box widened by ``buffer`` degrees; optionally only some columns."""
    inside = df.filter(
        F.col("lon").between(west - buffer, east + buffer)
        & F.col("lat").between(south - buffer, north + buffer)
    )
    return inside.select(*keep) if keep else inside


def cell_lat_lon(cells: DataFrame, rows: int = 2400, cols: int = 2400) -> DataFrame:
    """Latitude and longitude of each cell centre of a sinusoidal tile."""
    y = cell_y_metres(F.col("tile"), F.col("row"), rows)
    x = cell_x_metres(F.col("tile"), F.col("col"), cols)
    return cells.withColumns({"lat": inverse_lat(y), "lon": inverse_lon(x, y)})


def reproject_nearest(
    cells: DataFrame, tiles: DataFrame, tile_degrees: int = 3, per_tile: int = 6
) -> DataFrame:
    """Source value(s) under each cell centre, one row per covering source file.

    Tiles lie on a regular degree grid, so the position gives tile, row and
    column directly and the lookup is an equi-join. Cells no file covers keep
    a NULL value.
    """
    size = float(tile_degrees)
    lat0 = F.floor(F.col("lat") / size) * tile_degrees
    lon0 = F.floor(F.col("lon") / size) * tile_degrees
    keyed = cells.withColumns(
        {
            "tile_lat": lat0.cast("int"),
            "tile_lon": lon0.cast("int"),
            "src_row": F.least(
                F.lit(per_tile - 1),
                F.floor((lat0 + size - F.col("lat")) * (per_tile / size)).cast("int"),
            ),
            "src_col": F.least(
                F.lit(per_tile - 1), F.floor((F.col("lon") - lon0) * (per_tile / size)).cast("int")
            ),
        }
    )
    return keyed.join(tiles, ["tile_lat", "tile_lon", "src_row", "src_col"], "left")


def mosaic_first(sources: DataFrame, keys: list[str], nodata: int = 0) -> DataFrame:
    """Per cell the valid value of the first source file; ``nodata`` where there is none."""
    valid = F.when(F.col("lc") != nodata, F.col("tile_order"))
    first = F.min_by("lc", valid)
    return sources.groupBy(*keys).agg(F.coalesce(first, F.lit(nodata)).cast("smallint").alias("lc"))


def footprint_index(rasters: DataFrame, size: float = 1.0, across: int | None = None) -> DataFrame:
    """The index cells of edge ``size`` that each raster's footprint touches, one row each, with the way back to its pixels.

    A raster is a row of ``tile_order``, its affine grid ``x = ax * col + bx * row + x0``, ``y = ay * col + by * row + y0``, and
    ``n_rows``, ``n_cols``; it may be rotated, sheared, and overlap others. Index cells of the box around it that lie beside the
    footprint are left out. Rasters without area or with a NULL in their grid cover nothing.

    ``index_level`` says how often the edge was halved for a raster: 0, or, given ``across``, as often as it takes for an index
    cell to span at most that many pixels. The pixels a position in the cell may fall on are ``row_from`` to ``row_to`` and
    ``col_from`` to ``col_to``.
    """
    corners = [(i, j) for i in (F.lit(0), F.col("n_cols")) for j in (F.lit(0), F.col("n_rows"))]
    xs = [F.col("ax") * i + F.col("bx") * j + F.col("x0") for i, j in corners]
    ys = [F.col("ay") * i + F.col("by") * j + F.col("y0") for i, j in corners]
    edge = _edge(size, F.col("index_level"))

    def touched(values: list) -> Column:
        return F.sequence(F.floor(F.least(*values) / edge), F.floor(F.greatest(*values) / edge))

    boxes = _grids(rasters, size, across).select(
        "tile_order", "n_rows", "n_cols", "x0", "y0", "cx", "cy", "rx", "ry", "index_level",
        F.explode(touched(xs)).alias("index_x"), touched(ys).alias("index_y"),
    ).withColumn("index_y", F.explode("index_y"))
    ends = [((F.col("index_x") + i) * edge, (F.col("index_y") + j) * edge) for i in (0, 1) for j in (0, 1)]
    grid = {c: F.col(c) for c in ("x0", "y0", "cx", "cy", "rx", "ry")}
    cols, rows = zip(*[_pixel(grid, x, y) for x, y in ends])
    meets = [(F.greatest(*v) >= 0) & (F.least(*v) <= F.col(n)) for v, n in ((cols, "n_cols"), (rows, "n_rows"))]
    # a pixel more at either end, since ends and positions are rounded apart
    spans = {
        f"{name}_{end}": value.cast("int")
        for name, v, n in (("col", cols, F.col("n_cols")), ("row", rows, F.col("n_rows")))
        for end, value in (("from", F.greatest(F.lit(0), F.floor(F.least(*v)) - 1)), ("to", F.least(n - 1, F.floor(F.greatest(*v)) + 1)))
    }
    return boxes.where(meets[0] & meets[1]).withColumns(spans)


def _grids(rasters: DataFrame, size: float, across: int | None) -> DataFrame:
    """Rasters that cover something, with the way back to their pixels and the level of their index cells."""
    det = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    back = {"cx": F.col("by") / det, "cy": -F.col("bx") / det, "rx": -F.col("ay") / det, "ry": F.col("ax") / det}
    some = (det != 0) & (F.col("n_rows") > 0) & (F.col("n_cols") > 0) & (F.col("x0") + F.col("y0")).isNotNull()
    grids = rasters.where(some).withColumns(back)
    if across is None:
        return grids.withColumn("index_level", F.lit(0))
    spanned = size * F.greatest(F.abs("cx") + F.abs("cy"), F.abs("rx") + F.abs("ry"))
    return grids.withColumn("index_level", F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(spanned / across)))).cast("int"))


def _edge(size: float, level: Column) -> Column:
    return F.lit(float(size)) / F.pow(F.lit(2.0), level)


def _pixel(grid: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Column and row, not yet whole, of a position in a raster."""
    dx, dy = x - grid["x0"], y - grid["y0"]
    return grid["cx"] * dx + grid["cy"] * dy, grid["rx"] * dx + grid["ry"] * dy


def _met(cells: DataFrame, index: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Cells, with an ``index_level`` each, beside every row of a footprint index that holds the pixel under them."""
    inner = [c for c in index.columns if c not in ("tile_order", "n_rows", "n_cols", *INDEX_KEYS)]
    # in one column, so that further columns of the cells may bear the same names
    held = index.select("tile_order", *INDEX_KEYS, F.struct(*inner).alias("_raster"))
    met = _index_cells(cells, x, y, size).join(held, INDEX_KEYS)
    r = {c: F.col("_raster").getField(c) for c in inner}
    col, row = (F.floor(v) for v in _pixel(r, F.col(x), F.col(y)))
    inside = col.between(r["col_from"], r["col_to"]) & row.between(r["row_from"], r["row_to"])
    return met.where(inside).withColumns({"src_row": row.cast("int"), "src_col": col.cast("int")}).drop(*INDEX_KEYS)


def _index_cells(cells: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Cells, with an ``index_level`` each, and the index cell they lie in."""
    edge = _edge(size, F.col("index_level"))
    return cells.withColumns({"index_x": F.floor(F.col(x) / edge), "index_y": F.floor(F.col(y) / edge)})


def covering(cells: DataFrame, rasters: DataFrame, x: str = "lon", y: str = "lat", size: float = 1.0) -> DataFrame:
    """Each cell beside every raster that covers its position: ``tile_order``, ``src_row``, ``src_col``.

    Cells meet the footprints by index cell, an equi-join; choose ``size`` near a raster's extent or below it. A position on
    the edge of two pixels belongs to the later one. Cells that no raster covers, or with a NULL position, give no row.
    """
    return _met(cells.withColumn("index_level", F.lit(0)), footprint_index(rasters, size), x, y, size).drop("_raster")


def pixel_index(
    rasters: DataFrame, pixels: DataFrame, size: float = 1.0, across: int = 16, index: DataFrame | None = None
) -> DataFrame:
    """``footprint_index`` with the pixels of each index cell as ``values``, row by row; NULL where a pixel is missing.

    An index cell spans at most ``across`` pixels of a raster, and two more at either end, so a row is bounded whatever the
    raster's size. A pixel listed again is a row of its own, for that pixel alone. ``index`` may give some rows of the
    footprint index instead of all.
    """
    index, window = footprint_index(rasters, size, across) if index is None else index, ["row_from", "row_to", "col_from", "col_to"]
    at = ["src_row", "src_col"]
    listed = pixels.groupBy("tile_order", *at).agg(F.collect_list(F.struct("lc")).alias("listed"))
    places = index.select("tile_order", *window).distinct()
    for name, (low, high) in zip(at, (window[:2], window[2:])):
        places = places.withColumn(name, F.explode(F.sequence(low, high)))
    found = places.join(listed, ["tile_order", *at], "left").select("tile_order", *window, *at, F.posexplode_outer("listed").alias("again", "lc"))
    again, alone = F.coalesce("again", F.lit(0)), F.col("again") > 0
    held = found.withColumns({"again": again, "_row": F.when(alone, F.col("src_row")), "_col": F.when(alone, F.col("src_col"))})
    held = held.groupBy("tile_order", *window, "again", "_row", "_col").agg(F.sort_array(F.collect_list(F.struct(*at, "lc"))).alias("held"))
    bounds = {f"_{c}": F.coalesce("_row" if c.startswith("row") else "_col", c) for c in window}
    held = held.select("tile_order", *window, *[v.alias(c) for c, v in bounds.items()], F.transform("held", lambda e: e["lc"]["lc"]).alias("values"))
    i, h = index.alias("i"), held.alias("h")
    same = F.col("i.tile_order").eqNullSafe(F.col("h.tile_order"))
    for c in window:
        same &= F.col(f"i.{c}") == F.col(f"h.{c}")
    kept = [c for c in index.columns if c not in window]
    return i.join(h, same).select(*[f"i.{c}" for c in kept], *[F.col(f"h._{c}").alias(c) for c in window], "h.values")


def _leveled(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells once per level that the grids are on."""
    levels = [row["index_level"] for row in grids.select("index_level").distinct().collect()]
    return cells.withColumn("index_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels) or [0]])))


def reproject_covering(
    cells: DataFrame, rasters: DataFrame, pixels: DataFrame, x: str = "lon", y: str = "lat", size: float = 1.0, across: int = 16,
    index: DataFrame | None = None,
) -> DataFrame:
    """Source value under each cell centre, one row per raster of any affine grid that covers it; NULL where the pixel is missing.

    Pixels travel to the index cells they lie in and cells meet them there, so the pairs of cells and rasters, of which there
    may be many times as many as cells, are made last and never move. The footprint index is written, and tells which levels the rasters are on, 31 at most.
    ``index`` may give some rows of the footprint index instead of all.
    """
    if index is None:
        # written first, so that what makes the rasters is not worked out anew in each term of the index
        index = cut(footprint_index(cut(rasters, "rasters"), size, across), "index")
    leveled = _leveled(cells, index)
    found = _met(leveled, pixel_index(rasters, pixels, size, across, index), x, y, size)
    r = {c: F.col("_raster").getField(c) for c in ("row_from", "col_from", "col_to", "values")}
    place = (F.col("src_row") - r["row_from"]) * (r["col_to"] - r["col_from"] + 1) + F.col("src_col") - r["col_from"]
    named = [c for c in found.columns if c not in ("tile_order", "src_row", "src_col", "_raster")]
    return found.select("tile_order", "src_row", "src_col", *named, F.get(r["values"], place.cast("int")).alias("lc"))


def mosaic_covering(
    cells: DataFrame, rasters: DataFrame, pixels: DataFrame, keys: list[str], x: str = "lon", y: str = "lat",
    size: float = 1.0, nodata: int = 0, asked_first: int = ASKED_FIRST,
) -> DataFrame:
    """Per cell the valid value of the first covering raster; every cell has a row, ``nodata`` where no raster has a value.

    ``cells`` is read twice, once for the lookup and once for its keys, so that uncovered cells do not travel as NULL keys.
    Of the pairs of a cell and its rasters only the valid ones are grouped, and combined where they arise. Where more than
    ``asked_first`` rasters touch a square of edge ``size``, so many are asked first, in their order, and the next ones only for the
    positions that are still without a value; a small job counts them.
    """
    # rasters without an order come first nowhere
    rasters, kept = cut(rasters.where(F.col("tile_order").isNotNull()), "rasters"), list(dict.fromkeys([*keys, x, y]))
    index = cut(footprint_index(rasters, size, 16), "index")
    squares = {f"_{c}": F.expr(f"shiftright({c}, index_level)") for c in ("index_x", "index_y")}
    touched = index.withColumns(squares).select("tile_order", *squares).distinct()
    most = touched.groupBy(*squares).count().agg(F.max("count")).first()[0] or 0
    if most <= asked_first:
        found = _valid(reproject_covering(cells, rasters, pixels, x, y, size, index=index), nodata).select(*keys, "tile_order", "lc")
        return _with_bare(found, cells, keys, nodata)
    # what every round reads again
    cells, pixels, ordered = cut(cells.select(*kept), "cells"), cut(pixels, "pixels"), Window.partitionBy(*squares).orderBy("tile_order")
    numbers = touched.withColumn("_number", F.row_number().over(ordered))
    index = cut(index.withColumns(squares).join(numbers, ["tile_order", *squares]).drop(*squares), "index")
    low, high, left, rounds = 0, asked_first, cells, []
    while low < most:
        some = index.where((F.col("_number") > low) & (F.col("_number") <= high)).drop("_number")
        if rounds:
            some = some.join(_index_cells(_leveled(left, some), x, y, size).select(*INDEX_KEYS).distinct(), INDEX_KEYS, "left_semi")
        # each position for itself, since positions of one key may lie in several squares
        met = _valid(reproject_covering(left, rasters, pixels, x, y, size, index=some), nodata)
        met = met.groupBy(*kept).agg(F.min_by("lc", "tile_order").alias("lc"), F.min("tile_order").alias("tile_order"))
        rounds.append(cut(met, "met"))
        low, high = high, high * TIMES
        if low < most:
            a, b = left.alias("a"), rounds[-1].alias("b")
            same = F.lit(True)
            for c in kept:
                same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
            older, left = left, cut(a.join(b, same, "left_anti"), "left")
            if older is not cells:
                discard(older)
    discard(pixels, index)
    found = rounds[0]
    for more in rounds[1:]:
        found = found.union(more)
    return _with_bare(found.select(*keys, "tile_order", "lc"), cells, keys, nodata)


def _valid(found: DataFrame, nodata: int) -> DataFrame:
    return found.where(F.col("lc") != nodata)


def _with_bare(found: DataFrame, cells: DataFrame, keys: list[str], nodata: int) -> DataFrame:
    order, value = found.schema["tile_order"].dataType, found.schema["lc"].dataType
    bare = cells.select(*keys, F.lit(None).cast(order).alias("tile_order"), F.lit(None).cast(value).alias("lc"))
    return mosaic_first(found.unionByName(bare), keys, nodata)


def align(cells: DataFrame, tiles: DataFrame, keys: list[str], path: str | None = None, **grid) -> DataFrame:
    """Land cover on the cube cells, kept at ``path`` for reuse when one is given."""
    aligned = mosaic_first(reproject_nearest(cell_lat_lon(cells), tiles, **grid), keys)
    return aligned if path is None else materialize(aligned, path)


def with_class(cube: DataFrame, landcover: DataFrame) -> DataFrame:
    """Cube cells with their class; both sides may be large, so no size hint."""
    return cube.join(landcover, ["y", "x"])

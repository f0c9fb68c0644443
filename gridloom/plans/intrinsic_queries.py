"""Land cover, patch, radiometry, stability and difficulty queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from gridloom.config import LAND_COVER, STABLE_CLASSES, DifficultyConfig
from gridloom.operators import cube as cube_ops
from gridloom.operators import intrinsic, landcover, moments, patches
from gridloom.plans.ctes import r6 as q6
from gridloom.plans.ctes import mixed, sql_over
from gridloom.plans.registry import query, r6
from gridloom.schemas import BANDS
from gridloom.sources import derived, tables, workspace

P = derived.PATCH
_D = DifficultyConfig(patch=P)
_PATCH = ["y_coord", "x_coord"]
_CLASSES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
_PER_CLASS = 3
_SEED = 42
_ORIGIN = (6671703.118, 0.0, 463.3127165)
_YX = "CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord"

_LATLON = """SELECT tile, row, col, degrees(ym / 6371007.181e0) AS lat,
  degrees(xm / (6371007.181e0 * cos(ym / 6371007.181e0))) AS lon FROM (SELECT tile, row, col,
    10007554.677e0 - (CAST(substr(tile, 5, 2) AS INT) + (row + 5e-1) / 2400e0) * 1111950.5196666666e0 AS ym,
    -20015109.354e0 + (CAST(substr(tile, 2, 2) AS INT) + (col + 5e-1) / 2400e0) * 1111950.5196666666e0 AS xm
    FROM (SELECT DISTINCT tile, row, col FROM obs))"""
_LOOKUP = """SELECT k.tile, k.row, k.col, l.tile_order, l.lc FROM (
  SELECT tile, row, col, CAST(floor(lat / 3e0) * 3 AS INT) AS tile_lat, CAST(floor(lon / 3e0) * 3 AS INT) AS tile_lon,
    CAST(least(5, floor((floor(lat / 3e0) * 3 + 3 - lat) * 2e0)) AS INT) AS src_row,
    CAST(least(5, floor((lon - floor(lon / 3e0) * 3) * 2e0)) AS INT) AS src_col FROM latlon) k
  LEFT JOIN lctiles l ON k.tile_lat = l.tile_lat AND k.tile_lon = l.tile_lon AND k.src_row = l.src_row AND k.src_col = l.src_col"""
_FIRST = """SELECT tile, row, col,
  CAST(coalesce(arg_min(lc, tile_order) FILTER (lc <> 0), 0) AS SMALLINT) AS lc FROM lookup GROUP BY tile, row, col"""
_C_WITH = {"latlon": _LATLON, "lookup": _LOOKUP}

# every cell against every raster
_RASTERS = """SELECT DISTINCT CAST(o_orderkey // 512 AS INT) AS tile_order FROM orders"""
_GRIDS = """SELECT tile_order, 5e-1 AS ax, 125e-3 * (tile_order % 3) AS bx, CAST((tile_order * 11) % 29 AS DOUBLE) - 2 AS x0,
  -125e-3 * (tile_order % 2) AS ay, -5e-1 AS by_, 42 + 25e-2 * ((tile_order * 7) % 83) AS y0, 8 AS n_rows, 8 + tile_order % 5 AS n_cols
  FROM rasters"""
_PIXELS = """SELECT CAST(o_orderkey // 512 AS INT) AS tile_order, CAST(o_orderkey % 8 AS INT) AS src_row,
  CAST(o_custkey % 12 AS INT) AS src_col, max(CAST(10 * ((o_orderkey + o_custkey) % 9) AS INT)) AS lc FROM orders GROUP BY 1, 2, 3"""
_COVERED = """SELECT f.*, p.lc FROM (SELECT tile, row, col, tile_order, CAST(v AS INT) AS src_row, CAST(u AS INT) AS src_col FROM (
  SELECT tile, row, col, tile_order, n_rows, n_cols,
    floor(by_ / det * (lon - x0) + -bx / det * (lat - y0)) AS u, floor(-ay / det * (lon - x0) + ax / det * (lat - y0)) AS v
  FROM latlon, (SELECT *, ax * by_ - bx * ay AS det FROM grids))
  WHERE u >= 0 AND u < n_cols AND v >= 0 AND v < n_rows) f
  LEFT JOIN pixels p ON f.tile_order = p.tile_order AND f.src_row = p.src_row AND f.src_col = p.src_col"""
_COVERING = {"latlon": _LATLON, "rasters": _RASTERS, "grids": _GRIDS, "pixels": _PIXELS, "covered": _COVERED}
_COVERED_FIRST = """SELECT l.tile, l.row, l.col, CAST(coalesce(c.lc, 0) AS SMALLINT) AS lc FROM latlon l LEFT JOIN (
  SELECT tile, row, col, arg_min(lc, tile_order) FILTER (lc <> 0) AS lc FROM covered GROUP BY 1, 2, 3) c
  ON l.tile = c.tile AND l.row = c.row AND l.col = c.col"""

_DOMINANT = f"""SELECT y_coord, x_coord, lc AS class FROM (
  SELECT {_YX}, lc, count(*) AS n FROM landcover GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY y_coord, x_coord ORDER BY n DESC, lc) = 1"""
_CHOSEN = f"""SELECT y_coord, x_coord, class FROM dominant QUALIFY row_number() OVER (PARTITION BY class ORDER BY
  {mixed('patches', 'y_coord, x_coord', seed=_SEED)}, y_coord, x_coord) <= {_PER_CLASS}"""
_MEDIANS = f"""SELECT y, x, class, {", ".join(f"median({b}) AS {b}" for b in BANDS)} FROM (
  SELECT c.*, class FROM (SELECT *, {_YX} FROM cube) c JOIN chosen p ON c.y_coord = p.y_coord AND c.x_coord = p.x_coord)
  GROUP BY y, x, class"""
_LCDIM = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, n, c in LAND_COVER) + ") v(lc, name, color)"
_R_WITH = {"dominant": _DOMINANT, "chosen": _CHOSEN, "medians": _MEDIANS, "lcdim": _LCDIM}
_ANY = "coalesce(" + ", ".join(BANDS) + ") IS NOT NULL"
_RADIO = "SELECT y, x, name AS land_cover_name, {bands} FROM medians m JOIN lcdim d ON m.class = d.lc WHERE " + _ANY
_LONG = (
    "SELECT y, x, name AS land_cover_name, color, band, reflectance FROM ("
    + " UNION ALL ".join(f"SELECT y, x, class, '{b}' AS band, {b} AS reflectance FROM medians" for b in BANDS)
    + ") m JOIN lcdim d ON m.class = d.lc"
)
_STD = f"""SELECT y, x, {", ".join(f"stddev_pop({b}) AS {b}" for b in BANDS)} FROM cube
  WHERE usability = 0 AND (y, x) IN (SELECT (y, x) FROM landcover WHERE lc IN (50, 60, 80)) GROUP BY y, x"""

_SHANNON = f"""SELECT y_coord, x_coord, -sum(n / s * log2(n / s)) AS heterogeneity FROM (
  SELECT y_coord, x_coord, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY y_coord, x_coord) AS DOUBLE) AS s
  FROM (SELECT {_YX}, lc, count(*) AS n FROM landcover GROUP BY 1, 2, 3)) GROUP BY 1, 2"""
_CELL = """SELECT y, x, CASE WHEN count(*) FILTER (b02 + b01 = 0 AND b02 - b01 <> 0) = 0
    THEN stddev_pop(CASE WHEN b02 + b01 <> 0 THEN (b02 - b01) / (b02 + b01) END) END AS ndvi_std,
  count(*) FILTER (usability = 4) / 12e0 AS persistence FROM cube GROUP BY y, x"""
_METRICS = f"""SELECT {_YX}, avg(ndvi_std) AS phenology_variability, sum(persistence) / 64e0 AS cloud_persistence
  FROM cellstats GROUP BY 1, 2"""


def _norm(m):
    return (
        f"CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 0e0 "
        f"ELSE ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) END"
    )


_PARTS = ["heterogeneity", "phenology_variability", "cloud_persistence"]
_DIFFICULTY = f"""SELECT * FROM (SELECT s.y_coord, s.x_coord, {", ".join(_PARTS)},
  {" + ".join(f"33e-2 * ({_norm(m)})" for m in _PARTS)} AS difficulty_index
  FROM shannon s JOIN metrics m ON s.y_coord = m.y_coord AND s.x_coord = m.x_coord)
  WHERE heterogeneity IS NOT NULL AND phenology_variability IS NOT NULL"""
_D_WITH = {"shannon": _SHANNON, "cellstats": _CELL, "metrics": _METRICS, "difficulty": _DIFFICULTY}


def tercile_sql(rank: str, n: str) -> str:
    return (
        f"CASE WHEN {rank} = 1 OR 3 * ({rank} - 1) < {n} - 1 THEN 'Low' "
        f"WHEN 3 * ({rank} - 1) < 2 * ({n} - 1) THEN 'Medium' ELSE 'High' END"
    )


def _stratum(m, alias):
    return f"{tercile_sql(f'row_number() OVER (ORDER BY {m}, y_coord, x_coord)', 'count(*) OVER ()')} AS {alias}"


def _cells(spark, d):
    return landcover.cell_lat_lon(derived.obs_500m(spark, d).select("tile", "row", "col").distinct())


def _chosen(spark, d):
    dominant = patches.dominant_class(derived.landcover(spark, d), P)
    return patches.stratified_patches(dominant, _CLASSES, _PER_CLASS, _SEED)


def _radiometry(spark, d):
    return intrinsic.radiometry(derived.cube(spark, d), _chosen(spark, d), tables.lc_dim(spark), P)


def _long(spark, d):
    cells = patches.extract(derived.cube(spark, d), F.broadcast(_chosen(spark, d)), P)
    long = intrinsic.long_reflectance(intrinsic.temporal_medians(cells))
    return intrinsic.name_classes(long, tables.lc_dim(spark))


def _std(spark, d):
    cells = intrinsic.stable_cells(derived.cube(spark, d), derived.landcover(spark, d), STABLE_CLASSES)
    return intrinsic.temporal_std(cells)


def difficulty_table(spark, d):
    height, width = derived.grid_shape(spark, d)
    cube, classes = derived.cube(spark, d), derived.landcover(spark, d)
    return intrinsic.difficulty(cube, classes, _D, derived.FRAMES, height, width, geo=_ORIGIN)


@query(
    "o_c1_reproject",
    sql_over("obs lctiles", "SELECT tile, row, col, tile_order, lc FROM lookup", **_C_WITH),
)
def reproject(spark, d):
    found = landcover.reproject_nearest(_cells(spark, d), derived.landcover_tiles(spark, d))
    return found.select("tile", "row", "col", "tile_order", "lc")


@query(
    "o_c1_reproject_footprints",
    sql_over("obs", "SELECT tile, row, col, tile_order, src_row, src_col, lc FROM covered", **_COVERING),
)
def reproject_footprints(spark, d):
    """Rasters on grids of their own, overlapping and partly rotated."""
    rasters, pixels = derived.landcover_rasters(spark, d), derived.landcover_pixels(spark, d)
    found = landcover.reproject_covering(landcover.cell_lat_lon(_cells(spark, d)), rasters, pixels, size=2.0)
    return found.select("tile", "row", "col", "tile_order", "src_row", "src_col", "lc")


@query("o_c2_mosaic_footprints", sql_over("obs", _COVERED_FIRST, **_COVERING))
def mosaic_footprints(spark, d):
    rasters, pixels = derived.landcover_rasters(spark, d), derived.landcover_pixels(spark, d)
    cells = landcover.cell_lat_lon(_cells(spark, d))
    return landcover.mosaic_covering(cells, rasters, pixels, ["tile", "row", "col"], size=2.0)


@query("o_c2_mosaic_first", sql_over("obs lctiles", _FIRST, **_C_WITH))
def mosaic_first(spark, d):
    found = landcover.reproject_nearest(_cells(spark, d), derived.landcover_tiles(spark, d))
    return landcover.mosaic_first(found, ["tile", "row", "col"])


@query("o_c3_align", sql_over("obs lctiles", _FIRST, **_C_WITH))
def align(spark, d):
    cells = derived.obs_500m(spark, d).select("tile", "row", "col").distinct()
    path = workspace.new_path(spark, "aligned")
    return landcover.align(cells, derived.landcover_tiles(spark, d), ["tile", "row", "col"], path)


@query(
    "o_c4_join_class",
    sql_over(
        "cube landcover",
        """SELECT lc, usability, count(*) AS n, round(avg(b02) + 1e-9, 6) AS b02
  FROM cube c JOIN landcover l ON c.y = l.y AND c.x = l.x GROUP BY lc, usability""",
    ),
)
def join_class(spark, d):
    joined = landcover.with_class(derived.cube(spark, d), derived.landcover(spark, d))
    return joined.groupBy("lc", "usability").agg(F.count("*").alias("n"), r6(F.avg("b02"), "b02"))


@query(
    "o_d1_patch_keys",
    sql_over(
        "cube shape",
        """SELECT CAST(y // 7 * 7 AS INT) AS y_coord, CAST(x // 7 * 7 AS INT) AS x_coord, count(*) AS n
  FROM cube, shape WHERE y < h // 7 * 7 AND x < w // 7 * 7 GROUP BY 1, 2""",
    ),
)
def patch_keys(spark, d):
    height, width = derived.grid_shape(spark, d)
    cells = patches.with_patch(derived.cube(spark, d), 7, height, width)
    return cells.groupBy(*_PATCH).agg(F.count("*").alias("n"))


@query("o_d2_dominant_class", sql_over("landcover", _DOMINANT))
def dominant_class(spark, d):
    return patches.dominant_class(derived.landcover(spark, d), P)


@query(
    "o_d3_stratified_patches",
    sql_over("landcover", "SELECT y_coord AS y, x_coord AS x, class FROM chosen", dominant=_DOMINANT, chosen=_CHOSEN),
)
def stratified_patches(spark, d):
    return _chosen(spark, d)


@query(
    "o_d4_patch_coords",
    sql_over(
        "landcover",
        f"""SELECT {_YX}, round(avg(6671703.118e0 - (y + 5e-1) * 463.3127165e0), 4) AS geo_y,
  round(avg((x + 5e-1) * 463.3127165e0), 4) AS geo_x
  FROM (SELECT unnest(range(h)) AS y FROM shape), (SELECT unnest(range(64)) AS x) GROUP BY 1, 2""",
        shape="SELECT (max(l_orderkey) // 2048 + 1) * 8 AS h FROM lineitem",
    ),
)
def patch_coords(spark, d):
    height, width = derived.grid_shape(spark, d)
    placed = patches.patch_coords(patches.patch_grid(spark, height, width, P), P, *_ORIGIN)
    return placed.select(*_PATCH, F.round("geo_y", 4).alias("geo_y"), F.round("geo_x", 4).alias("geo_x"))


@query(
    "o_d5_enumerate_windows",
    sql_over(
        "shape",
        """SELECT i AS idx, CAST(i % 9 AS INT) AS t_start, CAST(i // 9 // 8 * 8 AS INT) AS y_coord,
  CAST(i // 9 % 8 * 8 AS INT) AS x_coord FROM (SELECT unnest(range(h // 8 * 8 * 9)) AS i FROM shape)""",
    ),
)
def enumerate_windows(spark, d):
    height, width = derived.grid_shape(spark, d)
    return patches.enumerate_windows(spark, height, width, derived.FRAMES, P, derived.WINDOW)


@query(
    "o_d6_extract",
    sql_over(
        "cube landcover",
        f"""SELECT t, y, x, class, round(b01, 6) AS b01 FROM (SELECT *, {_YX} FROM cube) c
  JOIN chosen p ON c.y_coord = p.y_coord AND c.x_coord = p.x_coord""",
        dominant=_DOMINANT,
        chosen=_CHOSEN,
    ),
)
def extract(spark, d):
    cells = patches.extract(derived.cube(spark, d), F.broadcast(_chosen(spark, d)), P)
    return cells.select("t", "y", "x", "class", F.round("b01", 6).alias("b01"))


@query(
    "o_e1_band_selection",
    sql_over("cube", f"SELECT t, y, x, {', '.join(f'round({b}, 6) AS {b}' for b in BANDS)} FROM cube"),
)
def band_selection(spark, d):
    return derived.cube(spark, d).select("t", "y", "x", *[F.round(b, 6).alias(b) for b in BANDS])


@query(
    "o_e2_temporal_median",
    sql_over("cube", f"SELECT y, x, {', '.join(f'{q6(f'median({b})')} AS {b}' for b in BANDS)} FROM cube GROUP BY y, x"),
)
def temporal_median(spark, d):
    return intrinsic.temporal_medians(derived.cube(spark, d)).select("y", "x", *[r6(b) for b in BANDS])


@query(
    "o_e3_long_reflectance",
    sql_over(
        "cube landcover",
        f"SELECT y, x, band, land_cover_name, {q6('reflectance')} AS reflectance FROM long",
        **_R_WITH,
        long=_LONG,
    ),
)
def long_reflectance(spark, d):
    return _long(spark, d).select("y", "x", "band", "land_cover_name", r6("reflectance"))


@query(
    "o_e4_class_names",
    sql_over("landcover", "SELECT y, x, name AS land_cover_name, color FROM landcover l LEFT JOIN lcdim d ON l.lc = d.lc", lcdim=_LCDIM),
)
def class_names(spark, d):
    named = intrinsic.name_classes(derived.landcover(spark, d), tables.lc_dim(spark), "lc")
    return named.select("y", "x", "land_cover_name", "color")


_HIST = """SELECT band, land_cover_name, CAST(CASE WHEN reflectance < 0 THEN 0 WHEN reflectance >= 16e-1 THEN 33
  ELSE floor(reflectance / 5e-2) + 1 END AS INT) AS bin, count(*) AS n
  FROM (SELECT band, name AS land_cover_name, round(value, 6) + 1e-7 AS reflectance FROM ({long}) s
    JOIN landcover l ON s.y = l.y AND s.x = l.x JOIN lcdim d ON l.lc = d.lc WHERE value IS NOT NULL) GROUP BY 1, 2, 3""".format(
    long=" UNION ALL ".join(f"SELECT y, x, '{b}' AS band, {b} AS value FROM cube" for b in BANDS)
)


def _histogram(spark, d):
    classed = landcover.with_class(derived.cube(spark, d), derived.landcover(spark, d))
    long = cube_ops.to_long(classed, BANDS, ["lc"], "reflectance")
    # off the bin edges, which short decimals would hit exactly
    nudged = long.withColumn("reflectance", F.round("reflectance", 6) + F.lit(1e-7))
    named = intrinsic.name_classes(nudged, tables.lc_dim(spark), "lc")
    return intrinsic.histogram(named, 0.0, 1.6, 32)


@query("o_e5_histogram", sql_over("cube landcover", _HIST, lcdim=_LCDIM))
def histogram(spark, d):
    return _histogram(spark, d)


@query(
    "o_e5_density",
    sql_over(
        "cube landcover",
        """SELECT band, land_cover_name, CAST(a.at AS INT) AS at, round(coalesce(sum(n * exp(-5e-1 * ((a.at - bin) * (5e-2 / 1e-1)) ** 2)
    / (1e-1 * sqrt(2 * pi()))) FILTER (bin BETWEEN 1 AND 32), 0) / sum(n) + 1e-9, 6) AS density
  FROM hist, (SELECT unnest(range(1, 33)) AS at) a GROUP BY 1, 2, 3""",
        lcdim=_LCDIM,
        hist=_HIST,
    ),
)
def density(spark, d):
    curve = intrinsic.density(_histogram(spark, d), 0.0, 1.6, 32, 0.1)
    return curve.select("band", "land_cover_name", "at", r6("density"))


def _named(spark, d):
    classed = landcover.with_class(derived.cube(spark, d), derived.landcover(spark, d))
    long = cube_ops.to_long(classed, BANDS, ["lc"], "reflectance")
    return intrinsic.name_classes(long, tables.lc_dim(spark), "lc")


_CLASSED = "SELECT band, name AS land_cover_name, v FROM (" + " UNION ALL ".join(
    f"SELECT '{b}' AS band, lc, {b} AS v FROM cube c JOIN landcover l ON c.y = l.y AND c.x = l.x WHERE {b} IS NOT NULL" for b in BANDS
) + ") u JOIN lcdim d ON u.lc = d.lc"
_SCOTT = """SELECT *, lo - 3 * width AS start, (hi - lo + 6 * width) / 199 AS step FROM (
  SELECT band, land_cover_name, count(*) AS n, stddev_samp(v) * power(count(*), -2e-1) AS width, min(v) AS lo, max(v) AS hi
  FROM classed GROUP BY ALL) WHERE width > 0"""
_DEALT = """SELECT band, land_cover_name, bin, sum(w) AS w FROM (
  SELECT band, land_cover_name, unnest([floor(a), floor(a) + 1]) AS bin, unnest([floor(a) + 1 - a, a - floor(a)]) AS w FROM (
    SELECT c.band, c.land_cover_name, (v - start) / step AS a FROM classed c JOIN scott s ON c.band = s.band AND c.land_cover_name = s.land_cover_name))
  GROUP BY ALL"""


@query(
    "o_e5_kernel_density",
    sql_over(
        "cube landcover",
        """SELECT d.band, d.land_cover_name, CAST(p AS INT) AS point, round(max(start + p * step), 5) AS value,
  round(sum(w * exp(-5e-1 * power((p - bin) * step / width, 2))) / (max(n) * max(width) * sqrt(2 * pi())), 5) AS density
  FROM dealt d JOIN scott s ON d.band = s.band AND d.land_cover_name = s.land_cover_name, (SELECT unnest(range(200)) AS p) g
  GROUP BY d.band, d.land_cover_name, p""",
        lcdim=_LCDIM,
        classed=_CLASSED,
        scott=_SCOTT,
        dealt=_DEALT,
    ),
)
def kernel_density(spark, d):
    curve = intrinsic.kernel_density(_named(spark, d))
    return curve.select("band", "land_cover_name", "point", F.round("value", 5).alias("value"), F.round("density", 5).alias("density"))


@query(
    "o_e6_pivot",
    sql_over(
        "cube landcover",
        "SELECT y, x, land_cover_name, "
        + ", ".join(f"round(avg(reflectance) FILTER (band = '{b}') + 1e-9, 6) AS {b}" for b in BANDS)
        + " FROM long WHERE reflectance IS NOT NULL GROUP BY 1, 2, 3",
        **_R_WITH,
        long=_LONG,
    ),
)
def pivot(spark, d):
    wide = intrinsic.pivot_bands(_long(spark, d), BANDS)
    return wide.select("y", "x", "land_cover_name", *[r6(b) for b in BANDS])


@query(
    "o_e7_band_correlation",
    sql_over(
        "cube landcover",
        " UNION ALL ".join(
            f"SELECT '{a.upper()}' AS band_i, '{b.upper()}' AS band_j, round(corr({a}, {b}), 6) AS r FROM medians"
            for a, b in product(BANDS, BANDS)
        ),
        **_R_WITH,
    ),
)
def band_correlation(spark, d):
    matrix = intrinsic.band_correlation(_radiometry(spark, d), [b.upper() for b in BANDS])
    return matrix.withColumn("r", F.round("r", 6))


@query(
    "o_e8_sample_rows",
    sql_over(
        "cube",
        f"""SELECT y, x, round(b01 + 1e-9, 6) AS b01, round(b02 + 1e-9, 6) AS b02 FROM (
  SELECT y, x, median(b01) AS b01, median(b02) AS b02 FROM cube GROUP BY y, x)
  ORDER BY {mixed('rows', 'y, x')}, y, x LIMIT 1000""",
    ),
)
def sample_rows(spark, d):
    medians = intrinsic.temporal_medians(derived.cube(spark, d), ["b01", "b02"])
    return intrinsic.sample_rows(medians, 1000).select("y", "x", r6("b01"), r6("b02"))


@query(
    "o_e9_radiometry_csv",
    sql_over("cube landcover", _RADIO.format(bands=", ".join(f"{q6(b)} AS {b.upper()}" for b in BANDS)), **_R_WITH),
)
def radiometry_csv(spark, d):
    path = workspace.new_path(spark, "radiometry")
    table = _radiometry(spark, d)
    tables.write_csv(table, path)
    back = spark.read.csv(path, header=True, schema=table.schema)
    return back.select("y", "x", "land_cover_name", *[r6(b.upper()) for b in BANDS])


@query(
    "o_e10_stable_targets",
    sql_over("landcover", "SELECT y, x FROM landcover WHERE lc IN (50, 60, 80)"),
)
def stable_targets(spark, d):
    return derived.landcover(spark, d).filter(F.col("lc").isin(STABLE_CLASSES)).select("y", "x")


@query(
    "o_e11_clear_only",
    sql_over(
        "cube landcover",
        """SELECT t, y, x, round(b01, 6) AS b01 FROM cube
  WHERE usability = 0 AND (y, x) IN (SELECT (y, x) FROM landcover WHERE lc IN (50, 60, 80))""",
    ),
)
def clear_only(spark, d):
    cells = intrinsic.stable_cells(derived.cube(spark, d), derived.landcover(spark, d), STABLE_CLASSES)
    return cells.select("t", "y", "x", F.round("b01", 6).alias("b01"))


@query(
    "o_e12_temporal_std",
    sql_over(
        "cube landcover",
        f"SELECT y, x, {', '.join(f'{q6(b)} AS {b}' for b in BANDS)} FROM std",
        std=_STD,
    ),
)
def temporal_std(spark, d):
    return _std(spark, d).select("y", "x", *[r6(b) for b in BANDS])


@query(
    "o_e13_std_rasters",
    sql_over(
        "cube landcover",
        " UNION ALL ".join(f"SELECT y, x, '{b}' AS band, {q6(b)} AS std FROM std" for b in BANDS),
        std=_STD,
    ),
)
def std_rasters(spark, d):
    path = workspace.new_path(spark, "std")
    tables.write_by(_std(spark, d).unpivot(["y", "x"], BANDS, "band", "std"), path, "band")
    return spark.read.parquet(path).select("y", "x", "band", r6("std"))


@query(
    "o_e14_temporal_summary",
    sql_over(
        "cube landcover",
        " UNION ALL ".join(f"SELECT '{b}' AS band, round(avg({b}), 6) AS mean_temporal_std_dev FROM std" for b in BANDS),
        std=_STD,
    ),
)
def temporal_summary(spark, d):
    summary = intrinsic.temporal_summary(_std(spark, d))
    return summary.withColumn("mean_temporal_std_dev", F.round("mean_temporal_std_dev", 6))


@query(
    "o_e15_shannon",
    sql_over("landcover", f"SELECT y_coord, x_coord, {q6('heterogeneity')} AS heterogeneity FROM shannon", shannon=_SHANNON),
)
def shannon(spark, d):
    return intrinsic.shannon(derived.landcover(spark, d), P).select(*_PATCH, r6("heterogeneity"))


@query(
    "o_e16a_ndvi",
    sql_over(
        "cube",
        "SELECT t, y, x, round(CASE WHEN b02 + b01 <> 0 THEN (b02 - b01) / (b02 + b01) END, 6) AS ndvi FROM cube",
    ),
)
def ndvi(spark, d):
    value = intrinsic.ndvi(F.col("b01"), F.col("b02"))
    return derived.cube(spark, d).select("t", "y", "x", F.round(value, 6).alias("ndvi"))


@query(
    "o_e16b_phenology",
    sql_over("cube", f"SELECT y_coord, x_coord, {q6('phenology_variability')} AS phenology_variability FROM metrics", cellstats=_CELL, metrics=_METRICS),
)
def phenology(spark, d):
    height, width = derived.grid_shape(spark, d)
    metrics = intrinsic.cube_metrics(derived.cube(spark, d), _D, derived.FRAMES, height, width)
    return metrics.select(*_PATCH, r6("phenology_variability"))


@query(
    "o_e16c_cloud_persistence",
    sql_over("cube", f"SELECT y_coord, x_coord, {q6('cloud_persistence')} AS cloud_persistence FROM metrics", cellstats=_CELL, metrics=_METRICS),
)
def cloud_persistence(spark, d):
    height, width = derived.grid_shape(spark, d)
    metrics = intrinsic.cube_metrics(derived.cube(spark, d), _D, derived.FRAMES, height, width)
    return metrics.select(*_PATCH, r6("cloud_persistence"))


@query(
    "o_e16d_min_max",
    sql_over(
        "landcover",
        f"SELECT y_coord, x_coord, round({_norm('heterogeneity')} + 1e-9, 6) AS heterogeneity_norm FROM shannon",
        shannon=_SHANNON,
    ),
)
def min_max(spark, d):
    scaled = intrinsic.min_max(intrinsic.shannon(derived.landcover(spark, d), P), ["heterogeneity"])
    return scaled.select(*_PATCH, r6("heterogeneity_norm"))


@query(
    "o_e16e_index",
    sql_over("cube landcover", f"SELECT y_coord, x_coord, {q6('difficulty_index')} AS difficulty_index FROM difficulty", **_D_WITH),
)
def index(spark, d):
    return difficulty_table(spark, d).select(*_PATCH, r6("difficulty_index"))


_ALL = [*_PARTS, "difficulty_index"]
_GEO_SQL = """round(6671703.118e0 - (y_coord + 4e0) * 463.3127165e0, 4) AS geo_y,
  round((x_coord + 4e0) * 463.3127165e0, 4) AS geo_x"""


@query(
    "o_e16f_difficulty",
    sql_over(
        "cube landcover",
        f"SELECT y_coord, x_coord, {_GEO_SQL}, {', '.join(f'{q6(m)} AS {m}' for m in _ALL)} FROM difficulty",
        **_D_WITH,
    ),
)
def difficulty(spark, d):
    return difficulty_table(spark, d).select(
        *_PATCH, F.round("geo_y", 4).alias("geo_y"), F.round("geo_x", 4).alias("geo_x"), *[r6(m) for m in _ALL]
    )


@query(
    "o_e17_strata",
    sql_over(
        "pdiff",
        "SELECT y_coord, x_coord, " + ", ".join(_stratum(m, a) for m, a in intrinsic.STRATA.items()) + " FROM pdiff",
    ),
)
def strata(spark, d):
    labelled = intrinsic.with_strata(derived.patch_difficulty(spark, d))
    return labelled.select(*_PATCH, *intrinsic.STRATA.values())


def _halves(spark, d):
    """The first and the last six frames, as a cube that has grown by half."""
    cells = derived.cube(spark, d)
    return cells.filter("t < 6"), cells.filter("t >= 6")


@query(
    "o_e12_merged_std",
    sql_over("cube", "SELECT y, x, " + ", ".join(f"round(stddev_pop({b}) + 1e-9, 6) AS {b}" for b in BANDS) + " FROM cube GROUP BY y, x HAVING " + " OR ".join(f"count({b}) > 0" for b in BANDS)),
)
def merged_std(spark, d):
    """Deviations over all frames from the stored state of the first half and the second half alone."""
    keys, (old, new) = ["y", "x"], _halves(spark, d)
    state = workspace.cut(moments.cell_moments(old, keys, BANDS), "moments")
    whole = moments.merge([state, moments.cell_moments(new, keys, BANDS)], [*keys, "band"])
    return moments.deviations(whole, keys, BANDS).select(*keys, *[r6(b) for b in BANDS])


@query(
    "o_e7_merged_correlation",
    sql_over(
        "cube",
        " UNION ALL ".join(
            f"SELECT '{a}' AS band_i, '{b}' AS band_j, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}) + 1e-9, 6) AS r FROM cube"
            for i, a in enumerate(BANDS) for b in BANDS[i + 1 :]
        ),
    ),
)
def merged_correlation(spark, d):
    keys, (old, new) = ["band_i", "band_j"], _halves(spark, d)
    state = workspace.cut(moments.pair_moments(old, BANDS), "moments")
    whole = moments.merge([state, moments.pair_moments(new, BANDS)], keys)
    return moments.correlations(whole).select(*keys, "n", r6("r"))

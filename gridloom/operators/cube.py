"""Tiles to cube: quality gate, cleaning, mask upsampling, mosaics, dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import (
    BAND_NAMES,
    BAND_WAVELENGTHS_NM,
    MASK_LEGEND,
    CubeConfig,
)
from gridloom.functions.geo import tile_h, tile_v
from gridloom.functions.quality import band_good, clean_band, usability
from gridloom.functions.spectral import add
from gridloom.schemas import CUBE_ATTRS
from gridloom.sources.workspace import cut

_TILE = ["tile", "date"]


def band_columns(c: CubeConfig) -> list[str]:
    return [f"b{b:02d}" for b in c.bands]


def tile_quality(obs500: DataFrame, c: CubeConfig) -> DataFrame:
    """Share of good band-pixels per tile and date."""
    good = add([band_good(F.col("qc"), b).cast("int") for b in c.bands])
    return obs500.groupBy(*_TILE).agg(
        (F.sum(good) / (F.count("*") * len(c.bands))).alias("good_fraction")
    )


def tile_gate(obs500: DataFrame, c: CubeConfig) -> DataFrame:
    return tile_quality(obs500, c).filter(F.col("good_fraction") >= c.min_valid_fraction)


def mosaic_days(obs500: DataFrame, c: CubeConfig) -> DataFrame:
    """Dates on which every one of the required tiles is present and passes the gate.

    Reads only the key and quality columns.
    """
    quality = tile_quality(obs500, c)
    passed = (F.col("good_fraction") >= c.min_valid_fraction).cast("int")
    days = quality.groupBy("date").agg(F.count("*").alias("tiles"), F.sum(passed).alias("passed"))
    return days.filter(
        (F.col("tiles") == c.tiles_per_day) & (F.col("passed") == c.tiles_per_day)
    ).select("date")


def time_index(days: DataFrame) -> DataFrame:
    """Dense frame number per date.

    The dates form one array, whose length the calendar bounds.
    """
    ordered = days.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    return ordered.select(F.posexplode("dates").alias("t", "date"))


def clean_bands(obs500: DataFrame, c: CubeConfig) -> DataFrame:
    keys = [k for k in obs500.columns if not (k == "qc" or k[:1] == "r" and k[1:].isdigit())]
    bands = [
        clean_band(F.col(f"r{b}"), F.col("qc"), b, c).alias(name)
        for b, name in zip(c.bands, band_columns(c))
    ]
    return obs500.select(*keys, *bands)


def upsample_mask(fine: DataFrame, coarse: DataFrame, c: CubeConfig) -> DataFrame:
    """Nearest coarse usability for each fine cell; uncovered cells get the fill code."""
    k = c.upsampling
    codes = coarse.select(
        *_TILE,
        F.col("row").alias("_row"),
        F.col("col").alias("_col"),
        usability(F.col("state"), c.state_fill, c.mask_fill).alias("usability"),
    )
    keyed = fine.withColumns(
        {
            "_row": F.expr(f"row div {k}").cast("int"),
            "_col": F.expr(f"col div {k}").cast("int"),
        }
    )
    joined = keyed.join(codes, [*_TILE, "_row", "_col"], "left").drop("_row", "_col")
    return joined.withColumn(
        "usability", F.coalesce("usability", F.lit(c.mask_fill)).cast("smallint")
    )


def mosaic_coordinates(tiles: DataFrame, c: CubeConfig) -> DataFrame:
    """Grid coordinates over all tiles, counted from the origin tile."""
    return tiles.withColumns(
        {
            "y": ((tile_v(F.col("tile")) - c.origin_v) * c.tile_rows + F.col("row")).cast("int"),
            "x": ((tile_h(F.col("tile")) - c.origin_h) * c.tile_cols + F.col("col")).cast("int"),
        }
    )


def process_tiles(obs500: DataFrame, obs1km: DataFrame, c: CubeConfig) -> DataFrame:
    """Cleaned bands and mask of all tiles that pass the gate."""
    kept = obs500.join(tile_gate(obs500, c).select(*_TILE), _TILE, "left_semi")
    return upsample_mask(clean_bands(kept, c), obs1km, c)


def build_cube(obs500: DataFrame, obs1km: DataFrame, c: CubeConfig) -> DataFrame:
    """The cube of all complete days, frames numbered by date.

    The day table is tiny and written first, so the quality column is read once
    for it; whole days then drop out of both inputs by a broadcast join before
    the only large shuffle, the one that joins the mask.
    """
    frames = cut(time_index(mosaic_days(obs500, c)), "frames")
    # one row per calendar day
    fine = obs500.join(F.broadcast(frames), "date")
    coarse = obs1km.join(F.broadcast(frames.select("date")), "date", "left_semi")
    cells = mosaic_coordinates(upsample_mask(clean_bands(fine, c), coarse, c), c)
    return cells.select("t", "date", "y", "x", *band_columns(c), "usability")


def build_chunks(obs500: DataFrame, obs1km: DataFrame, c: CubeConfig) -> DataFrame:
    """The cube of all complete days with its chunk numbers, placed by frame and chunk.

    Fine and coarse rows get the same chunk key, move once by it, meet there cell by cell of the coarse grid (a group is one
    coarse cell and the fine ones it covers), and can be written where they lie. Tiles and chunks must be whole numbers of
    coarse cells, and a coarse cell occurs once a day; ``build_cube`` takes any size.
    """
    k = c.upsampling
    if any(n % k for n in (c.tile_rows, c.tile_cols, c.chunk)):
        raise ValueError(f"tile and chunk edges must be multiples of {k}")
    frames = cut(time_index(mosaic_days(obs500, c)), "frames")
    # one row per calendar day
    fine = mosaic_coordinates(clean_bands(obs500.join(F.broadcast(frames), "date"), c), c)
    coarse = mosaic_coordinates(
        obs1km.join(F.broadcast(frames), "date").withColumns({"row": F.col("row") * k, "col": F.col("col") * k}), c
    )
    code = usability(F.col("state"), c.state_fill, c.mask_fill)
    entry = F.struct("y", "x", *band_columns(c))

    def placed(rows: DataFrame, value, cell) -> DataFrame:
        numbers = {"cy": f"y div {c.chunk}", "cx": f"x div {c.chunk}", "my": f"y div {k}", "mx": f"x div {k}"}
        return rows.select(
            "t", "date", *[F.expr(e).cast("int").alias(n) for n, e in numbers.items()], value.alias("code"), cell.alias("cell")
        )

    kind = fine.select(entry.alias("cell")).schema["cell"].dataType
    both = placed(fine, F.lit(None).cast("smallint"), entry).union(placed(coarse, code, F.lit(None).cast(kind)))
    met = (
        both.repartition("t", "cy", "cx")
        .groupBy("t", "date", "cy", "cx", "my", "mx")
        .agg(F.max("code").alias("code"), F.collect_list("cell").alias("cells"))
    )
    cells = met.select("t", "date", "cy", "cx", "code", F.explode("cells").alias("cell"))
    mask = F.coalesce("code", F.lit(c.mask_fill)).cast("smallint").alias("usability")
    return cells.select("t", "date", "cell.y", "cell.x", *[f"cell.{b}" for b in band_columns(c)], mask, "cy", "cx")


def to_long(cube: DataFrame, bands: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """One row per key and band; the mask, being a float in the stack, comes as a double."""
    wide = cube.select(*keys, *[F.col(b).cast("double").alias(b) for b in bands])
    return wide.unpivot(keys, bands, "band", value)


def grid(spark: SparkSession, height: int, width: int, times: int) -> DataFrame:
    """All (t, y, x) slots, by arithmetic on a range."""
    n = height * width * times
    return spark.range(n).select(
        F.expr(f"CAST(id % {times} AS INT)").alias("t"),
        F.expr(f"CAST(id div {times * width} AS INT)").alias("y"),
        F.expr(f"CAST((id div {times}) % {width} AS INT)").alias("x"),
    )


def densify(cube: DataFrame, height: int, width: int, times: int, fill: int = 255) -> DataFrame:
    """Every slot of the grid; unobserved ones have NULL bands and the fill code."""
    slots = grid(cube.sparkSession, height, width, times)
    return slots.join(cube, ["t", "y", "x"], "left").withColumn(
        "usability", F.coalesce("usability", F.lit(fill)).cast("smallint")
    )


def with_band_metadata(cube: DataFrame, c: CubeConfig) -> DataFrame:
    """Band name, centre range and mask legend as column metadata, kept by Parquet."""
    out = cube
    for b, name in zip(c.bands, band_columns(c)):
        out = out.withMetadata(
            name,
            {"long_name": BAND_NAMES[b - 1], "wavelength_nm": BAND_WAVELENGTHS_NM[b - 1], "units": "1"},
        )
    return out.withMetadata("usability", {"usability_mask_key": MASK_LEGEND})


def cube_attrs(days: DataFrame, tiles: DataFrame, c: CubeConfig) -> DataFrame:
    """Descriptive attributes as rows (scope, key, value).

    Days and tiles are joined into text; both are bounded by calendar and tile grid.
    """
    spark = days.sparkSession
    fixed = [
        ("global", "Conventions", "CF-1.11"),
        ("global", "usability_mask_key", MASK_LEGEND),
        ("time", "standard_name", "time"),
        ("y", "standard_name", "projection_y_coordinate"),
        ("y", "units", "m"),
        ("x", "standard_name", "projection_x_coordinate"),
        ("x", "units", "m"),
        ("band", "band_names", ", ".join([BAND_NAMES[b - 1] for b in c.bands] + ["Usability Mask"])),
        (
            "band",
            "band_wavelengths_nm",
            ", ".join([BAND_WAVELENGTHS_NM[b - 1] + " nm" for b in c.bands] + ["N/A"]),
        ),
        ("reflectance_and_mask", "units", "1"),
        ("reflectance_and_mask", "grid_mapping", "sinusoidal"),
        *[("global", k, str(v)) for k, v in c.attrs.items()],
    ]
    distinct_days = days.select(F.date_format("date", "yyyyDDD").alias("d")).distinct()
    day_attrs = distinct_days.agg(
        F.array_join(F.array_sort(F.collect_list("d")), ",").alias("included_days"),
        F.count("*").cast("string").alias("total_days_processed"),
    ).unpivot([], ["included_days", "total_days_processed"], "key", "value")
    tile_attrs = (
        tiles.select("tile")
        .distinct()
        .agg(F.array_join(F.array_sort(F.collect_list("tile")), ",").alias("source_tiles"))
        .unpivot([], ["source_tiles"], "key", "value")
    )
    measured = day_attrs.unionByName(tile_attrs).select(F.lit("global").alias("scope"), "key", "value")
    return spark.createDataFrame(fixed, CUBE_ATTRS).unionByName(measured)


def cube_stats(cube: DataFrame) -> DataFrame:
    """Number of mosaics in the cube and of its frames."""
    return cube.agg(
        F.countDistinct("date").alias("complete_mosaics"),
        F.countDistinct("t").alias("days_in_cube"),
    )

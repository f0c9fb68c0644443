"""Raster tables that Spark derives from the given star-schema tables.

The grid grows with the data: every block of 2048 order keys adds a strip of
8 rows by 64 columns, and each month is one of 12 frames. Granules are one per
order, and the tiled observations use real 2400 by 2400 tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import CubeConfig
from gridloom.functions.quality import clean_band, usability
from gridloom.schemas import BANDS

WIDTH = 64
STRIP_ROWS = 8
STRIP_ORDERS = 2048
FRAMES = 12
PATCH = 8
WINDOW = 4

# Per band, the price offset, the hash period and the fill period.
BAND_PATTERN = {
    1: (997, 400, 97),
    2: (1994, 700, 89),
    3: (2991, 500, 83),
    4: (3988, 600, 79),
    5: (4985, 800, 73),
    6: (5982, 900, 71),
    7: (6979, 1000, 67),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash():
    return F.expr(
        "((l_partkey % 1000003) * 2654435761 + l_orderkey * 40503 + l_linenumber * 97) % 2147483647"
    )


def _words(df: DataFrame) -> DataFrame:
    """State word, quality word and seven digital numbers from hash ``h`` and price ``p``."""
    state = (
        F.when(F.col("h") % 100 < 75, 0)
        .when(F.col("h") % 100 < 85, 1)
        .when(F.col("h") % 100 == 99, 65535)
        .otherwise((F.shiftright("h", 8) % 16384).cast("int"))
    )
    qc = F.when(F.col("h") % 10 < 8, F.lit(0).cast("bigint")).otherwise(F.col("h") % 1073741824)
    out = df.withColumns({"state": state.cast("int"), "qc": qc})
    return out.withColumns(
        {
            f"r{b}": F.when(F.col("h") % fill == 0, -28672)
            .otherwise((F.col("p") + off + F.col("h") % period) % 16001 - 100)
            .cast("int")
            for b, (off, period, fill) in BAND_PATTERN.items()
        }
    )


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            (F.month("l_shipdate") - 1).cast("int").alias("t"),
            F.expr(
                f"CAST((l_orderkey div {STRIP_ORDERS}) * {STRIP_ROWS} + l_partkey % {STRIP_ROWS} AS INT)"
            ).alias("y"),
            F.expr(f"CAST((l_suppkey * 7 + l_orderkey) % {WIDTH} AS INT)").alias("x"),
        )
        .agg(
            F.max(_hash()).alias("h"),
            F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("p"),
        )
    )
    return _words(slots)


def grid_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return (top // STRIP_ORDERS + 1) * STRIP_ROWS, WIDTH


def cube(spark: SparkSession, sf_dir: str, c: CubeConfig = CubeConfig()) -> DataFrame:
    """Cleaned cube, one row per observed cell and frame."""
    return pix(spark, sf_dir).select(
        "t",
        "y",
        "x",
        *[
            clean_band(F.col(f"r{b}"), F.col("qc"), b, c).alias(name)
            for b, name in enumerate(BANDS, start=1)
        ],
        usability(F.col("state"), c.state_fill, c.mask_fill).alias("usability"),
    )


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        F.expr(
            f"CAST((l_orderkey div {STRIP_ORDERS}) * {STRIP_ROWS} + l_partkey % {STRIP_ROWS} AS INT)"
        ).alias("y"),
        F.expr(f"CAST((l_suppkey * 7 + l_orderkey) % {WIDTH} AS INT)").alias("x"),
    )
    lc = F.expr("10 * (1 + (shiftright(y, 2) * 7 + shiftright(x, 2) * 3 + (x % 5) % 2) % 8)")
    return cells.distinct().select("y", "x", lc.cast("smallint").alias("lc"))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing entry per order; every 97th has a name that is no granule."""
    day = F.expr("date_add(DATE'1995-01-01', CAST((o_orderkey div 5) % 20000 AS INT))")
    name = F.when(
        F.col("o_orderkey") % 97 == 0, F.concat(F.lit("README_"), F.col("o_orderkey"))
    ).otherwise(
        F.concat(
            F.lit("MOD09GA.A"),
            F.year(day),
            F.lpad(F.dayofyear(day).cast("string"), 3, "0"),
            F.lit(".h"),
            18 + F.col("o_orderkey") % 2,
            F.lit("v0"),
            3 + F.col("o_custkey") % 2,
            F.lit(".061."),
            F.lpad(F.col("o_orderkey").cast("string"), 13, "0"),
            F.lit(".hdf"),
        )
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), name.alias("name"), (F.col("o_orderkey") % 50).alias("size")
    )


def obs_500m(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(
                F.lit("h"), 18 + F.col("l_orderkey") % 2, F.lit("v0"), 3 + F.col("l_partkey") % 2
            ).alias("tile"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.expr("CAST(l_orderkey % 2400 AS INT)").alias("row"),
            F.expr("CAST(l_partkey % 2400 AS INT)").alias("col"),
        )
        .agg(
            F.max(_hash()).alias("h"),
            F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("p"),
        )
    )
    return _words(cells)


def obs_1km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse state words; every eleventh coarse row is missing."""
    return (
        obs_500m(spark, sf_dir)
        .groupBy("tile", "date", F.expr("row div 2").cast("int").alias("row"), F.expr("col div 2").cast("int").alias("col"))
        .agg(F.max("state").alias("state"))
        .filter("row % 11 <> 0")
    )


def landcover_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-cover cells of half a degree on three-degree tiles, some listed by two files."""
    o = table(spark, sf_dir, "orders")
    lat = F.expr("39 + 3 * ((o_orderkey div 12) % 8)")
    lon = F.expr("3 * (o_custkey % 20)")
    cells = o.select(
        F.expr("CAST(o_orderkey % 3 AS INT)").alias("tile_order"),
        lat.cast("int").alias("tile_lat"),
        lon.cast("int").alias("tile_lon"),
        F.expr("CAST(o_orderkey % 6 AS INT)").alias("src_row"),
        F.expr("CAST((o_custkey div 20) % 6 AS INT)").alias("src_col"),
        F.expr("CAST(10 * ((o_orderkey + o_custkey) % 9) AS INT)").alias("lc"),
    )
    keys = ["tile_order", "tile_lat", "tile_lon", "src_row", "src_col"]
    return cells.groupBy(*keys).agg(F.max("lc").alias("lc"))


def landcover_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping, partly rotated rasters on grids of their own: one per 512 order keys."""
    sources = table(spark, sf_dir, "orders").select(F.expr("CAST(o_orderkey div 512 AS INT)").alias("tile_order")).distinct()
    return sources.selectExpr(
        "tile_order",
        "0.5D AS ax", "0.125D * (tile_order % 3) AS bx", "CAST((tile_order * 11) % 29 AS DOUBLE) - 2 AS x0",
        "-0.125D * (tile_order % 2) AS ay", "-0.5D AS by", "42 + 0.25D * ((tile_order * 7) % 83) AS y0",
        "8 AS n_rows", "8 + tile_order % 5 AS n_cols",
    )


def landcover_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of ``landcover_rasters``; some are missing."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.expr("CAST(o_orderkey div 512 AS INT)").alias("tile_order"),
            F.expr("CAST(o_orderkey % 8 AS INT)").alias("src_row"),
            F.expr("CAST(o_custkey % 12 AS INT)").alias("src_col"),
        )
        .agg(F.max(F.expr("CAST(10 * ((o_orderkey + o_custkey) % 9) AS INT)")).alias("lc"))
    )


def patch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.expr("concat('m', CAST(l_linenumber % 3 AS STRING))").alias("model"),
            F.expr(f"CAST({PATCH} * (l_orderkey div {STRIP_ORDERS}) AS INT)").alias("y_coord"),
            F.expr(f"CAST({PATCH} * (((l_suppkey * 7 + l_orderkey) % {WIDTH}) div {PATCH}) AS INT)").alias("x_coord"),
            F.expr(f"CAST({WINDOW} * (l_suppkey % 3) AS INT)").alias("t_start"),
        )
        .agg(
            F.sum("l_partkey").alias("a"),
            F.sum(F.expr("l_suppkey + l_linenumber")).alias("b"),
            F.sum(F.expr("l_linenumber * 31 + l_partkey")).alias("c"),
        )
    )
    rmse = F.lit(0.01) + (F.col("a") % 500) / F.lit(5000.0)
    return sums.select(
        "model",
        "y_coord",
        "x_coord",
        "t_start",
        rmse.alias("rmse"),
        (F.lit(20.0) * F.log10(F.lit(1.0) / rmse)).alias("psnr"),
        (F.lit(1.0) - (F.col("b") % 300) / F.lit(1000.0)).alias("ssim"),
        ((F.col("c") % 700) / F.lit(2000.0)).alias("sam"),
    )


def patch_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch table with the three parts of the index, for the report operators.

    Values repeat often, so that ranking has ties to break.
    """
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.expr(f"CAST({PATCH} * (l_orderkey div {STRIP_ORDERS}) AS INT)").alias("y_coord"),
            F.expr(f"CAST({PATCH} * (((l_suppkey * 7 + l_orderkey) % {WIDTH}) div {PATCH}) AS INT)").alias("x_coord"),
        )
        .agg(F.sum("l_partkey").alias("a"), F.sum("l_suppkey").alias("b"), F.count("*").alias("n"))
    )
    h = (F.col("a") % 20) / F.lit(10.0)
    v = (F.col("b") % 7) / F.lit(100.0)
    p = F.when(F.col("n") % 3 == 0, F.lit(0.0)).otherwise((F.col("n") % 40) / F.lit(80.0))
    return sums.select(
        "y_coord",
        "x_coord",
        h.alias("heterogeneity"),
        v.alias("phenology_variability"),
        p.alias("cloud_persistence"),
        (h * 0.165 + v * 5.5 + p * 0.66).alias("difficulty_index"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.expr("CAST(8 * power(2, user_id % 5) AS INT)").alias("gpus"),
        F.expr("CAST(event_id % 5 AS INT)").alias("repeat_id"),
        F.expr("1 + event_id % 60").alias("samples"),
        (F.abs("value") + F.lit(0.1)).alias("elapsed"),
    )


def predictions(spark: SparkSession, sf_dir: str, bands: int = 6) -> DataFrame:
    """Two models' predictions for every observed cell: pred, target and validity per band."""
    cells = pix(spark, sf_dir).withColumn(
        "_m", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.lit(1).alias("k")),
                                F.struct(F.lit("b").alias("model"), F.lit(5).alias("k"))))
    )
    target = {b: (F.col(f"r{b}") + 100) / F.lit(16100.0) for b in range(1, bands + 1)}
    ok = {b: F.col(f"r{b}") > -28672 for b in range(1, bands + 1)}
    return cells.select(
        F.col("_m.model").alias("model"),
        F.expr(f"CAST(y div {PATCH} * {PATCH} AS INT)").alias("y_coord"),
        F.expr(f"CAST(x div {PATCH} * {PATCH} AS INT)").alias("x_coord"),
        "t",
        "y",
        "x",
        *[F.when(ok[b], target[b]).otherwise(F.lit(0.0)).alias(f"target_b0{b}") for b in target],
        *[
            F.when(
                ok[b],
                target[b] + ((F.col("h") * F.col("_m.k") + b) % 21 - 10) / F.lit(1000.0),
            )
            .otherwise(F.lit(0.0))
            .alias(f"pred_b0{b}")
            for b in target
        ],
        *[((F.col("state") == 0) & ok[b]).alias(f"valid_b0{b}") for b in target],
    )

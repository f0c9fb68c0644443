"""Patch keys, patch dimension, dominant class, stratified choice, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.ranking import digest


def with_patch(
    df: DataFrame, patch: int, height: int | None = None, width: int | None = None
) -> DataFrame:
    """Top-left pixel of each cell's patch; with a grid shape, cut-off blocks are trimmed.

    The patch size is recorded with the keys. A table stored with keys of this size
    keeps them, and with them its bucketing; keys of another size are refused, and
    keys without a recorded size are computed again.
    """
    out, keys = df, ("y_coord", "x_coord")
    sizes = {df.schema[k].metadata.get("patch") for k in keys if k in df.columns}
    if sizes - {None, patch}:
        raise ValueError(f"the table has keys of patch {(sizes - {None, patch}).pop()}, not {patch}")
    if sizes != {patch} or not set(keys) <= set(df.columns):
        out = df.withColumns({k: F.expr(f"CAST({k[0]} div {patch} * {patch} AS INT)") for k in keys})
        for k in keys:
            out = out.withMetadata(k, {"patch": patch})
    if height is not None:
        out = out.filter(F.col("y") < height // patch * patch)
    if width is not None:
        out = out.filter(F.col("x") < width // patch * patch)
    return out


def patch_grid(spark: SparkSession, height: int, width: int, patch: int) -> DataFrame:
    """All full patches of a grid, by arithmetic on a range."""
    ny, nx = height // patch, width // patch
    return spark.range(ny * nx).select(
        F.expr(f"CAST(id div {max(nx, 1)} * {patch} AS INT)").alias("y_coord"),
        F.expr(f"CAST(id % {max(nx, 1)} * {patch} AS INT)").alias("x_coord"),
    )


def dominant_class(landcover: DataFrame, patch: int, height=None, width=None) -> DataFrame:
    """Most frequent class per patch, the smallest id on ties. Counts are partial sums."""
    counts = (
        with_patch(landcover, patch, height, width)
        .groupBy("y_coord", "x_coord", "lc")
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy("y_coord", "x_coord").agg(
        F.max_by("lc", F.struct("n", -F.col("lc"))).alias("class")
    )


def stratified_patches(dominant: DataFrame, classes: list[int], n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` patches per listed class in seeded order.

    The row-number filter is a group limit on the map side, so a class that
    covers most of the region sends at most ``n`` patches per task.
    """
    order = digest("patches", ["y_coord", "x_coord"], seed)
    rank = F.row_number().over(W.partitionBy("class").orderBy(order, "y_coord", "x_coord"))
    return (
        dominant.filter(F.col("class").isin(classes))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= n)
        .select(F.col("y_coord").alias("y"), F.col("x_coord").alias("x"), "class")
    )


def patch_coords(
    patches: DataFrame, patch: int, origin_y: float, origin_x: float, cell: float
) -> DataFrame:
    """Mean projected coordinate of each patch beside its top-left pixel.

    The mean over a full patch of an affine grid is its centre.
    """
    half = patch / 2.0
    return patches.withColumns(
        {
            "geo_y": F.lit(origin_y) - (F.col("y_coord") + half) * F.lit(cell),
            "geo_x": F.lit(origin_x) + (F.col("x_coord") + half) * F.lit(cell),
        }
    )


def enumerate_windows(
    spark: SparkSession, height: int, width: int, times: int, patch: int, window: int
) -> DataFrame:
    """Every (patch, start) pair, start fastest, then column, then row."""
    starts = times - window + 1
    if starts < 1:
        raise ValueError("fewer frames than the window needs")
    ny, nx = height // patch, width // patch
    return spark.range(ny * nx * starts).select(
        F.col("id").alias("idx"),
        F.expr(f"CAST(id % {starts} AS INT)").alias("t_start"),
        F.expr(f"CAST(id div {starts} div {max(nx, 1)} * {patch} AS INT)").alias("y_coord"),
        F.expr(f"CAST(id div {starts} % {max(nx, 1)} * {patch} AS INT)").alias("x_coord"),
    )


def extract(cube: DataFrame, patches: DataFrame, patch: int) -> DataFrame:
    """All cells of the listed patches (columns y, x, class of the patch's top-left).

    Mark a short list with ``broadcast``, and the cube is filtered where it is read.
    """
    listed = patches.select(
        F.col("y").alias("y_coord"), F.col("x").alias("x_coord"), F.col("class")
    )
    return with_patch(cube, patch).join(listed, ["y_coord", "x_coord"])

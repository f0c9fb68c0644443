"""Readers and writers of cubes, land cover, metrics, splits and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import LAND_COVER, MASK_CODES
from gridloom.operators.patches import with_patch
from gridloom.schemas import LC_DIM, MASK_DIM
from gridloom.sources.listing import stored_files


def lc_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAND_COVER, LC_DIM)


def mask_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MASK_CODES.items()), MASK_DIM)


def with_storage_keys(cube: DataFrame, patch: int, chunk: int) -> DataFrame:
    """Chunk and patch numbers; the two sizes are recorded with the patch numbers."""
    keyed = cube.withColumns(
        {
            "cy": F.expr(f"y div {chunk}").cast("int"),
            "cx": F.expr(f"x div {chunk}").cast("int"),
            "py": F.expr(f"y div {patch}").cast("int"),
            "px": F.expr(f"x div {patch}").cast("int"),
        }
    )
    return keyed.withMetadata("py", {"patch": patch, "chunk": chunk}).withMetadata("px", {"patch": patch, "chunk": chunk})


def write_cube(
    cube: DataFrame,
    path: str,
    patch: int = 224,
    chunk: int = 1024,
    fmt: str = "parquet",
    compression: str = "zstd",
    placed: bool = False,
) -> None:
    """Chunk-partitioned columnar cube, the frames of a patch next to each other.

    Rows are rebalanced by chunk: small chunks share a write task, and a chunk
    above the session's advisory partition size is split over several, so files
    come out even however full a chunk is. Rows already ``placed`` by chunk
    (``cube.build_chunks``) are written where they lie.
    """
    unit = ["cy", "cx", "py", "px"]
    rows = with_storage_keys(cube, patch, chunk)
    if not placed:
        rows = rows.hint("rebalance", F.col("cy"), F.col("cx"))
    (
        rows.sortWithinPartitions(*unit, "t", "y", "x")
        .write.mode("overwrite")
        .partitionBy("cy", "cx")
        .option("compression", compression)
        .format(fmt)
        .save(path)
    )


def save_cube_table(
    cube: DataFrame, table: str, patch: int = 224, buckets: int = 200, path: str | None = None
) -> None:
    """The cube as a table bucketed and sorted by patch.

    Operators that place cells by patch then read it without any exchange when
    called with ``placed=True``. Choose ``buckets`` so that one bucket, sorted,
    suits one task.
    """
    keys = ["y_coord", "x_coord"]
    writer = (
        with_patch(cube, patch)
        .repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_cube(
    spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None,
    patch: int | None = None, chunk: int | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Lazy cube scan. ``box`` (y0, x0, y1, x1; ends excluded) prunes chunk
    directories first and row groups by their patch statistics next.

    Patch and chunk are those the cube was written with. Formats that keep no
    record of them (ORC) prune only if they are given here; others refuse a mismatch.
    """
    cube = spark.read.format(fmt).load(path)
    if box is None:
        return cube
    kept = cube.schema["py"].metadata
    for name, given in (("patch", patch), ("chunk", chunk)):
        if given is not None and kept.get(name, given) != given:
            raise ValueError(f"the cube was written with {name} {kept[name]}, not {given}")
    patch, chunk = kept.get("patch", patch), kept.get("chunk", chunk)
    y0, x0, y1, x1 = box
    inside = (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
    for size, rows, columns in ((chunk, "cy", "cx"), (patch, "py", "px")):
        if size is not None:
            inside = (
                F.col(rows).between(y0 // size, (y1 - 1) // size) & F.col(columns).between(x0 // size, (x1 - 1) // size) & inside
            )
    return cube.filter(inside)


def scan_landcover(spark: SparkSession, pattern: str) -> DataFrame:
    """Land-cover tiles matching a path pattern; ``tile_order`` follows the path.

    An unmatched pattern is an error.
    """
    try:
        return spark.read.parquet(pattern).withColumn("tile_order", F.col("_metadata.file_path"))
    except AnalysisException as e:
        raise FileNotFoundError(f"no land-cover tiles match {pattern}") from e


def scan_patch_metrics(spark: SparkSession, root: str, prefixes: dict[str, str], schema: str) -> DataFrame:
    """Detailed metric files anywhere below ``root``; per model the first path counts.

    ``prefixes`` maps the display name to the file-name prefix; models without
    a file are left out. A hit is one CSV file or one folder of part files.
    Only file names are looked at to choose, and at most one path per given
    model comes to the driver.
    """
    pattern = r"^(.*/([^/]+)_detailed_patch_metrics(?:\.csv)?)(?:/|$)"
    hits = stored_files(spark, root).select(
        F.regexp_extract("path", pattern, 1).alias("hit"),
        F.regexp_extract("path", pattern, 2).alias("prefix"),
    )
    wanted = hits.filter(F.col("prefix").isin(list(prefixes.values())))
    first = {r["prefix"]: r["hit"] for r in wanted.groupBy("prefix").agg(F.min("hit").alias("hit")).collect()}
    found = [
        spark.read.csv(first[prefix], header=True, schema=schema).withColumn("model", F.lit(name))
        for name, prefix in prefixes.items()
        if prefix in first
    ]
    if not found:
        raise FileNotFoundError(f"no detailed patch metrics below {root}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: Characters of a model name that file names do not keep, and what stands for the first of them; the others go.
NOT_IN_FILES, INSTEAD = " ()", "_"


def safe_name(name):
    """File-name form of a model name: blanks to underscores, parentheses dropped."""
    return F.translate(name, NOT_IN_FILES, INSTEAD)


def file_name(name: str) -> str:
    kept = len(INSTEAD)
    return name.translate(str.maketrans(NOT_IN_FILES[:kept], INSTEAD, NOT_IN_FILES[kept:]))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_by(df: DataFrame, path: str, *keys: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per key value: rasters per band, indices per split."""
    df.write.mode(mode).partitionBy(*keys).format(fmt).save(path)

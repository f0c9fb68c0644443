"""Row numbers over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.workspace import cut

# Digits of a digest that make a bucket (4096 of them) and a draw.
BUCKET_DIGITS, DRAW_DIGITS = 3, 7


def digest(purpose: str, cols: list[str], seed: int = 0, epoch: int = 0) -> Column:
    """Seeded hex digest of any number of columns; another purpose, seed or epoch gives an unrelated one.

    Its text gives a random order, and ``draw`` up to four independent numbers.
    """
    parts = [F.lit(purpose), F.lit(str(seed)), F.lit(str(epoch))]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def draw(hexes: Column, part: int, n: int) -> Column:
    """Number in 0 .. n - 1 from the digits of one of four parts of a digest."""
    digits = F.substring(hexes, 1 + part * DRAW_DIGITS, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") % F.lit(n)


def hash_rank(
    df: DataFrame, cols: list[str], seed: int = 0, epoch: int = 0,
    by: list[str] = (), name: str = "rank", total: str | None = None, purpose: str = "order",
) -> DataFrame:
    """Position 1..n in the seeded random order of a digest, ties by ``cols``, per ``by`` group.

    Bucket sizes come first (partial counts, at most 4096 rows per group),
    their running sum gives each bucket's offset, and rows are numbered inside
    their bucket. No task sees more than one bucket of one group. ``df`` is
    read twice, so it should be cheap to produce or already written.
    """
    by = list(by)
    keyed = df.withColumn("_digest", digest(purpose, cols, seed, epoch))
    keyed = keyed.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    # at most 4096 rows per group from here on
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(
        *by,
        "_bucket",
        (F.sum("_size").over(before) - F.col("_size")).alias("_before"),
        F.sum("_size").over(group).alias("_total"),
    )
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_digest", *cols))
    ranked = (
        keyed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_digest", "_bucket", "_inside", "_before", "_total")


def ordered_rank(
    df: DataFrame, order: list[str], by: list[str] = (), name: str = "rank", total: str = "n"
) -> DataFrame:
    """Exact position 1..n by the columns ``order`` per ``by`` group, and group size.

    ``by`` and ``order`` together should identify a row: then the range
    partitioning splits a value shared by very many rows as well. The sorted
    rows are written once, so both passes below see the same partitions; the
    number of (group, partition) pairs is at most partitions plus groups.
    """
    by = list(by)
    sorted_rows = df.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id())
    fixed = cut(sorted_rows, "sorted").withColumn("_part", F.shiftright("_id", 33))
    runs = fixed.groupBy(*by, "_part").agg(
        F.count("*").alias("_size"), F.min("_id").alias("_first")
    )
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = runs.select(
        *by,
        "_part",
        "_first",
        (F.sum("_size").over(before) - F.col("_size")).alias("_before"),
        F.sum("_size").over(group).alias(total),
    )
    return (
        fixed.join(F.broadcast(offsets), [*by, "_part"])
        .withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_part", "_first", "_before")
    )


def tercile(rank: Column, n: Column) -> Column:
    """Low, Medium or High from a rank among ``n`` rows; exact edges fall upward."""
    step = 3 * (rank - 1)
    return (
        F.when((rank == 1) | (step < n - 1), "Low")
        .when(step < 2 * (n - 1), "Medium")
        .otherwise("High")
    )

"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.workspace import cut, discard


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node of column ``a`` the smallest of itself and its neighbours ``b``."""
    return pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node (``root``) of each ``node`` that has a link, from columns ``a`` and ``b``.

    Links may repeat, point either way, or join a node to itself; those with NULL are ignored. Each round hangs the
    larger neighbours of every node under the smallest one it sees, then all smaller ones likewise; the number of
    links never grows, and the rounds end when every tree is a star. A hub's links are combined on the map side and
    its join partition can be split. Every round is written to the shared folder, so lineage stays short; only
    two numbers per round reach the driver.
    """
    tree = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    tree, before = cut(tree, "links"), None
    while True:
        both = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node hang under its smallest neighbour
        large = (
            both.join(_smallest(both), "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        )
        # small star: a node and its smaller neighbours hang under the smallest of them
        least = _smallest(large)
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()
        )
        older, tree = tree, cut(small, "links")
        discard(older)
        state = tree.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == state:
            break
        before = state
    return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        tree.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

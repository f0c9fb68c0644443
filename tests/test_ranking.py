import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ranking, reports


@pytest.mark.parametrize("n, want", [(3, "LMH"), (4, "LMHH"), (5, "LLMHH"), (7, "LLMMHHH")])
def test_terciles(spark, n, want):
    rows = spark.range(1, n + 1).select("id", ranking.tercile(F.col("id"), F.lit(n)).alias("s")).orderBy("id")
    assert "".join(r.s[0] for r in rows.collect()) == want


def _hot(n=3000):
    rng = random.Random(1)
    # a third of all rows share one value
    return [(i % 7, 0.25 if i % 3 == 0 else round(rng.random(), 2), i) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_ordered_rank_is_exact_with_a_hot_value(spark, partitions):
    rows = _hot()
    df = spark.createDataFrame(rows, "g INT, v DOUBLE, id INT").repartition(partitions)
    got = {r.id: (r["rank"], r.n) for r in ranking.ordered_rank(df, ["v", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {r[2]: (i + 1, len(rows)) for i, r in enumerate(order)}


def test_ordered_rank_per_group(spark):
    rows = _hot(500)
    df = spark.createDataFrame(rows, "g INT, v DOUBLE, id INT").repartition(6)
    got = {r.id: (r["rank"], r.n) for r in ranking.ordered_rank(df, ["v", "id"], by=["g"]).collect()}
    for g in range(7):
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in members] == [(i + 1, len(members)) for i in range(len(members))]


def test_hot_value_is_spread_over_partitions(spark):
    df = spark.createDataFrame(_hot(), "g INT, v DOUBLE, id INT")
    parts = df.repartitionByRange(8, "v", "id").filter("v = 0.25").select(F.spark_partition_id()).distinct()
    assert parts.count() > 1


@pytest.mark.parametrize("partitions", [1, 9])
def test_hash_rank(spark, partitions):
    rows = [(y * 8, x * 8) for y in range(21) for x in range(21)]
    df = spark.createDataFrame(rows, "y INT, x INT").repartition(partitions)
    got = {(r.y, r.x): r["rank"] for r in ranking.hash_rank(df, ["y", "x"], 42, total="n").collect()}
    key = lambda r: (hashlib.md5(f"order|42|0|{r[0]}|{r[1]}".encode()).hexdigest(), r)
    assert got == {r: i + 1 for i, r in enumerate(sorted(rows, key=key))}


def test_terciles_follow_the_stacking_order_of_models_on_ties(spark):
    rows = [(m, y, 0.5) for m in ("b", "a", "c") for y in range(2)]
    df = spark.createDataFrame(rows, "model STRING, y_coord INT, v DOUBLE").withColumn("stratum", F.lit("old"))
    got = reports.with_terciles(df, "v", ["y_coord"], ["c", "b", "a"]).collect()
    assert {(r.model, r.y_coord): r.stratum[0] for r in got} == {
        ("c", 0): "L", ("c", 1): "L", ("b", 0): "M", ("b", 1): "M", ("a", 0): "H", ("a", 1): "H",
    }


def test_digest_takes_any_number_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 5), (1, 2, 3, None)], "a INT, b INT, c INT, d INT")
    assert df.select(ranking.digest("order", ["a", "b", "c", "d"])).distinct().count() == 3
    assert len(ranking.hash_rank(df, ["a", "b", "c", "d"]).collect()) == 3

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.spectral import safe_div
from gridloom.operators import reports, runs
from gridloom.sources import tables

SCORES = "model STRING, y_coord INT, x_coord INT, rmse DOUBLE, psnr DOUBLE, ssim DOUBLE, sam DOUBLE"


def _scores(spark):
    rows = [("a", 0, 0, 0.1, 20.0, 0.9, 0.1), ("a", 8, 0, 0.3, 10.0, 0.7, 0.3), ("b", 0, 0, 0.0, 99.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, SCORES)


def test_psnr_follows_from_the_mean_rmse(spark):
    got = {r.model: r for r in reports.overall(_scores(spark)).collect()}
    assert got["a"].psnr == pytest.approx(20 * math.log10(1 / 0.2)) and got["a"].rmse == pytest.approx(0.2)
    assert got["b"].psnr == float("inf")
    final = {r.model: r.psnr for r in reports.overall_table(_scores(spark)).collect()}
    assert final["b"] == 99.0 and final["a"] == pytest.approx(20 * math.log10(1 / 0.2))


def test_only_present_strata_are_reported(spark):
    merged = _scores(spark).withColumn("stratum", F.lit("Low")).withColumn("cloud_stratum", F.when(F.col("y_coord") == 0, "High"))
    rows = reports.by_strata(merged).collect()
    assert {(r.report, r.stratum, r.model) for r in rows} == {
        ("Overall Difficulty", "Low", "a"), ("Overall Difficulty", "Low", "b"),
        ("Cloud Persistence", "High", "a"), ("Cloud Persistence", "High", "b"),
    }


def test_display_order_skips_absent_pairs(spark):
    rows = [("High", "a"), ("Low", "b"), ("Low", "a"), ("Medium", "x"), ("odd", "a")]
    df = spark.createDataFrame(rows, "stratum STRING, model STRING")
    got = [tuple(r) for r in reports.display_order(df, ["b", "a", "gone"]).collect()]
    assert got == [("Low", "b"), ("Low", "a"), ("High", "a")]


def test_stacking(spark):
    stacked = reports.stack_models({"One": _scores(spark).drop("sam"), "Two": _scores(spark)})
    assert {(r.model, r["count"]) for r in stacked.groupBy("model").count().collect()} == {("One", 3), ("Two", 3)}
    assert stacked.filter("sam IS NULL").count() == 3
    with pytest.raises(ValueError):
        reports.stack_models({})


def test_names(spark):
    row = spark.range(1).select(tables.safe_name(F.lit("Full (FT) x")).alias("n")).first()
    assert row.n == tables.file_name("Full (FT) x") == "Full_FT_x"


def test_top_per_stratum(spark):
    df = spark.range(900).select(F.col("id").alias("seq"), F.element_at(F.array(F.lit("Low"), F.lit("High"), F.lit("Unknown")), (F.col("id") % 3 + 1).cast("int")).alias("stratum"))
    top = reports.top_per_stratum(df, 2)
    assert sorted((r.stratum, r.seq) for r in top.collect()) == [("High", 1), ("High", 4), ("Low", 0), ("Low", 3)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_stretch_matches_numpy_and_leaves_flat_pictures(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(0.4, 0.3, (30, 3))
    rows = [(0, i, *map(float, v)) for i, v in enumerate(values)] + [(1, i, 0.7, 0.7, 0.7) for i in range(4)]
    df = spark.createDataFrame(rows, "s INT, i INT, red DOUBLE, green DOUBLE, blue DOUBLE")
    bounds = reports.stretch_bounds(df, ["s"])
    got = reports.stretch(df, bounds, ["s"]).orderBy("s", "i").collect()
    p2, p98 = np.percentile(values, [2, 98])
    np.testing.assert_allclose([(r.red, r.green, r.blue) for r in got[:30]], np.clip((values - p2) / (p98 - p2), 0, 1))
    assert [r.red for r in got[30:]] == [0.7] * 4


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (None, 2.0)], "a DOUBLE, b DOUBLE")
    rows = df.select(safe_div(F.col("a"), F.col("b")).alias("n"), safe_div(F.col("a"), F.col("b"), 0.0).alias("z")).collect()
    assert [r.n for r in rows] == [0.5, None, None, None] and [r.z for r in rows] == [0.5, 0.0, 0.0, 0.0]


def test_scaling_against_the_base_run_or_linear(spark):
    rows = [("a", 8, 0, 30, 1.0), ("a", 8, 0, 30, 2.0), ("a", 8, 1, 40, 2.0), ("a", 16, 0, 100, 2.0), ("b", 32, 0, 80, 2.0)]
    df = spark.createDataFrame(rows, "model STRING, gpus INT, repeat_id INT, samples BIGINT, elapsed DOUBLE")
    got = {(r.model, r.gpus): r for r in runs.scaling(df).collect()}
    assert got["a", 8].throughput_total == pytest.approx(25.0) and got["a", 8].std == pytest.approx(5.0)
    assert got["a", 16].speedup == pytest.approx(2.0) and got["a", 16].efficiency_pct == pytest.approx(100.0)
    assert got["b", 32].speedup == pytest.approx(4.0) and got["b", 32].throughput_per_gpu == pytest.approx(1.25)


def test_epochs(spark):
    steps = spark.createDataFrame([("m", e, r, 1.0 + e) for e in (0, 1) for r in (0, 1) for _ in range(3)], "model STRING, epoch INT, rank INT, loss DOUBLE")
    durations = spark.createDataFrame([("m", 0, 12, 3, 4.0), ("m", 1, 12, 3, 2.0)], "model STRING, epoch INT, samples INT, batches INT, seconds DOUBLE")
    got = runs.epochs(steps, durations, 2).orderBy("epoch").collect()
    assert [(r.loss, r.throughput, r.speedup) for r in got] == [(1.0, 3.0, 1.0), (2.0, 6.0, 2.0)]


def test_format_comparison(spark):
    rows = [("nc", 0, 10.0, 4.0, 5.0), ("zr", 0, 8.0, 2.0, 10.0), ("zr", 4, 8.0, None, 30.0)]
    df = spark.createDataFrame(rows, "format STRING, workers INT, size_mb DOUBLE, write_seconds DOUBLE, read_mb_per_s DOUBLE")
    r = runs.compare_formats(df, "nc", "zr", 4).first()
    assert tuple(r) == pytest.approx((2.0, 0.8, 2.0, 3.0, 75.0))


def test_quantiles_by_rank_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.random(101), "b": np.round(rng.random(50), 1), "c": np.array([2.0]), "d": np.repeat([1.0, 3.0], 40)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    found = reports.rank_quantiles(spark.createDataFrame(rows, "g STRING, v DOUBLE"), ["g"], "v", {"p2": 0.02, "p50": 0.5, "p98": 0.98})
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.g: (r.p2, r.p50, r.p98) for r in found.collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.02, 0.5, 0.98])))


def test_all_tables_from_one_aggregate(spark):
    merged = _scores(spark).withColumn("stratum", F.lit("Low")).withColumn("cloud_stratum", F.when(F.col("y_coord") == 0, "High"))
    found = reports.report_tables(merged)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    rows = [tuple(r) for r in found.collect()]
    strata = [tuple(r) for r in reports.by_strata(merged).select("report", "stratum", "model", "rmse", "psnr", "ssim", "sam").collect()]
    overall = [("Overall", None, *r) for r in reports.overall(merged).select("model", "rmse", "psnr", "ssim", "sam").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, strata + overall))

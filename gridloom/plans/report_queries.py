"""Stratified report and run report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.spectral import safe_div
from gridloom.operators import impute, intrinsic, reports, runs
from gridloom.plans import sample_queries as sq
from gridloom.plans import score_queries as scores
from gridloom.plans.ctes import r6 as q6
from gridloom.plans.ctes import mixed, sql_over
from gridloom.plans.intrinsic_queries import tercile_sql
from gridloom.plans.registry import query, r6
from gridloom.schemas import METRICS, PATCH_METRICS, SAMPLE_KEY
from gridloom.sources import derived, listing, tables, workspace

_PSNR = "CASE WHEN avg(rmse) > 0 THEN 20e0 * log10(1e0 / avg(rmse)) ELSE CAST('inf' AS DOUBLE) END"
_MEANS = (
    f"round(avg(rmse) + 1e-9, 6) AS rmse, {q6(_PSNR)} AS psnr, "
    "round(avg(ssim) + 1e-9, 6) AS ssim, round(avg(sam) + 1e-9, 6) AS sam"
)
_MERGED = """SELECT m.*, d.heterogeneity, d.phenology_variability, d.cloud_persistence, d.difficulty_index
  FROM pmetrics m JOIN pdiff d ON m.y_coord = d.y_coord AND m.x_coord = d.x_coord"""
_MODELS = ["m2", "m0", "m1"]
_TIES = ["y_coord", "x_coord", "t_start"]
_ORDER = "CASE model WHEN 'm2' THEN 1 WHEN 'm0' THEN 2 ELSE 3 END"


def _scores():
    return [r6(m) for m in METRICS]


def _labels_sql():
    return ", ".join(
        f"{tercile_sql(f'row_number() OVER (ORDER BY {m}, y_coord, x_coord)', 'count(*) OVER ()')} AS {a}"
        for m, a in intrinsic.STRATA.items()
    )


_LABELLED = f"SELECT *, {_labels_sql()} FROM pdiff"


def _merged(spark, d):
    return reports.join_difficulty(derived.patch_metrics(spark, d), derived.patch_difficulty(spark, d))


@query(
    "o_i1_join_difficulty",
    sql_over(
        "pmetrics pdiff",
        "SELECT model, y_coord, x_coord, t_start, " + ", ".join(f"{q6(m)} AS {m}" for m in [*METRICS, "difficulty_index"]) + " FROM merged",
        merged=_MERGED,
    ),
)
def join_difficulty(spark, d):
    return _merged(spark, d).select("model", "y_coord", "x_coord", "t_start", *_scores(), r6("difficulty_index"))


@query("o_i2_overall", sql_over("pmetrics", f"SELECT model, {_MEANS} FROM pmetrics GROUP BY model"))
def overall(spark, d):
    return reports.overall(derived.patch_metrics(spark, d)).select("model", *_scores())


@query(
    "o_i3_by_strata",
    sql_over(
        "pmetrics pdiff",
        f"""SELECT report, stratum, model, {_MEANS} FROM (SELECT m.*, l.report, l.stratum FROM pmetrics m JOIN (
  SELECT y_coord, x_coord, 'Overall Difficulty' AS report, stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Spatial Heterogeneity', spatial_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Phenology Variability', phenology_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Cloud Persistence', cloud_stratum FROM labelled) l
  ON m.y_coord = l.y_coord AND m.x_coord = l.x_coord) GROUP BY ALL""",
        labelled=_LABELLED,
    ),
)
def by_strata(spark, d):
    labelled = intrinsic.with_strata(derived.patch_difficulty(spark, d))
    merged = reports.join_difficulty(derived.patch_metrics(spark, d), labelled)
    return reports.by_strata(merged).select("report", "stratum", "model", *_scores())


@query(
    "o_i3_report_tables",
    sql_over(
        "pmetrics pdiff",
        f"""SELECT report, stratum, model, {_MEANS} FROM (SELECT m.*, l.report, l.stratum FROM pmetrics m JOIN (
  SELECT y_coord, x_coord, 'Overall' AS report, CAST(NULL AS VARCHAR) AS stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Overall Difficulty', stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Spatial Heterogeneity', spatial_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Phenology Variability', phenology_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Cloud Persistence', cloud_stratum FROM labelled) l
  ON m.y_coord = l.y_coord AND m.x_coord = l.x_coord) GROUP BY ALL""",
        labelled=_LABELLED,
    ),
)
def report_tables(spark, d):
    labelled = intrinsic.with_strata(derived.patch_difficulty(spark, d))
    merged = reports.join_difficulty(derived.patch_metrics(spark, d), labelled)
    return reports.report_tables(merged).select("report", "stratum", "model", *_scores())


@query(
    "o_i0_evaluation_report",
    sql_over(
        "shape dense pdiff",
        f"""SELECT report, stratum, model, {_MEANS} FROM (SELECT m.*, l.report, l.stratum FROM scored m JOIN (
  SELECT y_coord, x_coord, 'Overall Difficulty' AS report, stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Spatial Heterogeneity', spatial_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Phenology Variability', phenology_stratum FROM labelled
  UNION ALL SELECT y_coord, x_coord, 'Cloud Persistence', cloud_stratum FROM labelled) l
  ON m.y_coord = l.y_coord AND m.x_coord = l.x_coord) GROUP BY ALL""",
        **scores._EVAL_WITH,
        scored=scores._EVAL_SCORES,
        labelled=_LABELLED,
    ),
)
def evaluation_report(spark, d):
    return scores.evaluated(spark, d)["strata"].select("report", "stratum", "model", *_scores())


@query(
    "o_i4_stack_models",
    sql_over(
        "pmetrics",
        """SELECT CASE model WHEN 'm0' THEN 'first' ELSE 'second' END AS model, y_coord, x_coord, t_start,
  round(rmse, 6) AS rmse, CASE WHEN model = 'm1' THEN round(sam, 6) END AS sam FROM pmetrics WHERE model <> 'm2'""",
    ),
)
def stack_models(spark, d):
    scores = derived.patch_metrics(spark, d)
    stacked = reports.stack_models(
        {
            "first": scores.filter("model = 'm0'").drop("sam"),
            "second": scores.filter("model = 'm1'"),
        }
    )
    return stacked.select(
        "model", "y_coord", "x_coord", "t_start", F.round("rmse", 6).alias("rmse"), F.round("sam", 6).alias("sam")
    )


def _stratum_sql(value):
    rank = f"row_number() OVER (ORDER BY {value}, {_ORDER}, y_coord, x_coord, t_start)"
    return tercile_sql(rank, "count(*) OVER ()")


@query(
    "o_i5_terciles",
    sql_over(
        "pmetrics pdiff",
        f"SELECT model, y_coord, x_coord, t_start, {_stratum_sql('cloud_persistence')} AS stratum FROM merged",
        merged=_MERGED,
    ),
)
def terciles(spark, d):
    labelled = reports.with_terciles(_merged(spark, d), "cloud_persistence", _TIES, _MODELS)
    return labelled.select("model", "y_coord", "x_coord", "t_start", "stratum")


_BY_MODEL = f"""SELECT stratum, model, {_MEANS} FROM (SELECT *, {_stratum_sql('difficulty_index')} AS stratum FROM merged)
  GROUP BY stratum, model"""


@query("o_i6_by_stratum_model", sql_over("pmetrics pdiff", _BY_MODEL, merged=_MERGED))
def by_stratum_model(spark, d):
    table = reports.by_stratum_model(_merged(spark, d), "difficulty_index", _TIES, _MODELS)
    return table.select("stratum", "model", *_scores())


@query(
    "o_i7_display_order",
    sql_over(
        "pmetrics pdiff",
        """SELECT stratum, model, rmse, CAST(CASE stratum WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END * 2
  + CASE model WHEN 'm2' THEN 0 ELSE 1 END AS INT) AS place FROM bymodel WHERE model IN ('m2', 'm0')""",
        merged=_MERGED,
        bymodel=_BY_MODEL,
    ),
)
def display_order(spark, d):
    table = reports.by_stratum_model(_merged(spark, d), "difficulty_index", _TIES, _MODELS)
    ordered = reports.display_order(table, ["m2", "m0", "absent"])
    place = (
        (reports.place("stratum", reports.STRATA_ORDER) - 1) * 2 + reports.place("model", ["m2", "m0"]) - 1
    )
    return ordered.select("stratum", "model", r6("rmse"), place.cast("int").alias("place"))


@query(
    "o_i8_round",
    sql_over(
        "pmetrics",
        f"""SELECT model, round(avg(rmse), 4) AS rmse, round(CASE WHEN avg(rmse) > 0 THEN {_PSNR} ELSE avg(psnr) END, 4) AS psnr,
  round(avg(ssim), 4) AS ssim, round(avg(sam), 4) AS sam FROM pmetrics GROUP BY model""",
    ),
)
def round_report(spark, d):
    return reports.round_report(reports.overall_table(derived.patch_metrics(spark, d))).select("model", *METRICS)


@query(
    "o_i9_report_csv",
    sql_over("pmetrics", f"SELECT 'Full_FT_' || model AS name, {_MEANS} FROM pmetrics GROUP BY model"),
)
def report_csv(spark, d):
    path = workspace.new_path(spark, "report")
    table = reports.overall(derived.patch_metrics(spark, d))
    named = table.select(tables.safe_name(F.concat(F.lit("Full (FT) "), "model")).alias("name"), *METRICS)
    tables.write_csv(named, path)
    return spark.read.csv(path, header=True, schema=named.schema).select("name", *_scores())


@query(
    "o_i10_top_per_stratum",
    sql_over(
        "shape pdiff",
        """SELECT s.y_coord, s.x_coord, s.t_start, stratum FROM samples s JOIN labelled d
  ON s.y_coord = d.y_coord AND s.x_coord = d.x_coord WHERE split = 'test'
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY seq) <= 5""",
        **sq.PLAN,
        labelled=_LABELLED,
    ),
)
def top_per_stratum(spark, d):
    labelled = intrinsic.with_strata(derived.patch_difficulty(spark, d)).select("y_coord", "x_coord", "stratum")
    test = sq.plan(spark, d).filter("split = 'test'").join(labelled, ["y_coord", "x_coord"])
    return reports.top_per_stratum(test, 5).select("y_coord", "x_coord", "t_start", "stratum")


@query(
    "o_i11_pick_batches",
    sql_over(
        "shape",
        f"""SELECT batch FROM (SELECT DISTINCT seq // 4 AS batch FROM samples WHERE split = 'train')
  ORDER BY {mixed('batches', 'batch')}, batch LIMIT 10""",
        **sq.PLAN,
    ),
)
def pick_batches(spark, d):
    train = sq.plan(spark, d).filter("split = 'train'")
    return reports.pick_batches(train.withColumn("batch", F.expr("seq div 4")), 10)


@query(
    "o_i12_rgb",
    sql_over("cube", "SELECT t, y, x, round(b01, 6) AS red, round(b04, 6) AS green, round(b03, 6) AS blue FROM cube"),
)
def rgb(spark, d):
    picture = reports.rgb(derived.cube(spark, d), ["t", "y", "x"])
    return picture.select("t", "y", "x", *[F.round(c, 6).alias(c) for c in ("red", "green", "blue")])


_PIXELS = "SELECT model, y_coord, x_coord, t, y, x, p1 AS red, p4 AS green, p3 AS blue FROM preds"
_BOUNDS = """SELECT model, y_coord, x_coord, t, quantile_cont(v, 2e-2) AS p2, quantile_cont(v, 98e-2) AS p98 FROM (
  SELECT model, y_coord, x_coord, t, unnest([red, green, blue]) AS v FROM pixels) GROUP BY ALL"""


@query(
    "o_i13_stretch",
    sql_over(
        "preds",
        "SELECT p.model, p.t, p.y, p.x, "
        + ", ".join(
            f"round(greatest(0, least(1, CASE WHEN p98 > p2 THEN ({c} - p2) / (p98 - p2) ELSE {c} END)) + 1e-9, 6) AS {c}"
            for c in ("red", "green", "blue")
        )
        + """ FROM pixels p JOIN bounds b ON p.model = b.model AND p.y_coord = b.y_coord
  AND p.x_coord = b.x_coord AND p.t = b.t""",
        once="preds pixels bounds",
        pixels=_PIXELS,
        bounds=_BOUNDS,
    ),
)
def stretch(spark, d):
    keys = ["model", "y_coord", "x_coord", "t"]
    picture = reports.rgb(derived.predictions(spark, d), [*keys, "y", "x"], "pred_")
    stretched = reports.stretch(picture, reports.stretch_bounds(picture, keys), keys)
    return stretched.select("model", "t", "y", "x", *[r6(c) for c in _RGB])


_TRUTH = "SELECT model, y_coord, x_coord, t, y, x, t1 AS red, t4 AS green, t3 AS blue FROM preds"
_POOLED = "SELECT model, y_coord, x_coord, t, red, green, blue FROM pixels UNION ALL SELECT model, y_coord, x_coord, t, red, green, blue FROM truth"
_RANGES = """SELECT model, y_coord, x_coord, t, quantile_cont(v, 2e-2) AS p2, quantile_cont(v, 98e-2) AS p98 FROM (
  SELECT model, y_coord, x_coord, t, unnest([red, green, blue]) AS v FROM {source}) GROUP BY ALL"""
_ON = "p.model = b.model AND p.y_coord = b.y_coord AND p.x_coord = b.x_coord AND p.t = b.t"


def _pictures(spark, d):
    keys = ["model", "y_coord", "x_coord", "t"]
    cells = derived.predictions(spark, d)
    return keys, reports.rgb(cells, [*keys, "y", "x"], "pred_"), reports.rgb(cells, [*keys, "y", "x"], "target_")


_RGB = ("red", "green", "blue")


@query(
    "o_i13_stretch_pooled",
    sql_over(
        "preds",
        "SELECT p.model, p.t, p.y, p.x, "
        + ", ".join(f"round(greatest(0, least(1, CASE WHEN p98 > p2 THEN ({c} - p2) / (p98 - p2) ELSE {c} END)) + 1e-9, 6) AS {c}" for c in _RGB)
        + f" FROM truth p JOIN bounds b ON {_ON}",
        pixels=_PIXELS,
        truth=_TRUTH,
        pooled=_POOLED,
        bounds=_RANGES.format(source="pooled"),
    ),
)
def stretch_pooled(spark, d):
    keys, predicted, truth = _pictures(spark, d)
    bounds = reports.stretch_bounds(predicted.unionByName(truth), keys)
    return reports.stretch(truth, bounds, keys).select("model", "t", "y", "x", *[r6(c) for c in _RGB])


@query(
    "o_i13_stretch_truth",
    sql_over(
        "preds",
        "SELECT p.model, p.t, p.y, p.x, "
        + ", ".join(f"round(CASE WHEN p98 > p2 THEN greatest(0, least(1, ({c} - p2) / (p98 - p2 + 1e-8))) ELSE {c} END + 1e-9, 6) AS {c}" for c in _RGB)
        + f" FROM pixels p JOIN bounds b ON {_ON}",
        once="preds pixels bounds",
        pixels=_PIXELS,
        truth=_TRUTH,
        bounds=_RANGES.format(source="truth"),
    ),
)
def stretch_truth(spark, d):
    keys, predicted, truth = _pictures(spark, d)
    bounds = reports.stretch_bounds(truth, keys)
    shown = reports.stretch(predicted, bounds, keys, epsilon=1e-8, clip_flat=False)
    return shown.select("model", "t", "y", "x", *[r6(c) for c in _RGB])


_SAMPLE = ", ".join(SAMPLE_KEY)
_SHOWN = " UNION ALL ".join(
    [
        f"SELECT {_SAMPLE}, y, x, 'prediction' AS picture, p1 AS red, p4 AS green, p3 AS blue FROM filled",
        f"SELECT {_SAMPLE}, y, x, 'truth', in_b01, in_b04, in_b03 FROM truth",
        f"SELECT {_SAMPLE}, y, x, 'frame ' || CAST(t - t_start AS VARCHAR), in_b01, in_b04, in_b03 FROM built",
    ]
)
_SAME = " AND ".join(f"p.{k} = b.{k}" for k in SAMPLE_KEY)


@query(
    "o_i13_stretch_frames",
    sql_over(
        "shape dense",
        "SELECT " + ", ".join(f"p.{k}" for k in SAMPLE_KEY) + ", p.y, p.x, picture, "
        + ", ".join(f"round(greatest(0, least(1, CASE WHEN p98 > p2 THEN ({c} - p2) / (p98 - p2) ELSE {c} END)) + 1e-9, 6) AS {c}" for c in _RGB)
        + f" FROM shown p JOIN bounds b ON {_SAME}",
        **sq.BUILT,
        filled=f"SELECT {_SAMPLE}, y, x, " + ", ".join(f"list_sort(list(in_b0{b}))[2] AS p{b}" for b in (1, 3, 4)) + f" FROM built GROUP BY {_SAMPLE}, y, x",
        truth=f"SELECT {_SAMPLE}, y, x, " + ", ".join(f"max(target_b0{b}) AS in_b0{b}" for b in (1, 3, 4)) + f" FROM built GROUP BY {_SAMPLE}, y, x",
        shown=_SHOWN,
        bounds=f"SELECT {_SAMPLE}, quantile_cont(v, 2e-2) AS p2, quantile_cont(v, 98e-2) AS p98 FROM (SELECT {_SAMPLE}, unnest([red, green, blue]) AS v FROM shown) GROUP BY ALL",
    ),
)
def stretch_frames(spark, d):
    """Prediction, truth and all four input frames of a sample on one common range."""
    cells = workspace.cut(sq.built(spark, d), "samples")
    shown = reports.sample_pictures(impute.temporal_median(cells, sq.C), cells, SAMPLE_KEY, sq.C.window)
    stretched = reports.stretch(shown, reports.stretch_bounds(shown, SAMPLE_KEY), SAMPLE_KEY)
    return stretched.select(*SAMPLE_KEY, "y", "x", "picture", *[r6(c) for c in _RGB])


@query(
    "o_a17_metrics_scan",
    sql_over(
        "pmetrics",
        """SELECT CASE model WHEN 'm0' THEN 'First (Full)' ELSE 'Second' END AS model, y_coord, x_coord,
  round(rmse, 6) AS rmse FROM pmetrics WHERE model <> 'm2'""",
    ),
)
def metrics_scan(spark, d):
    root = workspace.new_path(spark, "inference")
    scores = derived.patch_metrics(spark, d).select("model", "y_coord", "x_coord", *METRICS)
    names = {"First (Full)": "m0", "Second": "m1"}
    for folder in ("a", "b"):
        for name, model in names.items():
            # one result per model and folder; the later folder must lose
            found = scores.filter(F.col("model") == model)
            found = found if folder == "a" else found.withColumn("rmse", F.lit(9.0))
            tables.write_csv(found, f"{root}/{folder}/{tables.file_name(name)}_detailed_patch_metrics.csv")
    prefixes = {name: tables.file_name(name) for name in [*names, "Never Run"]}
    rows = tables.scan_patch_metrics(spark, root, prefixes, PATCH_METRICS)
    return rows.select("model", "y_coord", "x_coord", F.round("rmse", 6).alias("rmse"))


@query(
    "o_j1_safe_div",
    """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0e0 ELSE round(event_id / (user_id % 7) + 1e-9, 6) END AS ratio,
  CASE WHEN user_id % 7 <> 0 THEN round(event_id / (user_id % 7) + 1e-9, 6) END AS ratio_or_null FROM events""",
)
def safe_ratio(spark, d):
    den = F.col("user_id") % 7
    num = F.col("event_id")
    nullable = safe_div(num, den)
    zeroed = safe_div(num, den, 0.0)
    return derived.table(spark, d, "events").select(
        "event_id",
        F.when(den == 0, zeroed).otherwise(r6(zeroed)).alias("ratio"),
        r6(nullable, "ratio_or_null"),
    )


@query(
    "o_j2_write_report",
    """SELECT format, round(size_mb, 6) AS size_mb, round(CASE WHEN seconds > 0 THEN size_mb / seconds ELSE 0 END, 6) AS throughput_mb_per_s
  FROM (SELECT o_orderpriority AS format, sum(CAST(round(o_totalprice) AS BIGINT)) / 1048576e0 AS size_mb FROM orders GROUP BY 1)
  JOIN (SELECT o_orderpriority AS format, count(*) / 1e2 AS seconds FROM orders GROUP BY 1) USING (format)""",
)
def write_report(spark, d):
    orders = derived.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "format")
    files = orders.select("format", F.round("o_totalprice").cast("bigint").alias("length"))
    timings = orders.groupBy("format").agg((F.count("*") / F.lit(100.0)).alias("seconds"))
    report = runs.write_report(files, timings)
    return report.select(
        "format", F.round("size_mb", 6).alias("size_mb"), F.round("throughput_mb_per_s", 6).alias("throughput_mb_per_s")
    )


@query(
    "o_j2_stored_size",
    """SELECT format, round(bytes / 1048576e0 + 1e-9, 6) AS size_mb, n / 100e0 AS seconds,
  round(bytes / 1048576e0 / (n / 100e0) + 1e-9, 6) AS throughput_mb_per_s FROM (
  SELECT substr(o_orderpriority, 1, 1) AS format, count(*) AS n,
    sum(strlen(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR)) + 1) AS bytes FROM orders GROUP BY 1)""",
)
def stored_size(spark, d):
    """Plain text files: the bytes of a line are its characters and the line end."""
    path = workspace.new_path(spark, "sized")
    line = F.concat_ws("|", "o_orderkey", "o_custkey").alias("line")
    orders = derived.table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("format"), line)
    tables.write_by(orders, path, "format", fmt="text")
    files = listing.stored_files(spark, path).select(
        F.regexp_extract("path", "format=([^/]+)/", 1).alias("format"), "length"
    )
    timings = orders.groupBy("format").agg((F.count("*") / F.lit(100.0)).alias("seconds"))
    report = runs.write_report(files, timings)
    return report.select("format", r6("size_mb"), "seconds", r6("throughput_mb_per_s"))


@query(
    "o_j3_read_report",
    sql_over(
        "runs",
        """SELECT model, gpus, CAST(sum(samples) AS BIGINT) AS samples, round(sum(samples) * (4 * 8 * 64 * 4 / 1048576e0) + 1e-9, 6) AS total_mb,
  round(sum(samples) * (4 * 8 * 64 * 4 / 1048576e0) / sum(elapsed) + 1e-9, 6) AS throughput_mb_per_s,
  round(sum(samples) / sum(elapsed) + 1e-9, 6) AS samples_per_second FROM runs GROUP BY model, gpus""",
    ),
)
def read_report(spark, d):
    reads = derived.runs(spark, d).withColumnRenamed("elapsed", "seconds")
    report = runs.read_report(reads, ["model", "gpus"], frames=4, bands=8, patch=8, item_bytes=4)
    return report.select(
        "model", "gpus", "samples", r6("total_mb"), r6("throughput_mb_per_s"), r6("samples_per_second")
    )


_FORMATS = """SELECT user_id % 50 AS run, CASE WHEN event_id % 3 = 0 THEN 'netcdf' ELSE 'zarr' END AS format,
  CASE WHEN event_id % 3 = 2 THEN 4 ELSE 0 END AS workers, max(1 + event_id % 97) AS size_mb,
  max(1 + event_id % 31) AS write_seconds, max(1 + event_id % 53) AS read_mb_per_s FROM events GROUP BY 1, 2, 3"""


@query(
    "o_j4_compare_formats",
    sql_over(
        "",
        """SELECT run, round(nw / zw + 1e-9, 6) AS write_speedup, round(zs / ns + 1e-9, 6) AS size_ratio, round(zr / nr + 1e-9, 6) AS read_speedup,
  round(z4 / zr + 1e-9, 6) AS scaling_factor, round(z4 / zr / 4 * 100 + 1e-9, 6) AS parallel_efficiency_pct FROM (SELECT run,
  CAST(max(write_seconds) FILTER (format = 'netcdf' AND workers = 0) AS DOUBLE) AS nw,
  CAST(max(write_seconds) FILTER (format = 'zarr' AND workers = 0) AS DOUBLE) AS zw,
  CAST(max(size_mb) FILTER (format = 'netcdf' AND workers = 0) AS DOUBLE) AS ns,
  CAST(max(size_mb) FILTER (format = 'zarr' AND workers = 0) AS DOUBLE) AS zs,
  CAST(max(read_mb_per_s) FILTER (format = 'netcdf' AND workers = 0) AS DOUBLE) AS nr,
  CAST(max(read_mb_per_s) FILTER (format = 'zarr' AND workers = 0) AS DOUBLE) AS zr,
  CAST(max(read_mb_per_s) FILTER (format = 'zarr' AND workers = 4) AS DOUBLE) AS z4 FROM formats GROUP BY run)""",
        formats=_FORMATS,
    ),
)
def compare_formats(spark, d):
    e = derived.table(spark, d, "events")
    report = e.groupBy(
        (F.col("user_id") % 50).alias("run"),
        F.when(F.col("event_id") % 3 == 0, "netcdf").otherwise("zarr").alias("format"),
        F.when(F.col("event_id") % 3 == 2, 4).otherwise(0).alias("workers"),
    ).agg(
        F.max(1 + F.col("event_id") % 97).alias("size_mb"),
        F.max(1 + F.col("event_id") % 31).alias("write_seconds"),
        F.max(1 + F.col("event_id") % 53).alias("read_mb_per_s"),
    )
    table = runs.compare_formats(report, "netcdf", "zarr", 4, ["run"])
    ratios = ["write_speedup", "size_ratio", "read_speedup", "scaling_factor", "parallel_efficiency_pct"]
    return table.select("run", *[r6(c) for c in ratios])


@query(
    "o_j5_scaling",
    sql_over(
        "runs",
        """SELECT model, gpus, round(total + 1e-9, 6) AS throughput_total, round(total / gpus + 1e-9, 6) AS throughput_per_gpu,
  round(std + 1e-9, 6) AS std, round(total / ref + 1e-9, 6) AS speedup, round(total / ref / (gpus / 8e0) * 100 + 1e-9, 6) AS efficiency_pct
  FROM (SELECT *, coalesce(max(total) FILTER (gpus = 8) OVER (PARTITION BY model), total / (gpus / 8e0)) AS ref FROM (
    SELECT model, gpus, avg(tp) AS total, stddev_pop(tp) AS std FROM (
      SELECT model, gpus, repeat_id, sum(samples) / max(elapsed) AS tp FROM kept GROUP BY 1, 2, 3) GROUP BY 1, 2))""",
        kept="SELECT * FROM runs WHERE NOT (model = 'view' AND gpus = 8)",
    ),
)
def scaling(spark, d):
    # one model without a run of the base size, so that both references occur
    kept = derived.runs(spark, d).filter("NOT (model = 'view' AND gpus = 8)")
    table = runs.scaling(kept)
    cols = ["throughput_total", "throughput_per_gpu", "std", "speedup", "efficiency_pct"]
    return table.select("model", "gpus", *[r6(c) for c in cols])


@query(
    "o_j6_weak_scaling",
    sql_over(
        "runs",
        """SELECT gpus AS worker_count, CAST(gpus // 8 AS INT) AS days, CAST(sum(samples) AS DOUBLE) AS data_size_mb,
  round(sum(samples) / sum(elapsed) + 1e-9, 6) AS throughput_mbs FROM runs GROUP BY 1, 2""",
    ),
)
def weak_scaling(spark, d):
    rows = derived.runs(spark, d).select(
        F.col("gpus").alias("worker_count"),
        F.expr("CAST(gpus div 8 AS INT)").alias("days"),
        F.col("samples").cast("double").alias("data_size_mb"),
        F.col("elapsed").alias("seconds"),
    )
    path = workspace.new_path(spark, "weak-scaling")
    table = runs.weak_scaling(rows)
    tables.write_csv(table, path, mode="append")
    return spark.read.csv(path, header=True, schema=table.schema).select(
        "worker_count", "days", "data_size_mb", r6("throughput_mbs")
    )


_STEPS = """SELECT event_type AS model, CAST(event_id // 50 AS INT) AS epoch, CAST(event_id % 4 AS INT) AS rank,
  abs(value) / 1e2 AS loss FROM events"""


@query(
    "o_j7_epochs",
    sql_over(
        "",
        """SELECT model, epoch, round(loss / 4 / batches + 1e-9, 6) AS loss, round(samples / seconds + 1e-9, 6) AS throughput,
  round(first_value(seconds) OVER (PARTITION BY model ORDER BY epoch) / seconds + 1e-9, 6) AS speedup FROM (
  SELECT model, epoch, sum(loss) AS loss, count(*) AS batches, CAST(count(*) * 4 AS BIGINT) AS samples,
    CAST(max(rank) + count(*) AS DOUBLE) AS seconds FROM steps GROUP BY model, epoch)""",
        steps=_STEPS,
    ),
)
def epochs(spark, d):
    steps = derived.table(spark, d, "events").select(
        F.col("event_type").alias("model"),
        F.expr("CAST(event_id div 50 AS INT)").alias("epoch"),
        F.expr("CAST(event_id % 4 AS INT)").alias("rank"),
        (F.abs("value") / 100.0).alias("loss"),
    )
    durations = steps.groupBy("model", "epoch").agg(
        F.count("*").alias("batches"),
        (F.count("*") * 4).alias("samples"),
        (F.max("rank") + F.count("*")).cast("double").alias("seconds"),
    )
    table = runs.epochs(steps, durations, world=4)
    return table.select("model", "epoch", r6("loss"), r6("throughput"), r6("speedup"))


_PARTED = "SELECT *, event_id % 5 = 0 AS tested FROM (SELECT event_id, event_type AS model, CAST(event_id // 50 AS INT) AS epoch, CAST(event_id % 4 AS INT) AS rank, abs(value) / 1e2 AS loss FROM events)"


@query(
    "o_j7_validation",
    sql_over(
        "",
        """SELECT model, epoch, round(loss / 4 / batches + 1e-9, 6) AS loss, round(val / 4 / nullif(val_batches, 0) + 1e-9, 6) AS val_loss FROM (
  SELECT model, epoch, sum(loss) FILTER (NOT tested) AS loss, sum(loss) FILTER (tested) AS val, count(*) FILTER (NOT tested) AS batches,
    count(*) FILTER (tested) AS val_batches FROM steps GROUP BY model, epoch) WHERE batches > 0""",
        steps=_PARTED,
    ),
)
def validation(spark, d):
    """Loss of training and validation steps per epoch."""
    steps = derived.table(spark, d, "events").select(
        F.col("event_type").alias("model"),
        F.expr("CAST(event_id div 50 AS INT)").alias("epoch"),
        F.expr("CAST(event_id % 4 AS INT)").alias("rank"),
        (F.abs("value") / 100.0).alias("loss"),
        (F.col("event_id") % 5 == 0).alias("tested"),
    )
    durations = steps.groupBy("model", "epoch").agg(
        F.count_if(~F.col("tested")).alias("batches"),
        F.count_if("tested").alias("val_batches"),
        F.count("*").alias("samples"),
        F.count("*").cast("double").alias("seconds"),
    )
    table = runs.epochs(steps.filter("NOT tested"), durations, world=4, validation=steps.filter("tested"))
    return table.select("model", "epoch", r6("loss"), r6("val_loss"))

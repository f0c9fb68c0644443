"""Stratified reports: difficulty join, means with consistent PSNR, order, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.spectral import psnr_from_rmse
from gridloom.operators.ranking import digest, ordered_rank, tercile
from gridloom.schemas import METRICS

_PATCH = ["y_coord", "x_coord"]
STRATA_ORDER = ["Low", "Medium", "High"]

# Report titles and the stratum column behind each.
STRATUM_TABLES = {
    "Overall Difficulty": "stratum",
    "Spatial Heterogeneity": "spatial_stratum",
    "Phenology Variability": "phenology_stratum",
    "Cloud Persistence": "cloud_stratum",
}


def join_difficulty(scores: DataFrame, difficulty: DataFrame) -> DataFrame:
    """Each score row with its patch's difficulty; patches without one drop out.

    Both sides grow with the number of patches, so the join has no size hint.
    """
    return scores.join(difficulty, _PATCH)


def _means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scores per group; PSNR follows from the mean RMSE instead of being averaged."""
    rest = [m for m in METRICS if m != "psnr"]
    means = df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in rest])
    return means.withColumn("psnr", psnr_from_rmse(F.col("rmse"))).select(*keys, *METRICS)


def overall(scores: DataFrame) -> DataFrame:
    return _means(scores, ["model"])


def overall_table(scores: DataFrame) -> DataFrame:
    """The final table's reading: where the mean RMSE is 0, the mean PSNR stays."""
    means = scores.groupBy("model").agg(*[F.avg(m).alias(m) for m in METRICS])
    recomputed = F.when(F.col("rmse") > 0, psnr_from_rmse(F.col("rmse"))).otherwise(F.col("psnr"))
    return means.withColumn("psnr", recomputed)


def by_strata(merged: DataFrame, tables: dict[str, str] = STRATUM_TABLES) -> DataFrame:
    """Means per report, stratum and model, for the stratum columns present.

    The labels become rows, so one aggregate serves all reports.
    """
    present = {title: col for title, col in tables.items() if col in merged.columns}
    labels = F.array(
        *[F.struct(F.lit(title).alias("report"), F.col(col).alias("stratum")) for title, col in present.items()]
    )
    long = merged.select("model", *METRICS, F.explode(labels).alias("l"))
    flat = long.select("model", *METRICS, "l.report", "l.stratum").filter("stratum IS NOT NULL")
    return _means(flat, ["report", "stratum", "model"])


def report_tables(merged: DataFrame, tables: dict[str, str] = STRATUM_TABLES) -> DataFrame:
    """The overall table and those of all strata from one aggregate by grouping sets; ``report`` names the table.

    Overall rows have no stratum. Rows whose label is missing count in no stratum of that report.
    """
    present = {title: col for title, col in tables.items() if col in merged.columns}
    columns = list(present.values())
    sets = [["model"], *[["model", c] for c in columns]]
    rest = [m for m in METRICS if m != "psnr"]
    means = merged.groupingSets(sets, "model", *columns).agg(
        F.grouping_id().alias("_set"), *[F.avg(m).alias(m) for m in rest]
    )
    # one bit per column that a set leaves out, the model's first
    every = 2 ** len(columns) - 1
    title, stratum = F.when(F.col("_set") == every, "Overall"), F.lit(None).cast("string")
    for i, (name, column) in enumerate(present.items()):
        here = F.col("_set") == every - 2 ** (len(columns) - 1 - i)
        title, stratum = title.when(here, name), F.coalesce(F.when(here, F.col(column)), stratum)
    out = means.select(title.alias("report"), stratum.alias("stratum"), "model", *rest)
    out = out.filter((F.col("report") == "Overall") | F.col("stratum").isNotNull())
    return out.withColumn("psnr", psnr_from_rmse(F.col("rmse"))).select("report", "stratum", "model", *METRICS)


def stack_models(tables: dict[str, DataFrame]) -> DataFrame:
    """One table from per-model tables, the display name as ``model``."""
    named = [df.withColumn("model", F.lit(name)) for name, df in tables.items()]
    if not named:
        raise ValueError("no patch metrics to stack")
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def place(column: str, order: list[str]) -> Column:
    """Position of a value in a fixed list, NULL when absent."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)), F.lit(0))


def with_terciles(
    df: DataFrame, value: str, ties: list[str], model_order: list[str] | None = None
) -> DataFrame:
    """Thirds by rank of ``value`` over all rows, replacing any ``stratum`` column.

    ``ties`` must make rows unique; with ``model_order`` equal values first
    follow the order in which models were stacked.
    """
    rows = df.drop("stratum")
    order = [value, *ties]
    if model_order:
        rows = rows.withColumn("_model", place("model", model_order))
        order = [value, "_model", *ties]
    # missing values have no rank and so no stratum
    ranked = ordered_rank(rows.filter(F.col(value).isNotNull()), order, total="_n", name="_rank")
    return ranked.withColumn("stratum", tercile(F.col("_rank"), F.col("_n"))).drop("_rank", "_n", "_model")


def by_stratum_model(
    merged: DataFrame, value: str, ties: list[str], model_order: list[str] | None = None
) -> DataFrame:
    """Means per third of ``value`` and model."""
    return _means(with_terciles(merged, value, ties, model_order), ["stratum", "model"])


def display_order(report: DataFrame, models: list[str]) -> DataFrame:
    """Rows of known strata and models in display order; absent pairs simply do not occur."""
    known = report.filter(F.col("model").isin(models))
    keys = [place("model", models)]
    if "stratum" in report.columns:
        known = known.filter(F.col("stratum").isin(STRATA_ORDER))
        keys = [place("stratum", STRATA_ORDER), *keys]
    return known.orderBy(*keys)


def round_report(report: DataFrame, digits: int = 4) -> DataFrame:
    return report.withColumns({m: F.round(m, digits) for m in METRICS if m in report.columns})


def top_per_stratum(samples: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """First ``n`` samples of each of the three strata in loader order.

    The rank filter is a group limit before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("stratum").orderBy(order))
    known = samples.filter(F.col("stratum").isin(STRATA_ORDER))
    return known.withColumn("rank", rank).filter(F.col("rank") <= n)


def pick_batches(batches: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` batch numbers in seeded order."""
    return batches.select("batch").distinct().orderBy(digest("batches", ["batch"], seed), "batch").limit(n)


def rgb(cells: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Red, green and blue from bands 1, 4 and 3."""
    named = {"red": "b01", "green": "b04", "blue": "b03"}
    return cells.select(*keys, *[F.col(f"{prefix}{b}").alias(c) for c, b in named.items()])


def rank_quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each group by rank selection, as columns named by ``shares``; NULLs do not count.

    Values are ranked where their group is sorted, which can spill; only the two neighbours of each wanted rank are
    aggregated, so no list of a group is built.
    """
    group = W.partitionBy(*keys)
    ranked = values.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), (F.row_number().over(group.orderBy(value)) - 1).alias("_at"), F.count("*").over(group).alias("_n")
    )

    def picked(share: float, up: int) -> Column:
        return F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * share) + up, F.col("_v")))

    found = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[picked(q, up).alias(f"{name}_{up}") for name, q in shares.items() for up in (0, 1)]
    )

    def between(name: str, share: float) -> Column:
        place, low = (F.col("_n") - 1) * F.lit(share), F.col(f"{name}_0")
        return low + (F.coalesce(F.col(f"{name}_1"), low) - low) * (place - F.floor(place))

    return found.select(*keys, *[between(name, q).alias(name) for name, q in shares.items()])


def stretch_bounds(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """2nd and 98th percentile over the pooled channels of each sample, interpolated."""
    pooled = pixels.select(*keys, F.explode(F.array("red", "green", "blue")).alias("value"))
    return rank_quantiles(pooled, keys, "value", {"p2": 0.02, "p98": 0.98})


def sample_pictures(filled: DataFrame, cells: DataFrame, keys: list[str], window: int) -> DataFrame:
    """All pictures of a sample in colour: prediction, truth and its input frames, named by ``picture``.

    ``filled`` has ``pred_*``, ``cells`` the sample cells with ``in_*`` and ``target_*``. Pooled, they give the range a figure of the
    sample is stretched to.
    """
    shown = {"prediction": rgb(filled, [*keys, "y", "x"], "pred_"), "truth": rgb(cells, [*keys, "y", "x"], "target_")}
    out = None
    for name, picture in shown.items():
        picture = picture.select(*keys, "y", "x", F.lit(name).alias("picture"), "red", "green", "blue")
        out = picture if out is None else out.unionByName(picture)
    bands = {"red": "b01", "green": "b04", "blue": "b03"}
    frames = F.array(
        *[
            F.struct(F.lit(f"frame {k}").alias("picture"), *[F.get(f"in_{b}", F.lit(k)).alias(n) for n, b in bands.items()])
            for k in range(window)
        ]
    )
    inputs = cells.select(*keys, "y", "x", F.explode(frames).alias("f")).select(*keys, "y", "x", "f.*")
    return out.unionByName(inputs)


def stretch(
    pixels: DataFrame, bounds: DataFrame, keys: list[str], epsilon: float = 0.0, clip_flat: bool = True
) -> DataFrame:
    """Channels mapped so that p2 becomes 0 and p98 becomes 1, clipped.

    A flat picture keeps its values; they are still clipped unless ``clip_flat``
    is off. ``epsilon`` goes into the divisor.
    """
    def one(c: str) -> Column:
        spread = F.col("p98") - F.col("p2")
        scaled = F.try_divide(F.col(c) - F.col("p2"), spread + F.lit(epsilon))
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
        flat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) if clip_flat else F.col(c)
        return F.when(spread > 0, clipped).otherwise(flat)

    joined = pixels.join(bounds, keys)
    return joined.withColumns({c: one(c) for c in ("red", "green", "blue")}).drop("p2", "p98")

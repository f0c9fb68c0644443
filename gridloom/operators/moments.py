"""Mergeable moments: statistics of a growing cube without reading its old days.

A state table holds count, mean and sum of squared deviations per cell and band (or sums of products per pair of bands). States of
separate days are merged by the pairwise update of Chan et al., which does not cancel, so deviations, their summary and
correlations of the whole follow from the old state and the new days alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.spectral import safe_div


def cell_moments(cells: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """State per key and band: ``n, mean, m2``; one partial aggregate. Missing values do not count."""
    wide = cells.groupBy(*keys).agg(
        *[
            F.struct(
                F.count(b).alias("n"), F.avg(b).alias("mean"), (F.var_pop(b) * F.count(b)).alias("m2")
            ).alias(b)
            for b in bands
        ]
    )
    return wide.unpivot(keys, bands, "band", "state").select(*keys, "band", "state.*").filter("n > 0")


def pair_moments(cells: DataFrame, bands: list[str], by: list[str] = ()) -> DataFrame:
    """State per pair of bands over pairwise complete rows: ``n``, both means, both ``m2`` and the sum of products ``c``."""
    pairs = list(combinations(bands, 2))

    def state(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        n = F.count(x)
        return F.struct(
            F.lit(a).alias("band_i"), F.lit(b).alias("band_j"), n.alias("n"), F.avg(x).alias("mean_i"), F.avg(y).alias("mean_j"),
            (F.var_pop(x) * n).alias("m2_i"), (F.var_pop(y) * n).alias("m2_j"), (F.covar_pop(x, y) * n).alias("c"),
        )

    row = cells.groupBy(*by).agg(F.array(*[state(a, b) for a, b in pairs]).alias("states"))
    return row.select(*by, F.explode("states").alias("s")).select(*by, "s.*").filter("n > 0")


def merge(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """One state table from several over separate rows. A group holds at most one row per given table."""
    names = [c for c in states[0].columns if c not in keys]
    joined = states[0]
    for other in states[1:]:
        joined = joined.unionByName(other)
    gathered = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s"))

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share, weight = b["n"] / n, a["n"] * b["n"] / n
        out = {"n": n}
        for suffix in ("", "_i", "_j"):
            if f"mean{suffix}" in names:
                step = b[f"mean{suffix}"] - a[f"mean{suffix}"]
                out[f"mean{suffix}"] = a[f"mean{suffix}"] + step * share
                out[f"m2{suffix}"] = a[f"m2{suffix}"] + b[f"m2{suffix}"] + step * step * weight
        if "c" in names:
            out["c"] = a["c"] + b["c"] + (b["mean_i"] - a["mean_i"]) * (b["mean_j"] - a["mean_j"]) * weight
        return F.struct(*[out[k].alias(k) for k in names])

    first, rest = F.get("s", F.lit(0)), F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    return gathered.select(*keys, F.aggregate(rest, first, both).alias("s")).select(*keys, "s.*")


def deviations(state: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Population standard deviation per key, one column per band."""
    wide = state.groupBy(*keys).pivot("band", bands).agg(F.first(F.sqrt(F.col("m2") / F.col("n"))))
    return wide.select(*keys, *bands)


def correlations(state: DataFrame) -> DataFrame:
    """Pearson coefficient of each pair; NULL without spread."""
    return state.withColumn("r", safe_div(F.col("c"), F.sqrt(F.col("m2_i") * F.col("m2_j"))))

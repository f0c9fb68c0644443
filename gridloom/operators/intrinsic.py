"""Radiometry, temporal stability and the patch difficulty index."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import LAND_COVER, DifficultyConfig
from gridloom.functions.spectral import add, ndvi, ndvi_unbounded, quantile
from gridloom.operators.patches import extract, patch_coords, with_patch
from gridloom.operators.ranking import digest, ordered_rank, tercile
from gridloom.schemas import BANDS
from gridloom.sources.workspace import cut

_PATCH = ["y_coord", "x_coord"]


def temporal_medians(cells: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """Interpolated median over the frames of each cell, missing values skipped.

    A group is one cell, so a list holds at most one value per frame; sorting
    it is cheaper than the exact percentile's map of counts.
    """
    keys = [k for k in ("y", "x", "class") if k in cells.columns]
    lists = cells.groupBy(*keys).agg(*[F.sort_array(F.collect_list(b)).alias(b) for b in bands])
    return lists.select(*keys, *[quantile(F.col(b), 0.5).alias(b) for b in bands])


def long_reflectance(medians: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """One row per cell and band with the class id."""
    return medians.unpivot(["y", "x", "class"], bands, "band", "reflectance")


def name_classes(df: DataFrame, dim: DataFrame, column: str = "class") -> DataFrame:
    """Class name and colour; unknown ids keep NULL. The dimension has 11 rows."""
    names = dim.select(
        F.col("lc").cast("int").alias("_lc"),
        F.col("name").alias("land_cover_name"),
        F.col("color"),
    )
    return df.join(F.broadcast(names), F.col(column).cast("int") == F.col("_lc"), "left").drop("_lc")


def radiometry(cube: DataFrame, patches: DataFrame, dim: DataFrame, patch: int) -> DataFrame:
    """Per cell of the chosen patches: class name and median of each band.

    A cell lies in one patch and a patch has one class, so the pivot of the
    long form back to bands as columns is the wide median table itself. Cells
    without any value are left out. The patches come from a choice of at most n
    per listed class, so they are broadcast and the cube does not move for them.
    """
    cells = extract(cube, F.broadcast(patches), patch)
    medians = temporal_medians(cells).dropna("all", subset=BANDS)
    named = name_classes(medians, dim).filter("land_cover_name IS NOT NULL")
    return named.select("y", "x", "land_cover_name", *[F.col(b).alias(b.upper()) for b in BANDS])


def pivot_bands(long: DataFrame, bands: list[str]) -> DataFrame:
    """Bands as columns per (y, x, class name), mean of duplicates, cells without values left out.

    The band names are given, so no pass looks for them.
    """
    keys = ["y", "x", "land_cover_name"]
    known = long.filter("reflectance IS NOT NULL AND land_cover_name IS NOT NULL")
    return known.groupBy(*keys).pivot("band", bands).agg(F.avg("reflectance"))


def histogram(long: DataFrame, lo: float, hi: float, bins: int, value: str = "reflectance") -> DataFrame:
    """Counts per band, class and bin; bin 0 lies below ``lo``, ``bins + 1`` at or above ``hi``."""
    binned = long.filter(F.col(value).isNotNull()).withColumn(
        "bin", F.width_bucket(F.col(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).cast("int")
    )
    return binned.groupBy("band", "land_cover_name", "bin").agg(F.count("*").alias("n"))


def density(hist: DataFrame, lo: float, hi: float, bins: int, bandwidth: float) -> DataFrame:
    """Gaussian density at bin centres, over all values.

    The input has at most (bins + 2) x bands x classes rows; each inner one adds
    its weight to every centre. Values below ``lo`` and from ``hi`` on have no known
    place, so they count in the total only: the curve over [lo, hi] holds
    their share less than 1.
    """
    step = (hi - lo) / bins
    spread = hist.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    inside = F.col("bin").between(1, bins)
    z = (F.col("at") - F.col("bin")) * F.lit(step / bandwidth)
    kernel = F.exp(-0.5 * z * z) * F.lit(1.0 / (bandwidth * (2.0 * 3.141592653589793) ** 0.5))
    return spread.groupBy("band", "land_cover_name", "at").agg(
        (F.sum(F.when(inside, kernel * F.col("n")).otherwise(0.0)) / F.sum("n")).alias("density"),
    )


def kernel_density(long: DataFrame, points: int = 200, reach: float = 3.0, value: str = "reflectance") -> DataFrame:
    """Gaussian density per band and class on a grid of its own, in two passes.

    The first takes count, spread and range of each group: Scott's bandwidth is the sample deviation times ``n ** -0.2``, and the
    grid goes ``reach`` bandwidths beyond the least and the greatest value. The second deals each value to its two
    neighbours on the grid in proportion (``points`` weights a group), which then add their kernels to every point, so
    the curve holds all the mass but the tails beyond the grid. Groups without spread have no curve.
    """
    keys = ["band", "land_cover_name"]
    known = long.filter(F.col(value).isNotNull())
    moments = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    width = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    grid = moments.filter("s > 0").select(*keys, "n", width.alias("width"), "lo", "hi").select(
        *keys, "n", "width", (F.col("lo") - reach * F.col("width")).alias("start"),
        ((F.col("hi") - F.col("lo") + 2 * reach * F.col("width")) / (points - 1)).alias("step"),
    )
    # one row per band and class
    at = (F.col(value) - F.col("start")) / F.col("step")
    dealt = known.join(F.broadcast(grid.select(*keys, "start", "step")), keys).select(*keys, at.alias("at"))
    low = F.floor("at")
    shares = F.array(
        F.struct(low.cast("int").alias("bin"), (low + 1 - F.col("at")).alias("w")),
        F.struct((low + 1).cast("int").alias("bin"), (F.col("at") - low).alias("w")),
    )
    weights = dealt.select(*keys, F.explode(shares).alias("e")).groupBy(*keys, "e.bin").agg(F.sum("e.w").alias("w"))
    spread = weights.join(F.broadcast(grid), keys).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("point") - F.col("bin")) * F.col("step") / F.col("width")
    kernel = F.exp(-0.5 * z * z) / (F.col("width") * F.lit((2.0 * 3.141592653589793) ** 0.5))
    place = F.col("start") + F.col("point") * F.col("step")
    return spread.groupBy(*keys, "point").agg(
        F.max(place).alias("value"), (F.sum(kernel * F.col("w")) / F.max("n")).alias("density")
    )


def band_correlation(df: DataFrame, bands: list[str]) -> DataFrame:
    """Pearson matrix over pairwise complete rows, in one global aggregate."""
    pairs = list(combinations(range(len(bands)), 2))
    row = df.agg(
        *[F.corr(bands[i], bands[j]).alias(f"{i}_{j}") for i, j in pairs],
        *[
            F.when(F.variance(bands[i]) > 0, F.lit(1.0)).alias(f"{i}_{i}")
            for i in range(len(bands))
        ],
    )
    entries = []
    for i in range(len(bands)):
        for j in range(len(bands)):
            entries.append(
                F.struct(
                    F.lit(bands[i]).alias("band_i"),
                    F.lit(bands[j]).alias("band_j"),
                    F.col(f"{min(i, j)}_{max(i, j)}").alias("r"),
                )
            )
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows in seeded order: a top-n per task, then of those."""
    return df.orderBy(digest("rows", ["y", "x"], seed), "y", "x").limit(n)


def stable_cells(cube: DataFrame, landcover: DataFrame, classes: list[int]) -> DataFrame:
    """Clear observations (code 0) of cells in the listed classes."""
    stable = landcover.filter(F.col("lc").isin(classes)).select("y", "x")
    return cube.filter("usability = 0").join(stable, ["y", "x"], "left_semi")


def temporal_std(cells: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """Population standard deviation over time per cell and band."""
    return cells.groupBy("y", "x").agg(*[F.stddev_pop(b).alias(b) for b in bands])


def temporal_summary(std: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """Mean of the per-cell deviations of each band."""
    means = std.agg(*[F.avg(b).alias(b) for b in bands])
    return means.unpivot([], bands, "band", "mean_temporal_std_dev")


def shannon(landcover: DataFrame, patch: int, height=None, width=None) -> DataFrame:
    """Class diversity of each patch in bits."""
    counts = (
        with_patch(landcover, patch, height, width)
        .groupBy(*_PATCH, "lc")
        .agg(F.count("*").cast("double").alias("n"))
    )
    # -sum(p log2 p) with p = n / N is log2 N - sum(n log2 n) / N
    return counts.groupBy(*_PATCH).agg(
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("heterogeneity")
    )


def cell_stats(cube: DataFrame, c: DifficultyConfig, height=None, width=None) -> DataFrame:
    """Per cell: NDVI deviation over time and number of cloudy frames.

    The frames of a cell that a task reads are combined before anything moves, and
    cells spread over as many tasks as there are, not one per patch. A cube
    table bucketed by patch is aggregated where it lies.
    """
    red, nir = F.col(c.red), F.col(c.nir)
    cells = with_patch(cube, c.patch, height, width).select(
        *_PATCH,
        "y",
        "x",
        ndvi(red, nir).alias("ndvi"),
        ndvi_unbounded(red, nir).alias("unbounded"),
        (F.col("usability") == c.cloudy_code).cast("int").alias("cloudy"),
    )
    return cells.groupBy(*_PATCH, "y", "x").agg(
        F.when(~F.coalesce(F.bool_or("unbounded"), F.lit(False)), F.stddev_pop("ndvi")).alias("ndvi_std"),
        F.sum(F.coalesce("cloudy", F.lit(0))).alias("cloudy"),
        F.count("*").alias("frames"),
    )


def cube_metrics(
    cube: DataFrame, c: DifficultyConfig, times: int | None = None, height: int | None = None, width: int | None = None
) -> DataFrame:
    """Phenology variability and cloud persistence per patch.

    ``times`` is the number of frames of the cube. With it, absent rows count
    as frames and cells that are not cloudy, so a sparse cube need not be made
    dense; the grid's ``height`` and ``width`` must then be given, since patches
    cut off at its edge are left out. Without ``times`` the rows present are
    the denominator.
    """
    if times is not None and (height is None or width is None):
        raise ValueError("times needs the grid's height and width")
    stats = cell_stats(cube, c, height, width)
    share = (
        F.avg(F.col("cloudy") / F.col("frames"))
        if times is None
        else F.sum("cloudy") / F.lit(float(times * c.patch * c.patch))
    )
    return stats.groupBy(*_PATCH).agg(
        F.avg("ndvi_std").alias("phenology_variability"), share.alias("cloud_persistence")
    )


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to [0, 1] over the table as ``<name>_norm``; 0 for a constant one.

    The table is a small summary of a large input, so it is written once: the
    bounds, one row, and the scaled rows then come from the written table and
    the input is not read again.
    """
    fixed = cut(df, "summary")
    bounds = fixed.agg(
        *[F.min(m).alias(f"lo_{m}") for m in columns], *[F.max(m).alias(f"hi_{m}") for m in columns]
    ).first()

    def norm(m: str):
        lo, hi = bounds[f"lo_{m}"], bounds[f"hi_{m}"]
        if lo is None:
            return F.lit(None).cast("double")
        return F.lit(0.0) if lo == hi else (F.col(m) - F.lit(lo)) / F.lit(hi - lo)

    return fixed.withColumns({f"{m}_norm": norm(m) for m in columns})


def difficulty(
    cube: DataFrame,
    landcover: DataFrame,
    c: DifficultyConfig,
    times: int | None = None,
    height=None,
    width=None,
    geo: tuple[float, float, float] = (0.0, 0.0, 1.0),
) -> DataFrame:
    """Difficulty index per patch with its three parts and both coordinate systems.

    Normalisation sees all patches; rows with a missing part are dropped after.
    """
    parts = ["heterogeneity", "phenology_variability", "cloud_persistence"]
    joined = shannon(landcover, c.patch, height, width).join(
        cube_metrics(cube, c, times, height, width), _PATCH
    )
    scored = min_max(joined, parts)
    index = add([F.lit(w) * F.col(f"{m}_norm") for w, m in zip(c.weights, parts)])
    placed = patch_coords(scored, c.patch, *geo).withColumn("difficulty_index", index)
    return placed.select("geo_y", "geo_x", *_PATCH, *parts, "difficulty_index").dropna("any")


STRATA = {
    "difficulty_index": "stratum",
    "heterogeneity": "spatial_stratum",
    "phenology_variability": "phenology_stratum",
    "cloud_persistence": "cloud_stratum",
}


def with_strata(df: DataFrame, keys: list[str] = _PATCH) -> DataFrame:
    """Low, Medium and High thirds of the index and of each of its parts.

    All four rankings share one sort of the long form.
    """
    metrics = list(STRATA)
    long = df.select(*keys, *metrics).unpivot(keys, metrics, "kind", "value")
    ranked = ordered_rank(long, ["value", *keys], by=["kind"])
    labels = ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("kind") == m, tercile(F.col("rank"), F.col("n")))).alias(label)
            for m, label in STRATA.items()
        ]
    )
    return df.join(labels, keys)


def land_cover_names() -> dict[int, str]:
    return {lc: name for lc, name, _ in LAND_COVER}

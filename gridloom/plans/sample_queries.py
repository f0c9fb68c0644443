"""Sample construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.config import DEFAULT_LEGEND, SampleConfig
from gridloom.operators import cube as cube_ops
from gridloom.operators import patches, samples
from gridloom.plans.ctes import r6 as q6
from gridloom.plans.ctes import drawn, mixed, sql_over
from gridloom.plans.registry import query, r6
from gridloom.schemas import FEATURE_BANDS, SAMPLE_KEY
from gridloom.sources import derived, tables, workspace

C = SampleConfig(patch=derived.PATCH, window=derived.WINDOW, min_pristine=0.5)
T = derived.FRAMES
_PATCH = ["y_coord", "x_coord"]
_K = "split, y_coord, x_coord, t_start"

_AT = "y_coord, x_coord, t_start"
_CUT = """CASE WHEN r <= CAST(floor(n * 7e-1) AS BIGINT) THEN 'train'
  WHEN r <= CAST(floor(n * 7e-1) AS BIGINT) + CAST(floor(n * 15e-2) AS BIGINT) THEN 'val' ELSE 'test' END"""
_PATCHES = """SELECT CAST(y AS INT) AS y_coord, CAST(x AS INT) AS x_coord
  FROM (SELECT unnest(range(0, h, 8)) AS y FROM shape), (SELECT unnest(range(0, 64, 8)) AS x)"""
_SPLIT = f"""SELECT {_CUT} AS split, y_coord, x_coord FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {mixed('split', 'y_coord, x_coord')}, y_coord, x_coord) AS r FROM patches)"""
_STARTS = """SELECT split, y_coord, x_coord, CAST(unnest(CASE WHEN split = 'train' THEN range(0, 9) ELSE range(0, 9, 4) END) AS INT) AS t_start
  FROM parts"""
_SAMPLES = f"""SELECT {_K}, row_number() OVER (PARTITION BY split ORDER BY {mixed('order', _AT)}, y_coord, x_coord, t_start) - 1 AS seq FROM starts"""
_FRAMES = """SELECT CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord, t,
  count(*) FILTER (usability IN (1, 2, 3, 4)) / 64e0 AS bad, count(*) FILTER (usability = 0) / 64e0 AS pristine
  FROM cube GROUP BY 1, 2, 3"""
_TARGETS = f"""SELECT {_K}, seq, t AS t_target, bad AS bad_fraction, pristine AS pristine_fraction FROM (
  SELECT s.*, w.t, coalesce(bad, 0) AS bad, coalesce(pristine, 0) AS pristine
  FROM samples s JOIN (SELECT CAST(unnest(range(12)) AS INT) AS t) w ON w.t BETWEEN t_start AND t_start + 3
  LEFT JOIN frames f ON s.y_coord = f.y_coord AND s.x_coord = f.x_coord AND w.t = f.t)
  QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY bad, t) = 1"""
_DONORS = f"""SELECT *, CAST(d + CASE WHEN d >= t_target THEN 1 ELSE 0 END AS INT) AS t_donor FROM (
  SELECT *, t_start + {drawn(mixed('donor', _AT), 0, 3)} AS d FROM targets WHERE pristine_fraction >= 5e-1)"""
_N = {b: f"(({b} - -1e-2) / 161e-2)" for b in FEATURE_BANDS}
_CELLS = f"""SELECT s.split, s.y_coord, s.x_coord, s.t_start, s.t_target, s.t_donor, c.t, c.y, c.x, c.usability,
  c.t = s.t_target AS is_target, {", ".join(f"({b} - -1e-2) / (16e-1 - -1e-2) AS {b}" for b in FEATURE_BANDS)}
  FROM donors s JOIN (SELECT *, CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord FROM dense) c
  ON s.y_coord = c.y_coord AND s.x_coord = c.x_coord AND c.t BETWEEN s.t_start AND s.t_start + 3"""
_GAPS = """SELECT c.*, c.is_target AND d.usability <> 0 AS gap FROM cells c JOIN cells d
  ON c.split = d.split AND c.y_coord = d.y_coord AND c.x_coord = d.x_coord AND c.t_start = d.t_start
  AND c.y = d.y AND c.x = d.x AND d.t = d.t_donor"""
_BUILT = (
    f"SELECT {_K}, t, y, x, usability, is_target, gap, "
    + ", ".join(f"CASE WHEN gap THEN 0 ELSE coalesce({b}, 0) END AS in_{b}" for b in FEATURE_BANDS)
    + ", "
    + ", ".join(f"CASE WHEN is_target THEN coalesce({b}, 0) END AS target_{b}" for b in FEATURE_BANDS)
    + ", "
    + ", ".join(f"CASE WHEN is_target THEN usability = 0 AND {b} IS NOT NULL END AS valid_{b}" for b in FEATURE_BANDS)
    + " FROM gaps"
)
# in dependency order, for sql_over
PLAN = {"patches": _PATCHES, "parts": _SPLIT, "starts": _STARTS, "samples": _SAMPLES}
GATED = {**PLAN, "frames": _FRAMES, "targets": _TARGETS, "donors": _DONORS}
BUILT = {**GATED, "cells": _CELLS, "gaps": _GAPS, "built": _BUILT}


def plan(spark, d):
    height, width = derived.grid_shape(spark, d)
    return samples.plan_samples(spark, height, width, T, C)


def dense(spark, d):
    height, width = derived.grid_shape(spark, d)
    return cube_ops.densify(derived.cube(spark, d), height, width, T)


def targets(spark, d):
    return samples.target_frame(plan(spark, d), samples.frames(derived.cube(spark, d), C), C)


def gated(spark, d):
    return samples.pristine_gate(targets(spark, d), C)


def cells(spark, d):
    kept = samples.donor_frame(gated(spark, d), C)
    scaled = samples.normalised_inputs(derived.cube(spark, d), C)
    return samples.sample_cells(samples.series(scaled, T, C, derived.grid_shape(spark, d)), kept, C)


def built(spark, d):
    shape = derived.grid_shape(spark, d)
    planned = samples.plan_samples(spark, *shape, T, C)
    return samples.build_samples(derived.cube(spark, d), planned, T, C, shape)


def _patches(spark, d):
    height, width = derived.grid_shape(spark, d)
    return patches.patch_grid(spark, height, width, C.patch)


@query("o_f1_spatial_split", sql_over("shape", "SELECT split, y_coord, x_coord FROM parts", patches=_PATCHES, parts=_SPLIT))
def spatial_split(spark, d):
    return samples.spatial_split(_patches(spark, d), C)


@query(
    "o_f2_sample_split",
    sql_over(
        "shape",
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT {_CUT} AS split, y_coord, x_coord, t_start FROM (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {mixed('split', _AT)}, y_coord, x_coord, t_start) AS r FROM (
  SELECT *, CAST(unnest(range(0, 9, {stride})) AS INT) AS t_start FROM patches))) WHERE split = '{name}'"""
            for name, stride in (("train", 1), ("val", 4), ("test", 4))
        ),
        patches=_PATCHES,
    ),
)
def sample_split(spark, d):
    return samples.sample_split(_patches(spark, d), T, C)


@query("o_f3_temporal_starts", sql_over("shape", f"SELECT {_K} FROM starts", **PLAN))
def temporal_starts(spark, d):
    return samples.temporal_starts(samples.spatial_split(_patches(spark, d), C), T, C)


@query("o_f3b_shuffle_order", sql_over("shape", f"SELECT {_K}, seq FROM samples", **PLAN))
def shuffle_order(spark, d):
    return plan(spark, d).select(*SAMPLE_KEY, "seq")


@query(
    "o_f3b_epoch_order",
    sql_over(
        "shape",
        f"""SELECT {_K}, row_number() OVER (PARTITION BY split ORDER BY {mixed('order', _AT, "CASE WHEN split = 'train' THEN 3 ELSE 0 END")},
  y_coord, x_coord, t_start) - 1 AS seq FROM starts""",
        **PLAN,
    ),
)
def epoch_order(spark, d):
    starts = samples.temporal_starts(samples.spatial_split(_patches(spark, d), C), T, C)
    return samples.shuffle_order(starts, C.seed, epoch=3).select(*SAMPLE_KEY, "seq")


@query(
    "o_f4_window_cells",
    sql_over(
        "shape cube",
        f"""SELECT s.split, s.y_coord, s.x_coord, s.t_start, c.t, count(*) AS n, count(b01) AS n01
  FROM samples s JOIN cube c ON c.y // 8 * 8 = s.y_coord AND c.x // 8 * 8 = s.x_coord
  AND c.t BETWEEN s.t_start AND s.t_start + 3 GROUP BY ALL""",
        **PLAN,
    ),
)
def window_cells(spark, d):
    found = samples.frame_cells(derived.cube(spark, d), plan(spark, d), C)
    return found.groupBy(*SAMPLE_KEY, "t").agg(F.count("*").alias("n"), F.count("b01").alias("n01"))


@query(
    "o_f5_feature_bands",
    sql_over("cube", f"SELECT t, y, x, {', '.join(f'round({b}, 6) AS {b}' for b in FEATURE_BANDS)}, usability FROM cube"),
)
def feature_bands(spark, d):
    return derived.cube(spark, d).select(
        "t", "y", "x", *[F.round(b, 6).alias(b) for b in C.bands], "usability"
    )


@query(
    "o_f6_legend",
    sql_over(
        "cube",
        """SELECT usability, n, coalesce(name, 'other') AS name FROM (
  SELECT usability, count(*) AS n FROM cube GROUP BY usability) u LEFT JOIN (
  SELECT CAST(trim(split_part(p, '=', 1)) AS INT) AS code, trim(split_part(p, '=', 2)) AS name FROM (
    SELECT unnest(string_split('0=Pristine, 1=Shadow, 2=Hazy, 3=Contaminated, 4=Cloud', ', ')) AS p)) l ON u.usability = l.code""",
    ),
)
def legend(spark, d):
    counts = derived.cube(spark, d).groupBy("usability").agg(F.count("*").alias("n"))
    codes = samples.parse_legend(F.lit(DEFAULT_LEGEND))
    names = F.map_from_arrays(F.map_values(codes), F.map_keys(codes))
    name = F.try_element_at(names, F.col("usability").cast("int"))
    return counts.select("usability", "n", F.coalesce(name, F.lit("other")).alias("name"))


@query(
    "o_f7_target_frame",
    sql_over("shape cube", f"SELECT {_K}, t_target, {q6('bad_fraction')} AS bad_fraction FROM targets", **GATED),
)
def target_frame(spark, d):
    return targets(spark, d).select(*SAMPLE_KEY, "t_target", r6("bad_fraction"))


@query(
    "o_f8_pristine_gate",
    sql_over(
        "shape cube",
        f"SELECT {_K}, t_target, {q6('pristine_fraction')} AS pristine_fraction FROM targets WHERE pristine_fraction >= 5e-1",
        **GATED,
    ),
)
def pristine_gate(spark, d):
    return gated(spark, d).select(*SAMPLE_KEY, "t_target", r6("pristine_fraction"))


@query(
    "o_f9_normalise",
    sql_over("cube", "SELECT t, y, x, round((b01 - -1e-2) / (16e-1 - -1e-2), 6) AS b01, round((b06 - -1e-2) / (16e-1 - -1e-2), 6) AS b06 FROM cube"),
)
def normalise(spark, d):
    scaled = samples.normalised_inputs(derived.cube(spark, d), C)
    return scaled.select("t", "y", "x", F.round("b01", 6).alias("b01"), F.round("b06", 6).alias("b06"))


@query(
    "o_f10_missing_to_zero",
    sql_over("cube", "SELECT t, y, x, round(coalesce((b01 - -1e-2) / (16e-1 - -1e-2), 0), 6) AS b01 FROM cube"),
)
def missing_to_zero(spark, d):
    scaled = samples.normalised_inputs(derived.cube(spark, d), C)
    return scaled.select("t", "y", "x", F.round(F.coalesce("b01", F.lit(0.0)), 6).alias("b01"))


@query(
    "o_f11_sanitise",
    sql_over("cube", "SELECT t, y, x, round(greatest(0, least(1, coalesce(b01, 0))), 6) AS b01 FROM cube"),
)
def sanitise(spark, d):
    clipped = samples.sanitised_inputs(derived.cube(spark, d), C)
    return clipped.select("t", "y", "x", F.round("b01", 6).alias("b01"))


@query(
    "o_f12_synthetic_gaps",
    sql_over(
        "shape dense",
        f"SELECT {_K}, t, y, x, gap, " + ", ".join(f"{q6(f'in_{b}')} AS in_{b}" for b in FEATURE_BANDS) + " FROM built WHERE is_target",
        once="dense built",
        **BUILT,
    ),
)
def synthetic_gaps(spark, d):
    at = F.col("t_target") - F.col("t_start")
    return built(spark, d).select(
        *SAMPLE_KEY,
        F.col("t_target").alias("t"),
        "y",
        "x",
        "gap",
        *[r6(F.get(f"in_{b}", at), f"in_{b}") for b in C.bands],
    )


@query(
    "o_f13_valid_mask",
    sql_over(
        "shape dense",
        f"SELECT {_K}, {', '.join(f'count(*) FILTER (valid_{b}) AS {b}' for b in FEATURE_BANDS)} FROM built WHERE is_target GROUP BY {_K}",
        **BUILT,
    ),
)
def valid_mask(spark, d):
    return built(spark, d).groupBy(*SAMPLE_KEY).agg(*[F.count_if(f"valid_{b}").alias(b) for b in C.bands])


@query("o_f14_valid_pixels", sql_over("cube", "SELECT t, y, x, usability = 0 AS valid FROM cube"))
def valid_pixels(spark, d):
    return samples.valid_pixels(derived.cube(spark, d), C).select("t", "y", "x", "valid")


_FLIPPED = f"""SELECT {_K}, t, k, CASE WHEN v = 1 THEN 7 - (y - y_coord) ELSE y - y_coord END AS ly,
  CASE WHEN h = 1 THEN 7 - (x - x_coord) ELSE x - x_coord END AS lx, b01 FROM (
  SELECT *, {drawn(mixed('augment', _AT), 0, 2)} AS h, {drawn(mixed('augment', _AT), 1, 2)} AS v, {drawn(mixed('augment', _AT), 2, 4)} AS k FROM cells WHERE split = 'train')"""


@query(
    "o_f15_augment",
    sql_over(
        "shape dense",
        f"""SELECT {_K}, t,
  CAST(y_coord + CASE k WHEN 0 THEN ly WHEN 1 THEN 7 - lx WHEN 2 THEN 7 - ly ELSE lx END AS INT) AS y,
  CAST(x_coord + CASE k WHEN 0 THEN lx WHEN 1 THEN ly WHEN 2 THEN 7 - lx ELSE 7 - ly END AS INT) AS x,
  round(b01, 6) AS b01 FROM flipped
  UNION ALL SELECT {_K}, t, y, x, round(b01, 6) FROM cells WHERE split <> 'train'""",
        **{k: v for k, v in BUILT.items() if k not in ("gaps", "built")},
        flipped=_FLIPPED,
    ),
)
def augment(spark, d):
    moved = samples.augment(cells(spark, d), C, C.seed)
    frames = moved.select(*SAMPLE_KEY, "y", "x", F.posexplode("b01").alias("k", "b01"))
    return frames.select(
        *SAMPLE_KEY, (F.col("t_start") + F.col("k")).alias("t"), "y", "x", F.round("b01", 6).alias("b01")
    )


@query(
    "o_f16_chips",
    sql_over(
        "cube",
        f"""SELECT y_coord, x_coord, s.t, s.band, s.pos, round(coalesce(v, 0), 4) AS v FROM (
  SELECT DISTINCT CAST(y // 8 * 8 AS INT) AS y_coord, CAST(x // 8 * 8 AS INT) AS x_coord, t FROM cube) p,
  LATERAL (SELECT p.t AS t, band, CAST(pos AS INT) AS pos FROM (SELECT unnest(['b01', 'b02']) AS band), (SELECT unnest(range(64)) AS pos)) s
  LEFT JOIN (SELECT t, y, x, 'b01' AS band, b01 AS v FROM cube UNION ALL SELECT t, y, x, 'b02', b02 FROM cube) c
  ON c.t = s.t AND c.band = s.band AND c.y = y_coord + s.pos // 8 AND c.x = x_coord + s.pos % 8""",
    ),
)
def chips(spark, d):
    keyed = patches.with_patch(derived.cube(spark, d), C.patch)
    made = samples.to_chips(keyed, ["b01", "b02"], C.patch, [*_PATCH, "t"])
    flat = made.select(*_PATCH, "t", "band", F.posexplode("pixels").alias("pos", "v"))
    return flat.withColumn("v", F.round(F.col("v").cast("double"), 4))


@query(
    "o_f17_attach_stratum",
    sql_over(
        "shape pdiff",
        f"""SELECT s.split, s.y_coord, s.x_coord, s.t_start, coalesce(stratum, 'Unknown') AS difficulty_stratum FROM samples s LEFT JOIN (
  SELECT y_coord, x_coord, CASE WHEN difficulty_index < 1 THEN 'Low' ELSE 'High' END AS stratum FROM pdiff
  WHERE heterogeneity > 0.2) d ON s.y_coord = d.y_coord AND s.x_coord = d.x_coord""",
        **PLAN,
    ),
)
def attach_stratum(spark, d):
    strata = derived.patch_difficulty(spark, d).filter("heterogeneity > 0.2D").select(
        *_PATCH, F.when(F.col("difficulty_index") < 1, "Low").otherwise("High").alias("stratum")
    )
    return samples.attach_stratum(plan(spark, d), strata).select(*SAMPLE_KEY, "difficulty_stratum")


@query(
    "o_f18_batches",
    sql_over(
        "shape cube",
        f"SELECT {_K}, seq // 4 AS batch, CAST(seq % 4 AS INT) AS slot FROM targets WHERE pristine_fraction >= 5e-1",
        **GATED,
    ),
)
def batches(spark, d):
    return samples.batches(gated(spark, d), 4).select(*SAMPLE_KEY, "batch", "slot")


@query("o_f19_split_index", sql_over("shape", f"SELECT {_K}, seq FROM samples", **PLAN))
def split_index(spark, d):
    path = workspace.new_path(spark, "splits")
    tables.write_by(plan(spark, d), path, "split", fmt="json")
    schema = "y_coord INT, x_coord INT, t_start INT, seq BIGINT, split STRING"
    return spark.read.schema(schema).json(path).select(*SAMPLE_KEY, "seq")


@query("o_f19_split_summary", sql_over("shape", "SELECT split, count(*) AS samples FROM samples GROUP BY split", **PLAN))
def split_summary(spark, d):
    return samples.split_summary(plan(spark, d))


_BATCHED = f"""SELECT {_K}, seq // 4 AS batch, row_number() OVER (PARTITION BY split, seq // 4 ORDER BY seq) - 1 AS slot,
  count(*) OVER (PARTITION BY split, seq // 4) AS n FROM targets WHERE pristine_fraction >= 5e-1"""


@query(
    "o_f20_pad_batches",
    sql_over(
        "shape cube",
        f"""SELECT {_K}, batch, place FROM batched b JOIN (SELECT unnest(range(6)) AS place) p ON p.place % b.n = b.slot""",
        **GATED,
        batched=_BATCHED,
    ),
)
def pad_batches(spark, d):
    keys = ["split", "batch"]
    compact = samples.compact_slots(samples.batches(gated(spark, d), 4), keys, "slot")
    return samples.pad_batches(compact, keys, "slot", 6).select(*SAMPLE_KEY, "batch", "place")


@query(
    "o_f21_last_frame",
    sql_over(
        "shape dense",
        f"SELECT {_K}, y, x, " + ", ".join(f"{q6(f'in_{b}')} AS target_{b}" for b in FEATURE_BANDS) + " FROM built WHERE t = t_start + 3",
        once="dense built",
        **BUILT,
    ),
)
def last_frame(spark, d):
    return samples.last_frame_target(built(spark, d), C).select(
        *SAMPLE_KEY, "y", "x", *[r6(f"target_{b}") for b in C.bands]
    )


@query("o_f22_shards", sql_over("shape", f"SELECT {_K}, CAST(seq % 3 AS INT) AS rank FROM samples", **PLAN))
def shards(spark, d):
    return samples.shard(plan(spark, d), 3).select(*SAMPLE_KEY, "rank")


@query(
    "o_f22_padded_shards",
    sql_over(
        "shape",
        f"""SELECT s.split, s.y_coord, s.x_coord, s.t_start, CAST(i % 5 AS INT) AS rank, i AS seq FROM (
  SELECT split, n, unnest(range(CAST(ceil(n / 5e0) * 5 AS BIGINT))) AS i FROM (SELECT split, count(*) AS n FROM samples GROUP BY split)) p
  JOIN samples s ON s.split = p.split AND s.seq = p.i % p.n""",
        **PLAN,
    ),
)
def padded_shards(spark, d):
    return samples.padded_shards(plan(spark, d), 5).select(*SAMPLE_KEY, "rank", "seq")

"""Gap-filling and scoring queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import evaluation, impute, intrinsic, metrics
from gridloom.operators.patches import with_patch
from gridloom.plans import sample_queries as sq
from gridloom.plans.ctes import r6 as q6
from gridloom.plans.ctes import sql_over
from gridloom.plans.registry import query, r6
from gridloom.schemas import FEATURE_BANDS, SAMPLE_KEY
from gridloom.sources import derived

_S = ", ".join(SAMPLE_KEY)
_KEYS = ["model", "y_coord", "x_coord", "t"]
_K = ", ".join(_KEYS)
_N = range(1, 7)

_SQ = {b: f"(p{b} - t{b}) * (p{b} - t{b})" for b in _N}
_VALID_SUM = " + ".join(f"sum(CASE WHEN v{b} THEN {_SQ[b]} ELSE 0 END)" for b in _N)
_VALID_N = " + ".join(f"count(*) FILTER (v{b})" for b in _N)
_MSE = (
    f"CASE WHEN {_VALID_N} > 0 THEN ({_VALID_SUM}) / ({_VALID_N}) "
    f"ELSE ({' + '.join(f'sum({_SQ[b]})' for b in _N)}) / (6e0 * count(*)) END"
)
_COS = (
    f"({' + '.join(f'p{b} * t{b}' for b in _N)}) / (sqrt({' + '.join(f'p{b} * p{b}' for b in _N)}) "
    f"* sqrt({' + '.join(f't{b} * t{b}' for b in _N)}) + 1e-8)"
)
_SAM = f"coalesce(avg(acos(greatest(-1e0, least(1e0, {_COS})))) FILTER ({' AND '.join(f'v{b}' for b in _N)}), 0)"


def score_ctes(keys: str, source: str = "preds") -> dict[str, str]:
    """Pixel scores and similarity of the predictions in ``source`` per sample."""
    pixel = f"SELECT {keys}, sqrt({_MSE}) AS rmse, {_SAM} AS sam FROM {source} GROUP BY {keys}"
    long = " UNION ALL ".join(
        f"SELECT {keys}, y - y_coord AS ly, x - x_coord AS lx, {b} AS band, p{b} AS p, t{b} AS q FROM {source}" for b in _N
    )
    box = f"""SELECT {keys}, band, dy, dx, sum(p) / 49 AS mp, sum(q) / 49 AS mt, sum(p * p) / 49 AS pp, sum(q * q) / 49 AS tt,
  sum(p * q) / 49 AS pt FROM long JOIN (SELECT unnest([0, 0, 1, 1]) AS dy, unnest([0, 1, 0, 1]) AS dx) o
  ON ly BETWEEN dy AND dy + 6 AND lx BETWEEN dx AND dx + 6 GROUP BY ALL"""
    ssims = f"""SELECT {keys}, avg(((2 * mp * mt + 1e-4) * (2 * (49 / 48e0) * (pt - mp * mt) + 9e-4)) /
  ((mp * mp + mt * mt + 1e-4) * ((49 / 48e0) * (pp - mp * mp) + (49 / 48e0) * (tt - mt * mt) + 9e-4))) AS ssim
  FROM box GROUP BY {keys}"""
    return {"pixel": pixel, "long": long, "box": box, "ssims": ssims}


_SCORED = score_ctes(_K)
_PIXEL = _SCORED["pixel"]
_SSIM_WITH = {k: _SCORED[k] for k in ("long", "box", "ssims")}
_PSNR = "CASE WHEN rmse > 0 THEN 20e0 * log10(1e0 / rmse) ELSE CAST('inf' AS DOUBLE) END"


def _scores(spark, d):
    return metrics.pixel_scores(derived.predictions(spark, d), _KEYS, FEATURE_BANDS)


@query(
    "o_h1_temporal_median",
    sql_over(
        "shape dense",
        f"SELECT {_S}, y, x, "
        + ", ".join(
            f"{q6(f'list_sort(list(in_{b}))[2]')} AS pred_{b}, {q6(f'max(target_{b})')} AS target_{b}, bool_or(valid_{b}) AS valid_{b}"
            for b in FEATURE_BANDS
        )
        + f" FROM built GROUP BY {_S}, y, x",
        **sq.BUILT,
    ),
)
def temporal_median(spark, d):
    filled = impute.temporal_median(sq.built(spark, d), sq.C)
    columns = [c for b in FEATURE_BANDS for c in (r6(f"pred_{b}"), r6(f"target_{b}"), F.col(f"valid_{b}"))]
    return filled.select(*SAMPLE_KEY, "y", "x", *columns)


@query(
    "o_h2_oracle_frame",
    sql_over(
        "shape dense",
        f"""SELECT {_S}, t, {q6('mse')} AS frame_mse FROM (
  SELECT {", ".join(f"b.{k}" for k in SAMPLE_KEY)}, b.t,
    avg(({" + ".join(f"(b.in_{b} - g.target_{b}) ** 2" for b in FEATURE_BANDS)}) / 6) AS mse
  FROM built b JOIN built g ON g.is_target AND {" AND ".join(f"b.{k} = g.{k}" for k in [*SAMPLE_KEY, "y", "x"])}
  GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_S} ORDER BY mse, t) = 1""",
        **sq.BUILT,
    ),
)
def oracle_frame(spark, d):
    return impute.best_frames(sq.built(spark, d), sq.C).withColumn("frame_mse", r6("frame_mse"))


_BEST = f"""SELECT {_S}, t, mse FROM (
  SELECT {", ".join(f"b.{k}" for k in SAMPLE_KEY)}, b.t,
    avg(({" + ".join(f"(b.in_{b} - g.target_{b}) ** 2" for b in FEATURE_BANDS)}) / 6) AS mse
  FROM built b JOIN built g ON g.is_target AND {" AND ".join(f"b.{k} = g.{k}" for k in [*SAMPLE_KEY, "y", "x"])}
  GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_S} ORDER BY mse, t) = 1"""
_BS = ", ".join(f"b.{k}" for k in SAMPLE_KEY)


def _filled(model: str, value: str, join: str = "") -> str:
    """Predicted, true and valid values per cell of one filler; ``value`` has the band as {b}."""
    columns = [f"{value.format(b=b)} AS p{i}" for i, b in enumerate(FEATURE_BANDS, 1)]
    columns += [f"max(target_{b}) AS t{i}" for i, b in enumerate(FEATURE_BANDS, 1)]
    columns += [f"bool_or(valid_{b}) AS v{i}" for i, b in enumerate(FEATURE_BANDS, 1)]
    return f"SELECT '{model}' AS model, {_BS}, y, x, {', '.join(columns)} FROM built b {join} GROUP BY {_BS}, y, x"


_BEST_FRAME = _filled(
    "oracle", "max(in_{b}) FILTER (b.t = o.t)", "JOIN best o ON " + " AND ".join(f"b.{k} = o.{k}" for k in SAMPLE_KEY)
)
_FILLED = " UNION ALL ".join(
    [_filled("median", "list_sort(list(in_{b}))[2]"), _BEST_FRAME, _filled("mean", "avg(in_{b})")]
)


@query(
    "o_h2_oracle_cells",
    sql_over(
        "shape dense",
        f"SELECT {_S}, y, x, " + ", ".join(f"round(p{i}, 6) AS pred_{b}, round(t{i}, 6) AS target_{b}, v{i} AS valid_{b}" for i, b in enumerate(FEATURE_BANDS, 1)) + " FROM filled",
        **sq.BUILT,
        best=_BEST,
        filled=_BEST_FRAME,
    ),
)
def oracle_cells(spark, d):
    filled = impute.oracle_frame(sq.built(spark, d), sq.C)
    columns = [c for b in FEATURE_BANDS for c in (F.round(f"pred_{b}", 6).alias(f"pred_{b}"), F.round(f"target_{b}", 6).alias(f"target_{b}"), F.col(f"valid_{b}"))]
    return filled.select(*SAMPLE_KEY, "y", "x", *columns)


def evaluated(spark, d):
    """Median, best frame and a user's function on the test samples."""
    fillers = {
        "median": lambda cells: impute.temporal_median(cells, sq.C),
        "oracle": lambda cells: impute.oracle_frame(cells, sq.C),
        "mean": lambda cells: impute.predict_cells(cells, sq.C, lambda stack: stack.mean(axis=2)),
    }
    strata = intrinsic.with_strata(derived.patch_difficulty(spark, d))
    return evaluation.evaluate(
        derived.cube(spark, d), sq.plan(spark, d), strata, fillers, sq.T, sq.C, derived.grid_shape(spark, d)
    )


_EVAL_KEYS = f"model, {_S}"
_EVAL_WITH = {**sq.BUILT, "best": _BEST, "filled": f"SELECT * FROM ({_FILLED}) WHERE split = 'test'", **score_ctes(_EVAL_KEYS, "filled")}
_EVAL_SCORES = f"""SELECT p.*, {_PSNR} AS psnr, s.ssim FROM pixel p JOIN ssims s
  ON {" AND ".join(f"p.{k} = s.{k}" for k in ["model", *SAMPLE_KEY])}"""


@query(
    "o_i0_evaluation_scores",
    sql_over(
        "shape dense",
        f"SELECT {_EVAL_KEYS}, {q6('rmse')} AS rmse, {q6('psnr')} AS psnr, {q6('ssim')} AS ssim, {q6('sam')} AS sam FROM ({_EVAL_SCORES})",
        **_EVAL_WITH,
    ),
)
def evaluation_scores(spark, d):
    return evaluated(spark, d)["scores"].select("model", *SAMPLE_KEY, *[r6(m) for m in ("rmse", "psnr", "ssim", "sam")])


def _frame_mean(batch: np.ndarray) -> np.ndarray:
    """Stand-in for a user's network: the mean over the four input frames."""
    rows = batch.reshape(len(batch), 6, 4, -1)
    return rows.astype(np.float64).mean(axis=2).reshape(len(batch), -1)


@query(
    "o_h3_predict",
    sql_over(
        "shape dense",
        " UNION ALL ".join(
            f"SELECT {_S}, CAST({i} * 64 + (y - y_coord) * 8 + x - x_coord AS INT) AS pos, round(avg(in_{b}), 4) AS v FROM built GROUP BY {_S}, y, x"
            for i, b in enumerate(FEATURE_BANDS)
        ),
        **sq.BUILT,
    ),
)
def predict(spark, d):
    made = impute.predict(impute.stack_inputs(sq.built(spark, d), sq.C), _frame_mean)
    flat = made.select(*SAMPLE_KEY, F.posexplode("output").alias("pos", "v"))
    return flat.withColumn("v", F.round(F.col("v").cast("double"), 4))


@query(
    "o_h3_predict_cells",
    sql_over(
        "shape dense",
        f"SELECT {_S}, y, x, "
        + ", ".join(f"{q6(f'avg(in_{b})')} AS pred_{b}, {q6(f'max(target_{b})')} AS target_{b}" for b in FEATURE_BANDS)
        + f" FROM built GROUP BY {_S}, y, x",
        **sq.BUILT,
    ),
)
def predict_cells(spark, d):
    made = impute.predict_cells(sq.built(spark, d), sq.C, lambda stack: stack.mean(axis=2))
    return made.select(*SAMPLE_KEY, "y", "x", *[r6(f"{k}_{b}") for b in FEATURE_BANDS for k in ("pred", "target")])


@query("o_h4_rmse", sql_over("preds", f"SELECT {_K}, {q6('rmse')} AS rmse FROM pixel", pixel=_PIXEL))
def rmse(spark, d):
    return _scores(spark, d).select(*_KEYS, r6("rmse"))


@query("o_h5_psnr", sql_over("preds", f"SELECT {_K}, {q6(_PSNR)} AS psnr FROM pixel", pixel=_PIXEL))
def psnr(spark, d):
    return _scores(spark, d).select(*_KEYS, r6("psnr"))


@query("o_h6_ssim", sql_over("preds", f"SELECT {_K}, {q6('ssim')} AS ssim FROM ssims", **_SSIM_WITH))
def ssim(spark, d):
    found = metrics.ssim(derived.predictions(spark, d), _KEYS, FEATURE_BANDS, derived.PATCH)
    return found.select(*_KEYS, r6("ssim"))


@query("o_h7_sam", sql_over("preds", f"SELECT {_K}, {q6('sam')} AS sam FROM pixel", pixel=_PIXEL))
def sam(spark, d):
    return _scores(spark, d).select(*_KEYS, r6("sam"))


@query(
    "o_h8_score",
    sql_over(
        "preds",
        f"""SELECT p.model, p.y_coord, p.x_coord, p.t, {q6('rmse')} AS rmse, {q6(_PSNR)} AS psnr, {q6('ssim')} AS ssim, {q6('sam')} AS sam
  FROM pixel p JOIN ssims s ON p.model = s.model AND p.y_coord = s.y_coord AND p.x_coord = s.x_coord AND p.t = s.t""",
        pixel=_PIXEL,
        **_SSIM_WITH,
    ),
)
def score(spark, d):
    scored = metrics.score(derived.predictions(spark, d), _KEYS, FEATURE_BANDS, derived.PATCH)
    return scored.select(*_KEYS, *[r6(m) for m in ("rmse", "psnr", "ssim", "sam")])


_WIDE = "SELECT * REPLACE (CAST(y // 64 * 64 AS INT) AS y_coord, CAST(x // 64 * 64 AS INT) AS x_coord) FROM preds"
_MOMENTS = {"mp": "p", "mt": "q", "pp": "p * p", "tt": "q * q", "pt": "p * q"}
_WIDE_WITH = {
    "wide": _WIDE,
    **{k: v for k, v in score_ctes(_K, "wide").items() if k in ("pixel", "long")},
    "whole": f"""SELECT s.*, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (
  SELECT * FROM (SELECT DISTINCT {_K} FROM wide), (SELECT unnest(range(64)) AS ly), (SELECT unnest(range(64)) AS lx), (SELECT unnest(range(1, 7)) AS band)) s
  LEFT JOIN long l ON {" AND ".join(f"s.{k} = l.{k}" for k in [*_KEYS, "ly", "lx", "band"])}""",
    "across": f"""SELECT {_K}, band, ly, lx, {", ".join(f"sum({v}) OVER w AS {k}" for k, v in _MOMENTS.items())} FROM whole
  WINDOW w AS (PARTITION BY {_K}, band, ly ORDER BY lx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "box": f"""SELECT * FROM (SELECT {_K}, band, ly, lx, {", ".join(f"sum({k}) OVER w / 49 AS {k}" for k in _MOMENTS)} FROM across
  WINDOW w AS (PARTITION BY {_K}, band, lx ORDER BY ly ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE ly >= 6 AND lx >= 6""",
    "ssims": score_ctes(_K)["ssims"],
}


@query(
    "o_h8_score_wide",
    sql_over(
        "preds",
        f"""SELECT {", ".join(f"p.{k}" for k in _KEYS)}, {q6('rmse')} AS rmse, {q6(_PSNR)} AS psnr, {q6('ssim')} AS ssim, {q6('sam')} AS sam
  FROM pixel p JOIN ssims s ON {" AND ".join(f"p.{k} = s.{k}" for k in _KEYS)}""",
        **_WIDE_WITH,
    ),
)
def score_wide(spark, d):
    """Patches as wide as the grid, cut off at its lower edge."""
    cells = with_patch(derived.predictions(spark, d).drop("y_coord", "x_coord"), 64)
    scored = metrics.score(cells, _KEYS, FEATURE_BANDS, 64)
    return scored.select(*_KEYS, *[r6(m) for m in ("rmse", "psnr", "ssim", "sam")])


_ABS = " + ".join(f"sum(CASE WHEN v{b} THEN abs(p{b} - t{b}) ELSE 0 END)" for b in _N)
_CELL_SUM = " + ".join(f"sum(CASE WHEN v1 THEN {_SQ[b]} ELSE 0 END)" for b in _N)


@query(
    "o_h9_masked_loss",
    sql_over(
        "preds",
        f"""SELECT model, t, round(({_VALID_SUM}) / ({_VALID_N}) + 1e-9, 6) AS mse, round(({_ABS}) / ({_VALID_N}) + 1e-9, 6) AS l1,
  round(({_CELL_SUM}) / (count(*) FILTER (v1)) + 1e-9, 6) AS per_pixel FROM preds GROUP BY model, t""",
    ),
)
def masked_loss(spark, d):
    cells = derived.predictions(spark, d).withColumn("valid", F.col("valid_b01"))
    by = ["model", "t"]
    parts = [
        metrics.masked_loss(cells, FEATURE_BANDS, "mse", by).withColumnRenamed("loss", "mse"),
        metrics.masked_loss(cells, FEATURE_BANDS, "l1", by).withColumnRenamed("loss", "l1"),
        metrics.masked_loss(cells, FEATURE_BANDS, "mse", by, "pixels").withColumnRenamed("loss", "per_pixel"),
    ]
    joined = parts[0].join(parts[1], by).join(parts[2], by)
    return joined.select(*by, r6("mse"), r6("l1"), r6("per_pixel"))

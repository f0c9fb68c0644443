import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import SampleConfig
from gridloom.operators import impute, metrics

BANDS = ["b01", "b02", "b03"]
KEYS = ["model", "y_coord", "x_coord"]


def _cells(spark, pred, target, valid, model="m"):
    """Arrays of shape (band, row, column)."""
    p = pred.shape[1]
    rows = [
        (model, 0, 0, y, x, *map(float, pred[:, y, x]), *map(float, target[:, y, x]), *map(bool, valid[:, y, x]))
        for y, x in np.ndindex(p, p)
    ]
    names = [f"{k}_{b} {t}" for k, t in (("pred", "DOUBLE"), ("target", "DOUBLE"), ("valid", "BOOLEAN")) for b in BANDS]
    return spark.createDataFrame(rows, "model STRING, y_coord INT, x_coord INT, y INT, x INT, " + ", ".join(names))


def _ssim(a, b):
    """Mean over all full 7 by 7 windows, sample covariance, one band after the other."""
    scores = []
    for p, t in zip(a, b):
        for y in range(p.shape[0] - 6):
            for x in range(p.shape[1] - 6):
                u, v = p[y : y + 7, x : x + 7], t[y : y + 7, x : x + 7]
                c = np.cov(u.ravel(), v.ravel())
                mu, mv = u.mean(), v.mean()
                scores.append(
                    (2 * mu * mv + 1e-4) * (2 * c[0, 1] + 9e-4) / ((mu**2 + mv**2 + 1e-4) * (c[0, 0] + c[1, 1] + 9e-4))
                )
    return np.mean(scores)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    target = rng.random((3, 16, 16))
    pred = np.clip(target + rng.normal(0, 0.1, target.shape), 0, 1)
    return pred, target, rng.random(target.shape) < 0.7


def test_scores_match_numpy(spark, arrays):
    pred, target, valid = arrays
    row = metrics.score(_cells(spark, *arrays), KEYS, BANDS, 16).first()
    mse = ((pred - target) ** 2)[valid].mean()
    assert row.rmse == pytest.approx(np.sqrt(mse))
    assert row.psnr == pytest.approx(10 * np.log10(1 / mse))
    assert row.ssim == pytest.approx(_ssim(pred, target))
    every = valid.all(axis=0)
    p, t = pred[:, every], target[:, every]
    cosine = (p * t).sum(0) / (np.linalg.norm(p, axis=0) * np.linalg.norm(t, axis=0) + 1e-8)
    assert row.sam == pytest.approx(np.arccos(np.clip(cosine, -1, 1)).mean())


def test_all_similarity_forms_agree(spark, arrays):
    cells = _cells(spark, *arrays)
    a = metrics.ssim(cells, KEYS, BANDS, 16).first().ssim
    b = metrics.ssim_windows(cells, KEYS, BANDS, 16).first().ssim
    c = metrics.score(cells, KEYS, BANDS, 16).first().ssim
    assert a == pytest.approx(b, abs=1e-12) and a == c
    with pytest.raises(ValueError):
        metrics.ssim(cells, KEYS, BANDS, 6)


def test_similarity_across_arrow_batches(spark, arrays):
    pred, target, valid = arrays
    cells = _cells(spark, pred, target, valid, "m0")
    for i in range(1, 6):
        cells = cells.unionByName(_cells(spark, np.roll(pred, i, axis=1), target, valid, f"m{i}"))
    want = {f"m{i}": _ssim(np.roll(pred, i, axis=1), target) for i in range(6)}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (7, 256, 600, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = metrics.ssim(cells, KEYS, BANDS, 16).collect()
            assert {r.model: r.ssim for r in found} == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_perfect_prediction(spark, arrays):
    _, target, valid = arrays
    row = metrics.score(_cells(spark, target, target, valid), KEYS, BANDS, 16).first()
    assert row.rmse == 0 and row.psnr == float("inf")
    assert row.ssim == pytest.approx(1.0) and row.sam < 1e-3


def test_empty_mask_falls_back_to_all_values_and_the_angle_to_zero(spark, arrays):
    pred, target, _ = arrays
    row = metrics.pixel_scores(_cells(spark, pred, target, np.zeros(pred.shape, bool)), KEYS, BANDS).first()
    assert row.rmse == pytest.approx(np.sqrt(((pred - target) ** 2).mean())) and row.sam == 0.0


def test_masked_loss(spark, arrays):
    pred, target, valid = arrays
    cells = _cells(spark, *arrays).withColumn("valid", F.col("valid_b01"))
    sq, ab = (pred - target) ** 2, np.abs(pred - target)
    assert metrics.masked_loss(cells, BANDS).first().loss == pytest.approx(sq[valid].mean())
    assert metrics.masked_loss(cells, BANDS, "l1").first().loss == pytest.approx(ab[valid].mean())
    per_pixel = metrics.masked_loss(cells, BANDS, "mse", denominator="pixels").first().loss
    assert per_pixel == pytest.approx(sq[:, valid[0]].sum() / valid[0].sum())
    none = cells.withColumns({f"valid_{b}": F.lit(False) for b in BANDS})
    assert metrics.masked_loss(none, BANDS).first().loss == 0.0
    with pytest.raises(ValueError):
        metrics.masked_loss(cells, BANDS, "huber")


def _sample(spark, stack, target):
    """stack: (band, frame, row, column)."""
    rows = [
        ("test", 0, 0, 0, y, x, *[list(map(float, stack[b, :, y, x])) for b in range(3)],
         *[float(target[b, y, x]) for b in range(3)], True, True, True)
        for y, x in np.ndindex(*target.shape[1:])
    ]
    cols = [f"in_{b} ARRAY<DOUBLE>" for b in BANDS] + [f"target_{b} DOUBLE" for b in BANDS] + [f"valid_{b} BOOLEAN" for b in BANDS]
    return spark.createDataFrame(rows, "split STRING, y_coord INT, x_coord INT, t_start INT, y INT, x INT, " + ", ".join(cols))


def test_gap_filling(spark):
    rng = np.random.default_rng(5)
    stack, target = rng.random((3, 4, 2, 2)), rng.random((3, 2, 2))
    c = SampleConfig(patch=2, window=4, bands=tuple(BANDS))
    cells = _sample(spark, stack, target)
    lower = np.sort(stack, axis=1)[:, 1]
    for r in impute.temporal_median(cells, c).collect():
        assert [r[f"pred_{b}"] for b in BANDS] == pytest.approx(lower[:, r.y, r.x])
    mse = ((stack - target[:, None]) ** 2).mean(axis=(0, 2, 3))
    best = impute.best_frames(cells, c).first()
    assert best.t == mse.argmin() and best.frame_mse == pytest.approx(mse.min())
    for r in impute.oracle_frame(cells, c).collect():
        assert [r[f"pred_{b}"] for b in BANDS] == pytest.approx(stack[:, best.t, r.y, r.x])
    flat = impute.stack_inputs(cells, c)
    np.testing.assert_allclose(flat.first().input, stack.ravel(), rtol=1e-6)
    out = impute.predict(flat, lambda a: a.reshape(len(a), 3, 4, -1).max(axis=2).reshape(len(a), -1)).first()
    np.testing.assert_allclose(out.output, stack.max(axis=1).ravel(), rtol=1e-6)


def test_model_on_cells_then_scores(spark):
    rng = np.random.default_rng(6)
    stack, target = rng.random((3, 4, 8, 8)), rng.random((3, 8, 8))
    c = SampleConfig(patch=8, window=4, bands=tuple(BANDS))
    made = impute.predict_cells(_sample(spark, stack, target), c, lambda a: a.max(axis=2))
    for r in made.collect():
        assert [r[f"pred_{b}"] for b in BANDS] == pytest.approx(stack.max(axis=1)[:, r.y, r.x])
    row = metrics.score(made, ["split", "y_coord", "x_coord", "t_start"], BANDS, 8).first()
    assert row.rmse == pytest.approx(np.sqrt(((stack.max(axis=1) - target) ** 2).mean()))
    assert row.ssim == pytest.approx(_ssim(stack.max(axis=1), target))


def test_earliest_frame_wins_ties(spark):
    stack = np.zeros((3, 4, 2, 2))
    c = SampleConfig(patch=2, window=4, bands=tuple(BANDS))
    assert impute.best_frames(_sample(spark, stack, np.ones((3, 2, 2))), c).first().t == 0


def test_scores_of_wide_patches_go_by_row_blocks(spark):
    rng = np.random.default_rng(5)
    target = rng.random((2, 40, 40))
    pred = np.clip(target + rng.normal(0, 0.1, target.shape), 0, 1)
    rows = [
        (0, 0, y, x, *map(float, pred[:, y, x]), *map(float, target[:, y, x]), True, (y + x) % 3 > 0)
        for y, x in np.ndindex(40, 40) if (y * x) % 7
    ]
    names = "y_coord INT, x_coord INT, y INT, x INT, pred_a DOUBLE, pred_b DOUBLE, target_a DOUBLE, target_b DOUBLE, valid_a BOOLEAN, valid_b BOOLEAN"
    cells = spark.createDataFrame(rows, names)
    keys, bands = ["y_coord", "x_coord"], ["a", "b"]
    df = metrics.score(cells, keys, bands, 40)
    # three scores are partial sums; the cells of the fourth move by block of rows, never as a whole sample
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("_unit" in line for line in moved) == 1 and "partial_sum" in plan
    assert plan.count("MapInArrow") == 1
    got, parts = df.first(), metrics.pixel_scores(cells, keys, bands).first()
    assert (got.rmse, got.psnr, got.sam) == pytest.approx((parts.rmse, parts.psnr, parts.sam))
    seen = np.zeros((40, 40), bool)
    for r in rows:
        seen[r[2], r[3]] = True
    assert got.ssim == pytest.approx(_ssim(pred * seen, target * seen))
    # cells of narrow patches are one block each and, placed by patch, do not move again
    placed = metrics.ssim(cells.filter("y < 20 AND x < 20").repartition("y_coord", "x_coord"), keys, bands, 20)
    moved = [line for line in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and "REPARTITION_BY_COL" in moved[1]  # the sums, and the placing itself
    # a block without any cell is alike in both pictures
    top = metrics.ssim(cells.filter("y < 12"), keys, bands, 40).first().ssim
    below = np.arange(40)[None, :, None] < 12
    assert top == pytest.approx(_ssim(pred * seen * below, target * seen * below))


def test_models_get_batches_of_samples(spark):
    rng = np.random.default_rng(7)
    stacks, target = rng.random((5, 3, 4, 8, 8)), rng.random((3, 8, 8))
    c = SampleConfig(patch=8, window=4, bands=tuple(BANDS))
    cells = None
    for i, stack in enumerate(stacks):
        one = _sample(spark, stack, target).withColumn("t_start", F.lit(i))
        cells = one if cells is None else cells.union(one)

    def model(batch):
        assert 1 <= len(batch) <= 2
        return batch.max(axis=2) + len(batch)

    made = impute.predict_cells(cells.repartition(1), c, model, batch=2).collect()
    assert len(made) == 5 * 64
    for r in made:
        # five samples in one task: two, two, one
        size = 1 if r.t_start == 4 else 2
        assert [r[f"pred_{b}"] for b in BANDS] == pytest.approx(stacks[r.t_start].max(axis=1)[:, r.y, r.x] + size)

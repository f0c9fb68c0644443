import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import DEFAULT_LEGEND, SampleConfig
from gridloom.operators import impute, patches, samples

BANDS = ("b01", "b02")
KEY = ["split", "y_coord", "x_coord", "t_start"]


def _config(**kw):
    return SampleConfig(**{"patch": 2, "window": 3, "bands": BANDS, "min_pristine": 0.5, **kw})


def _cube(spark, shape=(5, 4, 6), seed=0, drop=0.0):
    rng = np.random.default_rng(seed)
    u = rng.choice([0, 0, 0, 1, 4, 255], size=shape).astype(int)
    b = rng.random((2, *shape))
    missing = rng.random((2, *shape)) < 0.2
    present = rng.random(shape) >= drop
    rows = [
        (t, y, x, *[None if missing[k, t, y, x] else float(b[k, t, y, x]) for k in range(2)], int(u[t, y, x]))
        for t, y, x in np.ndindex(*shape)
        if present[t, y, x]
    ]
    b = np.where(missing | ~present, np.nan, b)
    u = np.where(present, u, 255)
    df = spark.createDataFrame(rows, "t INT, y INT, x INT, b01 DOUBLE, b02 DOUBLE, usability SMALLINT")
    return df, b, u


def test_split_sizes_and_disjointness(spark):
    grid = patches.patch_grid(spark, 21 * 224, 21 * 224, 224)
    split = samples.spatial_split(grid, SampleConfig())
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 308, "val": 66, "test": 67}
    assert split.select("y_coord", "x_coord").distinct().count() == 441


def test_same_seed_same_split_for_any_partitioning(spark):
    grid = patches.patch_grid(spark, 96, 96, 8)
    one, many = (
        sorted(map(tuple, samples.spatial_split(grid.repartition(n), SampleConfig(patch=8)).collect())) for n in (1, 7)
    )
    assert one == many
    other = sorted(map(tuple, samples.spatial_split(grid, SampleConfig(patch=8, seed=7)).collect()))
    assert other != one


def test_temporal_starts(spark):
    split = spark.createDataFrame([("train", 0, 0), ("val", 0, 8), ("test", 8, 0)], "split STRING, y_coord INT, x_coord INT")
    starts = samples.temporal_starts(split, 20, SampleConfig())
    got = {r.split: r["count"] for r in starts.groupBy("split").count().collect()}
    assert got == {"train": 17, "val": 5, "test": 5}
    assert samples.temporal_starts(split, 3, SampleConfig()).count() == 0


def test_older_split_leaks_patches(spark):
    split = samples.sample_split(patches.patch_grid(spark, 64, 64, 8), 12, SampleConfig(patch=8))
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    # 64 patches with 9 starts, or 3 starts at stride 4
    assert sizes == {"train": int(576 * 0.7), "val": int(192 * 0.15), "test": 192 - int(192 * 0.7) - int(192 * 0.15)}
    train = split.filter("split = 'train'").select("y_coord", "x_coord")
    assert split.filter("split = 'test'").join(train, ["y_coord", "x_coord"], "left_semi").count() > 0


def test_loader_order_is_a_permutation_and_epochs_move_only_train(spark):
    c = SampleConfig(patch=8)
    starts = samples.temporal_starts(samples.spatial_split(patches.patch_grid(spark, 64, 64, 8), c), 12, c)
    orders = []
    for epoch in (0, 1):
        rows = samples.shuffle_order(starts, epoch=epoch).collect()
        orders.append({tuple(r[k] for k in KEY): r.seq for r in rows})
        for split in ("train", "val", "test"):
            seq = sorted(v for k, v in orders[-1].items() if k[0] == split)
            assert seq == list(range(len(seq)))
    moved = {k[0] for k in orders[0] if orders[0][k] != orders[1][k]}
    assert moved == {"train"}


def test_legend(spark):
    row = spark.range(1).select(samples.parse_legend(F.lit(DEFAULT_LEGEND)).alias("m")).first()
    assert row.m == {"Pristine": 0, "Shadow": 1, "Hazy": 2, "Contaminated": 3, "Cloud": 4}
    assert samples.bad_codes() == (1, 2, 3, 4)


def _expected(b, u, samples_rows, c):
    """Brute force over whole arrays: target frame, gate, gap, inputs, truth, validity."""
    out = {}
    for split, y, x, t0 in samples_rows:
        win = u[t0 : t0 + c.window, y : y + c.patch, x : x + c.patch]
        bad = np.isin(win, c.bad_codes).mean(axis=(1, 2))
        at = int(np.argmin(bad))
        if (win[at] == 0).mean() < c.min_pristine:
            continue
        norm = (b[:, t0 : t0 + c.window, y : y + c.patch, x : x + c.patch] + 0.01) / 1.61
        hexes = hashlib.md5(f"donor|{c.seed}|0|{y}|{x}|{t0}".encode()).hexdigest()
        donor = int(hexes[:7], 16) % (c.window - 1)
        donor += donor >= at
        hole = win[donor] != 0
        inputs = np.nan_to_num(norm, nan=0.0)
        inputs[:, at][:, hole] = 0.0
        for dy, dx in np.ndindex(c.patch, c.patch):
            out[(split, y, x, t0, y + dy, x + dx)] = (
                t0 + at, bool(hole[dy, dx]), inputs[:, :, dy, dx],
                np.nan_to_num(norm[:, at, dy, dx]), (win[at, dy, dx] == 0) & ~np.isnan(norm[:, at, dy, dx]),
            )
    return out


@pytest.mark.parametrize("drop", [0.0, 0.4])
def test_samples_match_brute_force(spark, drop):
    c = _config()
    df, b, u = _cube(spark, drop=drop)
    planned = samples.plan_samples(spark, 4, 6, 5, c)
    got = {
        tuple(r[k] for k in [*KEY, "y", "x"]): r
        for r in samples.build_samples(df, planned, 5, c, (4, 6)).collect()
    }
    want = _expected(b, u, [tuple(r[k] for k in KEY) for r in planned.collect()], c)
    assert set(got) == set(want) and want
    for key, (t, gap, inputs, truth, valid) in want.items():
        r = got[key]
        assert (r.t_target, r.gap) == (t, gap)
        for i, name in enumerate(BANDS):
            np.testing.assert_allclose(r[f"in_{name}"], inputs[i], atol=1e-12)
            assert r[f"target_{name}"] == pytest.approx(truth[i])
            assert r[f"valid_{name}"] == bool(valid[i])


def test_window_of_one_frame_has_no_gap(spark):
    c = _config(window=1, min_pristine=0.0)
    df, _, _ = _cube(spark)
    built = samples.build_samples(df, samples.plan_samples(spark, 4, 6, 5, c), 5, c)
    assert built.count() > 0 and built.filter("gap").count() == 0


def test_equal_bad_shares_take_the_earliest_frame_and_the_gate_is_inclusive(spark):
    c = _config()
    cells = [(t, y, x, 0.1, 0.1, 0 if x == 0 else 255) for t in range(3) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(cells, "t INT, y INT, x INT, b01 DOUBLE, b02 DOUBLE, usability SMALLINT")
    planned = spark.createDataFrame([("test", 0, 0, 0)], "split STRING, y_coord INT, x_coord INT, t_start INT")
    row = samples.pristine_gate(samples.target_frame(planned, samples.frames(df, c), c), c).first()
    # fill counts neither as bad nor as pristine
    assert (row.t_target, row.bad_fraction, row.pristine_fraction) == (0, 0.0, 0.5)


def test_augmentation_is_what_flips_and_turns_do(spark):
    c = _config(patch=4)
    grid = np.arange(16).reshape(4, 4)
    cells = [("train", 4, 8, 0, 4 + y, 8 + x, int(grid[y, x])) for y, x in np.ndindex(4, 4)]
    df = spark.createDataFrame(cells, "split STRING, y_coord INT, x_coord INT, t_start INT, y INT, x INT, v INT")
    for h in (False, True):
        for v in (False, True):
            for k in range(4):
                want = grid[:, ::-1] if h else grid
                want = want[::-1] if v else want
                want = np.rot90(want, k)
                got = np.full((4, 4), -1)
                for r in samples.augment(df, c, params=(F.lit(h), F.lit(v), F.lit(k))).collect():
                    got[r.y - 4, r.x - 8] = r.v
                np.testing.assert_array_equal(got, want)


def test_four_quarter_turns_are_the_identity_and_test_samples_stay(spark):
    c = _config(patch=4)
    cells = [("train", 0, 0, 0, y, x, 4 * y + x) for y, x in np.ndindex(4, 4)] + [("test", 0, 0, 0, 1, 2, 6)]
    df = spark.createDataFrame(cells, "split STRING, y_coord INT, x_coord INT, t_start INT, y INT, x INT, v INT")
    turned = df
    for _ in range(4):
        turned = samples.augment(turned, c, params=(F.lit(False), F.lit(False), F.lit(1)))
    assert all(r.v == 4 * r.y + r.x for r in turned.collect())
    once = samples.augment(df, c, params=(F.lit(True), F.lit(True), F.lit(3))).filter("split = 'test'").first()
    assert (once.y, once.x) == (1, 2)


def test_chips_are_dense_and_row_major(spark):
    df, b, _ = _cube(spark, drop=0.5)
    chips = samples.to_chips(patches.with_patch(df, 2), ["b01", "b02"], 2, ["y_coord", "x_coord", "t"])
    for r in chips.collect():
        k = int(r.band[-1]) - 1
        want = np.nan_to_num(b[k, r.t, r.y_coord : r.y_coord + 2, r.x_coord : r.x_coord + 2]).ravel()
        np.testing.assert_allclose(r.pixels, want, atol=1e-6)


@pytest.mark.parametrize("n, size", [(1, 5), (2, 5), (3, 5), (4, 5), (5, 5), (7, 5)])
def test_padding_cycles_and_trims(spark, n, size):
    df = spark.range(n).select(F.lit(0).alias("batch"), F.col("id").cast("int").alias("slot"))
    got = [(r.place, r.slot) for r in samples.pad_batches(df, ["batch"], "slot", size).orderBy("place").collect()]
    assert got == [(i, i % n) for i in range(size)]


def test_shards(spark):
    df = spark.range(7).select(F.lit("train").alias("split"), F.col("id").alias("seq"))
    assert sorted((r.seq, r["rank"]) for r in samples.shard(df, 3).collect()) == [(i, i % 3) for i in range(7)]
    padded = samples.padded_shards(df, 3)
    assert sorted((r.seq, r["rank"]) for r in padded.collect()) == [(i, i % 3) for i in range(9)]
    batched = samples.batches(df.filter("seq <> 2"), 2, world=1).orderBy("seq").collect()
    assert [(r.seq, r.batch, r.slot) for r in batched] == [(0, 0, 0), (1, 0, 1), (3, 1, 1), (4, 2, 0), (5, 2, 1), (6, 3, 0)]


def test_stratum_defaults_to_unknown(spark):
    s = spark.createDataFrame([("test", 0, 0, 0), ("test", 8, 0, 0)], "split STRING, y_coord INT, x_coord INT, t_start INT")
    strata = spark.createDataFrame([(0, 0, "Low")], "y_coord INT, x_coord INT, stratum STRING")
    got = {r.y_coord: r.difficulty_stratum for r in samples.attach_stratum(s, strata).collect()}
    assert got == {0: "Low", 8: "Unknown"}


def _corr(a, b):
    return abs(np.corrcoef(np.array(a, float), np.array(b, float))[0, 1])


def test_seed_and_epoch_shuffle_and_draws_are_independent(spark):
    c = SampleConfig(patch=8, window=4)
    planned = samples.plan_samples(spark, 8 * 21, 8 * 21, 20, c).filter("split = 'train'").cache()
    keys = ["y_coord", "x_coord", "t_start"]
    order = {}
    for seed, epoch in ((42, 0), (42, 1), (42, 2), (7, 0)):
        rows = samples.shuffle_order(planned.drop("seq"), seed, epoch).select(*keys, "seq").collect()
        order[seed, epoch] = {tuple(r[k] for k in keys): r.seq for r in rows}
    first = order[42, 0]
    n = len(first)
    for other in list(order)[1:]:
        # a rotation would leave one difference for nearly all samples
        steps = [(order[other][k] - first[k]) % n for k in first]
        assert len(set(steps)) > n / 3 and _corr([first[k] for k in first], [order[other][k] for k in first]) < 0.1
    split = samples.spatial_split(samples.patch_grid(spark, 8 * 21, 8 * 21, 8), c).collect()
    train = {(r.y_coord // 8, r.x_coord // 8) for r in split if r.split == "train"}
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1), (0, 7), (2, 3)):  # a lattice would repeat itself along some step
        pairs = [((y, x) in train, (y + dy, x + dx) in train) for y in range(19) for x in range(1, 14)]
        assert _corr(*zip(*pairs)) < 0.2
    targets = planned.withColumn("t_target", F.col("t_start"))
    flips = []
    for epoch in (0, 1, 2):
        cells = targets.select(*KEY, F.col("y_coord").alias("y"), F.col("x_coord").alias("x"), F.lit(1).alias("v"))
        moved = samples.augment(cells, c, 42, epoch).select("y_coord", "x_coord", "t_start", (F.col("x") - F.col("x_coord")).alias("dx"))
        flips.append({tuple(r[k] for k in keys): r.dx > 0 for r in moved.collect()})
    for a, b in ((0, 1), (0, 2), (1, 2)):
        share = np.mean([flips[a][k] != flips[b][k] for k in flips[a]])
        assert 0.45 < share < 0.55
    donors = {tuple(r[k] for k in keys): r.t_donor - r.t_start for r in samples.donor_frame(targets, c).collect()}
    assert _corr([donors[k] for k in donors], [flips[0][k] for k in donors]) < 0.05
    assert _corr([donors[k] for k in donors], [first[k] for k in donors]) < 0.05


def test_wide_patches_spread_over_blocks_and_move_once(spark, monkeypatch):
    c = _config()
    df, _, _ = _cube(spark, drop=0.2)
    planned = samples.plan_samples(spark, 4, 6, 5, c)
    whole = samples.build_samples(df, planned, 5, c, (4, 6))
    best = impute.oracle_frame(whole, c)
    monkeypatch.setattr(samples, "BLOCK_ROWS", 1)
    cut = samples.build_samples(df, planned, 5, c, (4, 6))
    order = [*KEY, "y", "x"]
    assert "_block" in cut.columns and samples.block_count(c.patch) > 1
    assert cut.drop("_block").orderBy(*order).collect() == whole.orderBy(*order).collect()
    found = impute.oracle_frame(cut, c)
    assert found.orderBy(*order).collect() == best.orderBy(*order).collect()
    # raw cells move once, by patch and block, and are read once: the choice of frames is a window over the sample
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and physical.count("REPARTITION_BY_COL") == 1
    assert "Window" in physical and "SortMergeJoin [y_coord" not in physical.split("ObjectHashAggregate")[0]

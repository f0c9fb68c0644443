import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import DifficultyConfig
from gridloom.operators import cube as cube_ops
from gridloom.operators import intrinsic, landcover, moments, patches
from gridloom.sources import derived, tables

CUBE = "t INT, y INT, x INT, b01 DOUBLE, b02 DOUBLE, usability SMALLINT"


def test_median_and_std_of_few_values(spark):
    rows = [(t, 0, 0, v, 1.0, 0) for t, v in enumerate([1.0, 2.0, 3.0, 10.0])] + [(0, 0, 1, 4.0, None, 0)]
    df = spark.createDataFrame(rows, CUBE)
    med = {r.x: (r.b01, r.b02) for r in intrinsic.temporal_medians(df, ["b01", "b02"]).collect()}
    assert med == {0: (2.5, 1.0), 1: (4.0, None)}
    std = {r.x: r.b01 for r in intrinsic.temporal_std(df, ["b01"]).collect()}
    assert std[1] == 0.0 and std[0] == pytest.approx(np.std([1, 2, 3, 10]))


def test_ndvi_zero_denominators(spark):
    rows = [
        (0, 0, 0, -0.2, 0.2, 0), (1, 0, 0, 0.1, 0.3, 0),  # infinite on one day: cell drops out
        (0, 0, 1, 0.0, 0.0, 0), (1, 0, 1, 0.1, 0.3, 0), (2, 0, 1, 0.1, 0.1, 0),  # 0/0: that day is skipped
    ]
    stats = intrinsic.cell_stats(spark.createDataFrame(rows, CUBE), DifficultyConfig(patch=2)).collect()
    got = {r.x: r.ndvi_std for r in stats}
    assert got[0] is None
    assert got[1] == pytest.approx(np.std([0.5, 0.0]))


def test_constant_metric_normalises_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0), (3, 5.0, None)], "id INT, a DOUBLE, b DOUBLE")
    rows = intrinsic.min_max(df, ["a", "b"]).orderBy("id").collect()
    assert [r.a_norm for r in rows] == [0.0, 0.0, 0.0]
    assert [r.b_norm for r in rows] == [0.0, 1.0, None]


def test_shannon_bounds(spark):
    lc = [(y, x, 10 if y < 2 else 20 + 10 * (x // 2)) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(lc, "y INT, x INT, lc SMALLINT")
    got = intrinsic.shannon(df, 4).first().heterogeneity
    assert got == pytest.approx(1.5)
    one = intrinsic.shannon(df.filter("lc = 10"), 4).first().heterogeneity
    assert one == pytest.approx(0.0)


def test_dominant_class_tie_takes_the_smallest_id(spark):
    df = spark.createDataFrame([(0, 0, 30), (0, 1, 20), (1, 0, 20), (1, 1, 30)], "y INT, x INT, lc SMALLINT")
    assert patches.dominant_class(df, 2).first()["class"] == 20


def test_trimmed_blocks(spark):
    df = spark.range(35).select((F.col("id") % 5).cast("int").alias("y"), (F.col("id") % 7).cast("int").alias("x"))
    assert patches.with_patch(df, 2, 5, 7).agg(F.max("y"), F.max("x")).first() == (3, 5)


def test_stratified_patches_cap_a_hot_class(spark):
    dominant = spark.range(2000).select(
        (F.col("id") * 8).cast("int").alias("y_coord"), F.lit(0).alias("x_coord"),
        F.when(F.col("id") % 3 < 2, 10).when(F.col("id") < 30, 40).otherwise(95).alias("class"),
    )
    chosen = patches.stratified_patches(dominant, [10, 40, 80], 50)
    got = {r["class"]: r["count"] for r in chosen.groupBy("class").count().collect()}
    assert got == {10: 50, 40: 10}
    assert "WindowGroupLimit" in chosen._jdf.queryExecution().executedPlan().toString()


def test_enumeration_order(spark):
    rows = patches.enumerate_windows(spark, 5, 6, 4, 2, 3).orderBy("idx").collect()
    want = [(t, y, x) for y in (0, 2) for x in (0, 2, 4) for t in (0, 1)]
    assert [(r.t_start, r.y_coord, r.x_coord) for r in rows] == want
    with pytest.raises(ValueError):
        patches.enumerate_windows(spark, 4, 4, 2, 2, 3)


def test_difficulty_of_sparse_and_dense_cube_agree(spark, sf):
    c = DifficultyConfig(patch=8)
    lc = derived.landcover(spark, sf)
    sparse = derived.cube(spark, sf)
    height, width = derived.grid_shape(spark, sf)
    dense = cube_ops.densify(sparse, height, width, derived.FRAMES)
    a = intrinsic.difficulty(sparse, lc, c, derived.FRAMES, height, width).orderBy("y_coord", "x_coord").collect()
    b = intrinsic.difficulty(dense, lc, c).orderBy("y_coord", "x_coord").collect()
    assert len(a) == len(b) == 8
    for r, s in zip(a, b):
        assert tuple(r) == pytest.approx(tuple(s), abs=1e-12)
        assert 0 <= r.difficulty_index <= 0.99


def test_strata_are_thirds(spark, sf):
    rows = intrinsic.with_strata(derived.patch_difficulty(spark, sf)).collect()
    by_value = sorted(rows, key=lambda r: (r.difficulty_index, r.y_coord, r.x_coord))
    assert [r.stratum for r in by_value] == ["Low"] * 3 + ["Medium"] * 2 + ["High"] * 3


def test_correlation_skips_incomplete_pairs(spark):
    data = np.random.default_rng(0).normal(size=(50, 3))
    rows = [tuple(None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(data)]
    got = {
        (r.band_i, r.band_j): r.r
        for r in intrinsic.band_correlation(spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE"), ["a", "b", "c"]).collect()
    }
    both = [(r[0], r[2]) for r in rows if r[0] is not None and r[2] is not None]
    assert got[("a", "c")] == got[("c", "a")] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    assert got[("b", "b")] == 1.0


def test_density_integrates_to_one(spark):
    df = spark.range(4000).select(
        F.lit("b01").alias("band"), F.lit("x").alias("land_cover_name"), (0.5 + (F.col("id") % 100) / 500.0).alias("reflectance")
    )
    curve = intrinsic.density(intrinsic.histogram(df, 0.0, 1.6, 64), 0.0, 1.6, 64, 0.05)
    assert curve.agg(F.sum("density")).first()[0] * 1.6 / 64 == pytest.approx(1.0, abs=1e-3)


def test_dimensions(spark):
    assert tables.lc_dim(spark).count() == 11 and tables.mask_dim(spark).count() == 6
    assert math.isclose(sum(DifficultyConfig().weights), 0.99)


def test_kernel_density_holds_all_the_mass(spark):
    rng = np.random.default_rng(1)
    groups = {("b01", "Forest"): rng.normal(0.3, 0.1, 400), ("b02", "Crop"): rng.random(50), ("b02", "Flat"): np.ones(5), ("b02", "One"): np.ones(1)}
    rows = [(b, n, float(v)) for (b, n), vs in groups.items() for v in vs] + [("b01", "Forest", None)]
    curve = intrinsic.kernel_density(spark.createDataFrame(rows, "band STRING, land_cover_name STRING, reflectance DOUBLE"), points=400)
    got = {}
    for r in curve.orderBy("point").collect():
        got.setdefault((r.band, r.land_cover_name), []).append((r.value, r.density))
    assert set(got) == {("b01", "Forest"), ("b02", "Crop")}
    for key, points in got.items():
        at, density = np.array(points).T
        values = groups[key]
        width = values.std(ddof=1) * len(values) ** -0.2
        exact = np.exp(-0.5 * ((at[:, None] - values) / width) ** 2).sum(axis=1) / (len(values) * width * np.sqrt(2 * np.pi))
        assert density == pytest.approx(exact, abs=2e-3 * exact.max())
        assert np.trapezoid(density, at) == pytest.approx(1, abs=5e-3)


def test_merged_moments_equal_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(int(d), int(k), *(None if rng.random() < 0.2 else float(1e6 + v) for v in rng.random(2))) for d in range(3) for k in range(4) for _ in range(6)]
    rows += [(2, 9, 1.0, None)]
    cells = spark.createDataFrame(rows, "d INT, y INT, b01 DOUBLE, b02 DOUBLE")
    bands, parts = ["b01", "b02"], [cells.filter(f"d = {d}") for d in range(3)]
    state = moments.merge([moments.cell_moments(p, ["y"], bands) for p in parts], ["y", "band"])
    for r in moments.deviations(state, ["y"], bands).collect():
        for i, b in enumerate(bands):
            values = [row[2 + i] for row in rows if row[1] == r.y and row[2 + i] is not None]
            assert (r[b] is None) == (not values)
            assert not values or r[b] == pytest.approx(np.std(values), rel=1e-6, abs=1e-9)
    pairs = moments.merge([moments.pair_moments(p, bands) for p in parts], ["band_i", "band_j"])
    x, y = np.array([r[2:] for r in rows if None not in r]).T
    row = moments.correlations(pairs).first()
    assert row.n == len(x) and row.r == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-6)


def _rasters(spark, rows):
    return spark.createDataFrame(
        rows, "tile_order INT, ax DOUBLE, bx DOUBLE, x0 DOUBLE, ay DOUBLE, by DOUBLE, y0 DOUBLE, n_rows INT, n_cols INT"
    )


@pytest.mark.parametrize("size", [0.3, 1.0, 7.0])
def test_overlapping_rotated_rasters_equal_all_pairs(spark, size):
    draw = np.random.default_rng(5)
    grids = []
    for i in range(40):
        turn, step = draw.uniform(0, 2 * math.pi), draw.uniform(0.05, 0.4)
        a, b = step * math.cos(turn), step * math.sin(turn)
        mirror = float(draw.choice([-1.0, 1.0]))
        grids.append((i, a, -b * mirror, draw.uniform(-5, 5), b, a * mirror, draw.uniform(-5, 5), int(draw.integers(3, 20)), int(draw.integers(3, 40))))
    flat = [(90, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0, 5, 5), (91, None, 0.0, 0.0, 0.0, 1.0, 0.0, 5, 5),
            (92, 1.0, 0.0, None, 0.0, 1.0, 0.0, 5, 5), (93, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0, 5)]
    places = [(i, float(x), float(y), "kept") for i, (x, y) in enumerate(draw.uniform(-8, 8, (400, 2)))]
    cells = spark.createDataFrame([*places, (400, None, 1.0, "kept")], "id INT, lon DOUBLE, lat DOUBLE, n_rows STRING")
    pixels = [(g[0], r, c, (g[0] + r + c) % 4 * 10) for g in grids for r in range(g[7]) for c in range(g[8]) if (r + c) % 5]
    lc = {p[:3]: p[3] for p in pixels}
    want = set()
    for n, x, y, _ in places:
        for order, ax, bx, x0, ay, by, y0, n_rows, n_cols in grids:
            c, r = (math.floor(v) for v in np.linalg.solve([[ax, bx], [ay, by]], [x - x0, y - y0]))
            if 0 <= r < n_rows and 0 <= c < n_cols:
                want.add((n, order, r, c, lc.get((order, r, c))))
    assert len({w[0] for w in want}) < 400 < len(want)
    rasters, values = _rasters(spark, grids + flat), spark.createDataFrame(pixels, "tile_order INT, src_row INT, src_col INT, lc INT")
    found = landcover.reproject_covering(cells, rasters, values, size=size)
    assert set(found.columns) == {"id", "lon", "lat", "n_rows", "tile_order", "src_row", "src_col", "lc"}
    rows = found.select("id", "tile_order", "src_row", "src_col", "lc").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    first = {}
    for n, order, _, _, value in sorted(want, key=lambda w: w[:2]):
        if value:
            first.setdefault(n, value)
    mosaic = landcover.mosaic_covering(cells, rasters, values, ["id"], size=size)
    assert {r.id: r.lc for r in mosaic.collect()} == {n: first.get(n, 0) for n in range(401)}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_footprint_index_leaves_out_cells_beside_a_rotated_raster(spark):
    side = math.sqrt(0.5)
    long = _rasters(spark, [(1, side, -side, 0.0, side, side, 0.0, 1, 100)])
    index = landcover.footprint_index(long).count()
    assert 100 <= index <= 300  # the box around it has some 5000
    assert landcover.footprint_index(long.limit(0)).count() == 0


def _wide_and_fine(spark):
    grids = [(1, 0.5, 0.0, 0.0, 0.0, -0.5, 4.0, 8, 8), (1, 0.5, 0.0, 0.0, 0.0, -0.5, 4.0, 8, 8), (2, 0.01, 0.002, 0.5, -0.002, 0.01, 0.5, 90, 120),
             (None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 2, 2)]
    pixels = [(g[0], r, c, (r * 7 + c) % 5 * 10) for g in grids[1:3] for r in range(g[7]) for c in range(g[8]) if (r + c) % 3]
    pixels += [(1, 2, 2, 70), (1, 2, 2, None), (2, 40, 60, 80), (None, 0, 0, 90), (1, None, 0, 90), (1, 99, 0, 90)]
    draw = np.random.default_rng(8)
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform(-0.5, 4.5, (600, 2)))]
    places += [(600, 1.25, 2.75), (601, 0.5 + 0.01 * 60.5 + 0.002 * 40.5, 0.5 - 0.002 * 60.5 + 0.01 * 40.5), (602, None, 1.0)]
    cells = spark.createDataFrame([*places, places[3]], "id INT, lon DOUBLE, lat DOUBLE")
    return cells, _rasters(spark, grids), spark.createDataFrame(pixels, "tile_order INT, src_row INT, src_col INT, lc INT"), pixels


@pytest.mark.parametrize("across", [2, 16])
def test_pixels_listed_again_and_grids_of_all_widths_give_the_rows_of_a_plain_join(spark, across):
    cells, rasters, values, pixels = _wide_and_fine(spark)
    met = landcover.covering(cells, rasters, size=2.0).collect()
    want = []
    for r in met:
        found = [p[3] for p in pixels if r.tile_order is not None and p[:3] == (r.tile_order, r.src_row, r.src_col)]
        want += [(r.id, r.tile_order, r.src_row, r.src_col, lc) for lc in found or [None]]
    rows = landcover.reproject_covering(cells, rasters, values, size=2.0, across=across).select("id", "tile_order", "src_row", "src_col", "lc")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want))
    assert {w[4] for w in want if w[0] == 600} >= {70, None} and 80 in {w[4] for w in want if w[0] == 601}
    index = landcover.pixel_index(rasters, values, 2.0, across)
    assert index.agg({"index_level": "max"}).first()[0] > 0
    assert max(len(r["values"]) for r in index.select("values").collect()) <= (across + 4) ** 2


def _pairs_below(frame) -> str:
    """The left side of the last join, with neither broadcasts by size nor adaptive plans."""
    plan = frame._jdf.queryExecution().executedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().head()
    return plan.children().head().toString()


def test_pairs_of_cells_and_rasters_do_not_move_to_their_pixels(spark):
    cells, rasters, values, _ = _wide_and_fine(spark)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, value in zip(kept, ("-1", "false")):
            spark.conf.set(c, value)
        left = _pairs_below(landcover.reproject_covering(cells, rasters, values, size=2.0))
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    assert "Exchange hashpartitioning" in left and "SortMergeJoin" not in left


def test_mosaic_combines_pairs_where_they_arise(spark):
    cells, rasters, values, pixels = _wide_and_fine(spark)
    mosaic = landcover.mosaic_covering(cells, rasters, values, ["id"], size=2.0)
    first = {}
    for r in landcover.covering(cells, rasters, size=2.0).orderBy("tile_order").collect():
        lcs = [p[3] for p in pixels if r.tile_order is not None and p[:3] == (r.tile_order, r.src_row, r.src_col) and p[3]]
        if lcs:
            first.setdefault(r.id, set(lcs))
    got = mosaic.collect()
    assert len(got) == 603 and all(r.lc in first.get(r.id, {0}) for r in got)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, value in zip(kept, ("-1", "false")):
            spark.conf.set(c, value)
        plan = landcover.mosaic_covering(cells, rasters, values, ["id"], size=2.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    # between the last join and the last exchange the pairs are filtered and combined
    assert sum("Exchange" in line for line in lines[:join]) == 1 and sum("partial_min_by" in line for line in lines[:join]) == 1
    assert "tile_order" not in lines[join].split("[")[1].split("]")[0]


def test_mosaic_in_rounds_asks_few_rasters_of_each_cell(spark, monkeypatch):
    draw = np.random.default_rng(3)
    grids = [(i // 2, 0.5, 0.1 * (i % 3), float(draw.uniform(-1, 1)), -0.1 * (i % 2), -0.5, float(draw.uniform(3, 5)), 8, 8) for i in range(120)]
    grids += [(200 + i, 0.05, 0.0, 0.5, 0.0, 0.05, 0.5, 60, 80) for i in range(4)] + [(None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 9, 9)]
    pixels = [(g[0], r, c, int(draw.integers(0, 4)) * 10 or None) for g in grids for r in range(g[7]) for c in range(g[8])]
    places = [(i % 250, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform(-1.5, 4.5, (300, 2)))]
    places += [(400, None, 1.0), (None, 1.0, 1.0), (None, 2.0, 1.5), places[0]]
    cells = spark.createDataFrame(places, "id INT, lon DOUBLE, lat DOUBLE")
    # rasters of one order have one value
    pixels = [(o, r, c, lc and (o or 0) % 7 * 10 + 10) for o, r, c, lc in pixels]
    rasters, values = _rasters(spark, grids), spark.createDataFrame(pixels, "tile_order INT, src_row INT, src_col INT, lc INT")
    once = landcover.mosaic_covering(cells, rasters, values, ["id"], size=2.0, asked_first=1000)
    want = {tuple(r) for r in once.collect()}
    rows = []
    cut = landcover.cut

    def counted(df, label="cut"):
        out = cut(df, label)
        rows.append((label, out.count()))
        return out

    monkeypatch.setattr(landcover, "cut", counted)
    for first in (4,):
        got = landcover.mosaic_covering(cells, rasters, values, ["id"], size=2.0, asked_first=first)
        assert {tuple(r) for r in got.collect()} == want and len(want) == got.count()
    left = [n for label, n in rows if label == "left"]
    assert left and min(left) < 150  # of 304 positions


def test_reprojection_writes_the_index_that_it_reads_again(spark, monkeypatch):
    cells, rasters, values, _ = _wide_and_fine(spark)
    written, cut = {}, landcover.cut
    monkeypatch.setattr(landcover, "cut", lambda df, label="cut": written.setdefault(label, cut(df, label)))
    found = landcover.reproject_covering(cells, rasters.withColumn("x0", F.col("x0") + F.lit(0.0)), values, size=2.0)
    assert set(written) == {"rasters", "index"} and found.count() > 600
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "by#" not in plan  # the grid itself is used by the index alone

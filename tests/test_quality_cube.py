import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom.config import QC_FILL, CubeConfig, DifficultyConfig
from gridloom.functions import quality
from gridloom.operators import cube, intrinsic
from gridloom.operators.patches import with_patch
from gridloom.sources import derived, tables

GOLDEN = [
    (0, 0), (4, 1), (192, 2), (256, 3), (8192, 3), (1, 4), (2, 4), (3, 0), (65535, 255),
    (4 + 192, 2), (4 + 192 + 256, 3), (1 + 8192, 4), (64, 0), (128, 0), (512, 3), (768, 3),
]


def test_usability_precedence(spark):
    df = spark.createDataFrame(GOLDEN, "state INT, want INT")
    rows = df.select("state", "want", quality.usability(F.col("state")).alias("got")).collect()
    assert [(r.state, r.got) for r in rows] == [(r.state, r.want) for r in rows]


def test_quality_fill_word_is_bad(spark):
    qc = F.col("qc")
    row = spark.createDataFrame([(QC_FILL,)], "qc BIGINT").select(
        quality.band_quality(qc, 1).alias("bits"), quality.band_good(qc, 1).alias("good")
    ).first()
    assert (row.bits, row.good) == (11, False)


def test_every_band_reads_its_own_bits(spark):
    for band in range(1, 8):
        word = 5 << (2 + 4 * (band - 1))
        row = spark.range(1).select(
            *[quality.band_good(F.lit(word).cast("bigint"), b).alias(f"g{b}") for b in range(1, 8)]
        ).first()
        assert [row[f"g{b}"] for b in range(1, 8)] == [b != band for b in range(1, 8)]


def _obs(spark, cells):
    """cells: (tile, day, row, col, r, good bands)."""
    rows = []
    for tile, day, r, c, value, good in cells:
        qc = sum(15 << (2 + 4 * (b - 1)) for b in range(1, 8) if b > good)
        rows.append((tile, dt.date(2024, 6, day), r, c, *[value] * 7, qc))
    schema = "tile STRING, date DATE, row INT, col INT, " + ", ".join(f"r{b} INT" for b in range(1, 8)) + ", qc BIGINT"
    return spark.createDataFrame(rows, schema)


def test_gate_accepts_exactly_half(spark):
    half = _obs(spark, [("h18v03", 1, 0, 0, 100, 7), ("h18v03", 1, 0, 1, 100, 0), ("h18v04", 1, 0, 0, 1, 3)])
    got = {r.tile: r.good_fraction for r in cube.tile_gate(half, CubeConfig()).collect()}
    assert got == {"h18v03": 0.5}


def test_range_on_scaled_keeps_the_fill_value_and_on_raw_drops_it(spark):
    obs = _obs(spark, [("h18v03", 1, 0, 0, -28672, 7)])
    kept = cube.clean_bands(obs, CubeConfig()).first()
    dropped = cube.clean_bands(obs, CubeConfig(range_on="raw")).first()
    assert kept.b01 == pytest.approx(-2.8672)
    assert dropped.b01 is None


def test_cube_needs_all_tiles_and_all_must_pass(spark):
    c = CubeConfig(tiles_per_day=2, tile_rows=4, tile_cols=4)
    obs = _obs(
        spark,
        [
            ("h18v03", 1, 0, 0, 100, 7), ("h19v04", 1, 3, 1, 200, 7),  # complete
            ("h18v03", 2, 0, 0, 100, 7),  # a tile is missing
            ("h18v03", 3, 0, 0, 100, 7), ("h19v04", 3, 0, 0, 100, 2),  # a tile fails
            ("h18v03", 4, 0, 0, 100, 7), ("h19v04", 4, 0, 0, 300, 7),
        ],
    )
    coarse = spark.createDataFrame(
        [("h18v03", dt.date(2024, 6, 1), 0, 0, 1)], "tile STRING, date DATE, row INT, col INT, state INT"
    )
    rows = cube.build_cube(obs, coarse, c).orderBy("t", "y").collect()
    assert [(r.t, r.date.day, r.y, r.x, round(r.b01, 4), r.usability) for r in rows] == [
        (0, 1, 0, 0, 0.01, 4), (0, 1, 7, 5, 0.02, 255), (1, 4, 0, 0, 0.01, 255), (1, 4, 4, 4, 0.03, 255),
    ]
    stats = cube.cube_stats(cube.build_cube(obs, coarse, c)).first()
    assert (stats.complete_mosaics, stats.days_in_cube) == (2, 2)


def test_duplicate_tile_rows_disqualify_by_count(spark):
    c = CubeConfig(tiles_per_day=1)
    obs = _obs(spark, [("h18v03", 1, 0, 0, 1, 7), ("h18v04", 1, 0, 0, 1, 7), ("h18v03", 2, 0, 0, 1, 7)])
    assert [r.date.day for r in cube.mosaic_days(obs, c).collect()] == [2]


def test_densify_fills_the_grid(spark):
    few = spark.createDataFrame([(0, 1, 1, 0.5, 0)], "t INT, y INT, x INT, b01 DOUBLE, usability SMALLINT")
    rows = cube.densify(few, 2, 3, 2).collect()
    assert len(rows) == 12 and len({(r.t, r.y, r.x) for r in rows}) == 12
    assert sorted(r.usability for r in rows) == [0] + [255] * 11
    assert sum(r.b01 is None for r in rows) == 11


def test_cube_round_trip_prunes_and_keeps_metadata(spark, tmp_path):
    rows = [(t, y, x, float(y), 0) for t in range(2) for y in range(32) for x in range(32)]
    df = spark.createDataFrame(rows, "t INT, y INT, x INT, b01 DOUBLE, usability SMALLINT")
    df = cube.with_band_metadata(df, CubeConfig(bands=(1,)))
    path = str(tmp_path / "cube")
    tables.write_cube(df, path, patch=8, chunk=16)
    back = tables.read_cube(spark, path)
    assert back.count() == len(rows)
    assert back.schema["b01"].metadata["long_name"] == "Red"
    assert "4=Cloudy" in back.schema["usability"].metadata["usability_mask_key"]
    boxed = tables.read_cube(spark, path, box=(0, 16, 8, 20), patch=8, chunk=16)
    assert tables.read_cube(spark, path, box=(0, 16, 8, 20)).count() == boxed.count() > 0
    with pytest.raises(ValueError):
        tables.read_cube(spark, path, box=(0, 16, 8, 20), patch=224)
    assert boxed.count() == 2 * 8 * 4
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cy" in plan and "PushedFilters: [IsNotNull(py)" in plan


def test_config_is_checked():
    for bad in ({"bands": ()}, {"bands": (8,)}, {"range_on": "x"}, {"tiles_per_day": 0}, {"min_valid_fraction": 2}):
        with pytest.raises(ValueError):
            CubeConfig(**bad)


def test_patch_keys_of_another_size_are_refused(spark):
    cells = spark.createDataFrame([(9, 17)], "y INT, x INT")
    keyed = with_patch(cells, 8)
    assert tuple(with_patch(keyed, 8).select("y_coord", "x_coord").first()) == (8, 16)
    with pytest.raises(ValueError):
        with_patch(keyed, 16)
    bare = keyed.select("y", "x", (F.col("y_coord") + 0).alias("y_coord"), (F.col("x_coord") + 0).alias("x_coord"))
    assert tuple(with_patch(bare, 16).select("y_coord", "x_coord").first()) == (0, 16)


def test_mask_fill_is_a_parameter(spark):
    row = spark.range(1).select(quality.usability(F.lit(65535), mask_fill=200).alias("a"), quality.usability(F.lit(65535)).alias("b")).first()
    assert (row.a, row.b) == (200, 255)


def test_frames_need_the_shape(spark, sf):
    with pytest.raises(ValueError):
        intrinsic.cube_metrics(derived.cube(spark, sf), DifficultyConfig(patch=8), times=12)


def test_fill_words_are_parameters(spark):
    obs = _obs(spark, [("h18v03", 1, 0, 0, -28672, 7), ("h18v03", 1, 0, 1, 5, 7)])
    c = CubeConfig(reflectance_fill=-28672)
    assert [r.b01 for r in cube.clean_bands(obs, c).orderBy("col").collect()] == [None, pytest.approx(0.0005)]
    words = obs.withColumn("qc", F.lit(0).cast("bigint"))
    assert cube.clean_bands(words, CubeConfig(qc_fill=0)).filter("b01 IS NOT NULL").count() == 0


def test_chunks_are_built_with_one_movement_of_the_cells(spark, tmp_path):
    c = CubeConfig(tiles_per_day=2, tile_rows=8, tile_cols=8, chunk=4, min_valid_fraction=0.0)
    cells = [(tile, day, r, k, 100 * day + r, 7) for tile in ("h18v03", "h18v04") for day in (1, 3) for r in range(8) for k in range(8) if (r + k) % 5]
    obs = _obs(spark, cells)
    rows = [(tile, dt.date(2024, 6, day), r, k, (r + k) % 9) for tile in ("h18v03", "h18v04") for day in (1, 2, 3) for r in range(4) for k in range(3)]
    coarse = spark.createDataFrame(rows, "tile STRING, date DATE, row INT, col INT, state INT")
    built = cube.build_chunks(obs, coarse, c)
    want = cube.build_cube(obs, coarse, c).collect()
    assert sorted(map(str, built.drop("cy", "cx").collect())) == sorted(map(str, want)) and len(want) == len(cells)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    path = str(tmp_path / "cube")
    tables.write_cube(built, path, patch=2, chunk=4, placed=True)
    assert tables.read_cube(spark, path, box=(0, 0, 4, 4)).count() == sum(t == "h18v03" and r < 4 and k < 4 for t, _, r, k, _, _ in cells)
    with pytest.raises(ValueError):
        cube.build_chunks(obs, coarse, CubeConfig(chunk=3))

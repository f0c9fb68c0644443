import datetime as dt
import glob
import json
import time

import pytest
from pyspark.sql import functions as F

from gridloom.operators import landcover, manifest
from gridloom.sources import listing, tables, workspace


def _files(spark, names):
    rows = [(i, n, 5) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "pos BIGINT, name STRING, size BIGINT")


def _name(doy, tile, n=0):
    return f"MOD09GA.A2024{doy:03d}.{tile}.061.{n}.hdf"


def test_csv_listing_with_blanks_and_json_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name, last-modified, size\nx.A2024001.h18v03.hdf, 2024-01-01 10:00, 12\ndir, , 0\n")
    (tmp_path / "b.json").write_text(json.dumps({"content": [{"name": "y", "size": 7}, {"name": "z", "size": "0"}]}))
    a = listing.read_listing(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.json")).collect()
    assert [tuple(r) for r in a] == [("x.A2024001.h18v03.hdf", 12), ("dir", 0)]
    b = listing.read_listing(spark, str(tmp_path / "no.csv"), str(tmp_path / "b.json")).collect()
    assert [tuple(r) for r in b] == [("y", 7), ("z", 0)]


def test_parse_skips_short_names_and_keeps_unknown_days(spark):
    df = _files(spark, [_name(60, "h18v03"), "a.b", "a.b.c", "plain"])
    rows = {r.name: r for r in manifest.parse_granules(df).collect()}
    assert set(rows) == {_name(60, "h18v03"), "a.b.c"}
    assert rows[_name(60, "h18v03")].date == dt.date(2024, 2, 29)
    assert rows["a.b.c"].date is None and rows["a.b.c"].tile == "c"


def test_cap_counts_after_the_skip(spark):
    names = [_name(1, f"h18v0{i}") for i in range(6)]
    g = manifest.parse_granules(_files(spark, names))
    present = spark.createDataFrame([(names[0], 9), (names[1], 0), (names[3], 4)], "name STRING, size BIGINT")
    got = [r.name for r in manifest.pending(g, present, 2).orderBy("pos").collect()]
    assert got == [names[1], names[2]]


def test_cap_on_a_hot_day_acts_before_the_shuffle(spark):
    names = [_name(1 if i % 3 else 2 + i % 50, "h18v03", i) for i in range(3000)]
    g = manifest.parse_granules(_files(spark, names))
    none = spark.createDataFrame([], "name STRING, size BIGINT")
    capped = manifest.pending(g, none, 10)
    assert capped.filter("date = DATE'2024-01-01'").count() == 10
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_completeness_is_exact_and_the_day_cut_comes_first(spark):
    per_day = {1: 3, 2: 4, 3: 5, 4: 4}
    names = [_name(d, f"h1{i}v03", i) for d, n in per_day.items() for i in range(n)]
    g = manifest.parse_granules(_files(spark, names))
    assert sorted(r.date.day for r in manifest.complete_days(g, 4).collect()) == [2, 4]
    assert [r.date.day for r in manifest.complete_days(g, 4, first_n=3).collect()] == [2]
    files = manifest.files_by_day(g, manifest.complete_days(g, 4)).collect()
    assert {r.date.day: len(r.files) for r in files} == {2: 4, 4: 4}
    tiles = manifest.first_day_tiles(g, manifest.complete_days(g, 4)).collect()
    assert sorted(r.tile for r in tiles) == ["h10v03", "h11v03", "h12v03", "h13v03"]


def test_paths(spark):
    df = spark.createDataFrame([("MOD09GA", 2024, 7)], "product STRING, year INT, day INT")
    for base, home, want in [
        ("/data", None, "/data/MOD09GA/2024/007"),
        ("raw", None, "./raw/MOD09GA/2024/007"),
        ("~/raw", None, "./~/raw/MOD09GA/2024/007"),
        ("~/raw", "/home/u", "/home/u/raw/MOD09GA/2024/007"),
    ]:
        row = manifest.day_paths(df, "https://a/61/", base, home).first()
        assert (row.src, row.dest) == ("https://a/61/MOD09GA/2024/007", want)


def test_day_range(spark):
    df = spark.createDataFrame([(175, 3), (10, 0)], "start INT, n INT")
    assert [r.day for r in manifest.day_range(df, "start", "n").orderBy("day").collect()] == [175, 176, 177]


def test_missing_land_cover_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.scan_landcover(spark, str(tmp_path / "none" / "*.parquet"))


def test_first_valid_source_wins(spark):
    rows = [(0, 0, "b", 30), (0, 0, "a", 0), (0, 0, "c", 50), (0, 1, "a", 0), (0, 2, None, None)]
    df = spark.createDataFrame(rows, "y INT, x INT, tile_order STRING, lc INT")
    got = {(r.y, r.x): r.lc for r in landcover.mosaic_first(df, ["y", "x"]).collect()}
    assert got == {(0, 0): 30, (0, 1): 0, (0, 2): 0}


def test_inverse_sinusoidal_corner(spark):
    # the upper-left corner of tile h18v03 lies on the 60th parallel and the zero meridian
    df = spark.createDataFrame([("h18v03", 0, 0)], "tile STRING, row INT, col INT")
    row = landcover.cell_lat_lon(df).first()
    assert row.lat == pytest.approx(60 - 10 / 2400 / 2, abs=1e-6)
    assert row.lon == pytest.approx(10 / 2400 / 2 * 2, abs=2e-4)


def test_materialize_reuses_the_first_result(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert workspace.materialize(spark.range(3).withColumn("v", F.lit(1)), path).count() == 3
    assert workspace.materialize(spark.range(9).withColumn("v", F.lit(2)), path).agg(F.sum("v")).first()[0] == 3


def test_cuts_go_to_the_working_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "work_dir", lambda _: str(tmp_path))
    fixed = workspace.cut(spark.range(5).withColumn("v", F.rand()))
    assert str(tmp_path) in fixed.inputFiles()[0]
    assert fixed.collect() == fixed.collect()


def test_a_cut_frees_its_exchanges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(workspace, "work_dir", lambda _: str(tmp_path))
    local = spark.sparkContext.getConf().get("spark.local.dir", "/tmp")

    def shuffled():
        return {x for x in glob.glob(f"{local}/blockmgr-*/*/shuffle_*") + glob.glob(f"{local}/*/blockmgr-*/*/shuffle_*") if x.endswith(".data")}

    before = shuffled()
    table = spark.range(1000).repartition(3, "id")
    assert table.count() == 1000 and shuffled() - before  # an action of its own keeps its files
    before |= shuffled()
    setting = spark.conf.get(workspace.FREE_SHUFFLES)
    fixed = workspace.cut(table)
    end = time.monotonic() + 5
    while shuffled() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(workspace.FREE_SHUFFLES) == setting and fixed.count() == 1000


def test_work_dir_follows_the_session_and_refuses_a_cluster_without_one():
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    given = Session(spark_checkpoint_dir="hdfs://shared/cp/", spark_master="yarn", spark_app_id="app-1")
    assert workspace.work_dir(given) == "hdfs://shared/cp/gridloom/app-1"  # a run's own folder
    with pytest.raises(ValueError):
        workspace.work_dir(Session(spark_master="yarn"))


def test_directories_are_neither_fetched_nor_counted_and_caps_are_per_product(spark):
    names = ["P.A2024001.h18v03.061.hdf", "P.A2024001.h18v04.061.hdf", "Q.A2024001.h18v03.061.hdf", "P.A2024001.h19v03.061.hdf", "x.y.z", "u.v.w"]
    sizes = [0, 5, 5, 5, 5, 5]
    rows = [(i, n, s) for i, (n, s) in enumerate(zip(names, sizes))]
    listing_ = manifest.parse_granules(spark.createDataFrame(rows, "pos INT, name STRING, size INT"))
    none = spark.createDataFrame([], "name STRING, size INT")
    got = {r.name for r in manifest.pending(listing_, none, 1).collect()}
    assert got == {names[1], names[2], "x.y.z", "u.v.w"}


def test_metric_scan_takes_the_first_path_per_model(spark, tmp_path):
    schema = "model STRING, y_coord INT, rmse DOUBLE"
    for folder, value in (("b", 2), ("a", 1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Full_FT_detailed_patch_metrics.csv").write_text(f"model,y_coord,rmse\nold,0,{value}.0\n")
    got = tables.scan_patch_metrics(spark, str(tmp_path), {"Full (FT)": "Full_FT", "Gone": "Gone"}, schema)
    assert [tuple(r) for r in got.collect()] == [("Full (FT)", 0, 1.0)]
    with pytest.raises(FileNotFoundError):
        tables.scan_patch_metrics(spark, str(tmp_path), {"Gone": "Gone"}, schema)


def test_results_are_reused_until_plan_inputs_or_parameters_change(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "result")
    spark.range(3).write.parquet(source)

    def files():
        return sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / "result").iterdir())

    read = spark.read.parquet
    assert workspace.reuse(read(source), path, [source]).count() == 3
    first = files()
    assert workspace.reuse(read(source), path, [source]).count() == 3 and files() == first
    assert workspace.reuse(read(source).filter("id > 0"), path, [source]).count() == 2
    assert workspace.reuse(read(source).filter("id > 1"), path, [source]).count() == 1
    again = files()
    assert workspace.reuse(read(source).filter("id > 1"), path, [source], {"n": 1}).count() == 1 and files() != again
    spark.range(9).write.mode("overwrite").parquet(source)
    assert workspace.reuse(read(source).filter("id > 1"), path, [source], {"n": 1}).count() == 7


def test_product_and_days_reach_the_listing_reader(spark, tmp_path):
    names = ["MOD09GA.A2024001.h18v03.061.1.hdf", "MOD09GA.A2024002.h18v03.061.1.hdf", "MOD09GQ.A2024001.h18v03.061.1.hdf", "README", "MOD09GA.A2024003.h18v04.061.1.hdf"]
    path = str(tmp_path / "listing")
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name STRING, size INT")
    rows.repartition(3).write.option("header", True).csv(path)
    found = listing.read_days(spark, path, path, "MOD09GA", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert sorted((r.name, r.size) for r in found.collect()) == [(names[0], 0), (names[1], 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(name,MOD09GA.A2024001)" in plan and "LessThan(name,MOD09GA.A2024003)" in plan
    other = tmp_path / "listing.json"
    other.write_text(json.dumps({"content": [{"name": n, "size": str(i)} for i, n in enumerate(names)]}))
    again = listing.read_days(spark, str(tmp_path / "none"), str(other), "MOD09GA", dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))

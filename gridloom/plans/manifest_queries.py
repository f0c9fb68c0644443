"""Listing and manifest queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridloom.config import DEFAULT_TILES
from gridloom.operators import landcover, manifest
from gridloom.plans.ctes import sql_over
from gridloom.plans.registry import query
from gridloom.sources import derived, listing, tables, workspace

_TILES = DEFAULT_TILES[:3]
_IN = ", ".join(f"'{t}'" for t in _TILES)
_PRESENT = "SELECT name, o % 2 AS size FROM (SELECT name, pos // 3 AS o FROM parsed WHERE pos % 3 = 0)"


def _parsed(spark, d):
    return manifest.parse_granules(derived.granules(spark, d))


def _present(spark, d):
    return (
        derived.granules(spark, d)
        .filter("pos % 3 = 0")
        .select("name", F.expr("(pos div 3) % 2").alias("size"))
    )


@query("o_a1_listing_csv", sql_over("granules", "SELECT name, size FROM granules"))
def listing_csv(spark, d):
    lines = derived.granules(spark, d).select(F.concat("name", F.lit(",  "), "size").alias("line"))
    return listing.parse_listing_lines(lines, "line")


@query("o_a1_listing_json", sql_over("granules", "SELECT name, size FROM granules"))
def listing_json(spark, d):
    entry = F.struct("name", F.col("size").cast("string").alias("size"))
    docs = derived.granules(spark, d).select(
        F.to_json(F.struct(F.array(entry).alias("content"))).alias("doc")
    )
    return listing.parse_listing_documents(docs, "doc")


@query(
    "o_a1_read_days",
    sql_over("parsed", "SELECT name, size FROM parsed WHERE product = 'MOD09GA' AND date BETWEEN DATE '1996-01-01' AND DATE '2010-12-31'"),
)
def read_days(spark, d):
    """Listing pages as files, read for one product and fifteen years."""
    path = workspace.new_path(spark, "listing")
    derived.granules(spark, d).select("name", "size").write.option("header", True).csv(path)
    return listing.read_days(spark, path, path + ".json", "MOD09GA", dt.date(1996, 1, 1), dt.date(2010, 12, 31))


@query("o_a2_granule_parse", sql_over("parsed", "SELECT name, product, year, doy, tile, date FROM parsed"))
def granule_parse(spark, d):
    return _parsed(spark, d).select("name", "product", "year", "doy", "tile", "date")


@query("o_a3_tile_allowlist", sql_over("parsed", f"SELECT name, tile FROM parsed WHERE tile IN ({_IN})"))
def tile_allowlist(spark, d):
    return manifest.select_tiles(_parsed(spark, d), _TILES).select("name", "tile")


@query(
    "o_a4_missing_files",
    sql_over(
        "parsed",
        "SELECT name FROM parsed WHERE size <> 0 AND name NOT IN (SELECT name FROM present WHERE size > 0)",
        present=_PRESENT,
    ),
)
def missing_files(spark, d):
    return manifest.missing(_parsed(spark, d), _present(spark, d)).select("name")


@query(
    "o_a5_daily_cap",
    sql_over(
        "parsed",
        """SELECT date, name FROM parsed WHERE size <> 0 AND name NOT IN (SELECT name FROM present WHERE size > 0)
  QUALIFY date IS NULL OR row_number() OVER (PARTITION BY product, date ORDER BY pos) <= 2""",
        present=_PRESENT,
    ),
)
def daily_cap(spark, d):
    return manifest.pending(_parsed(spark, d), _present(spark, d), max_per_day=2).select("date", "name")


@query(
    "o_a6_paths",
    sql_over(
        "parsed",
        """SELECT name,
  'https://archive.example/61/' || product || '/' || CAST(year AS VARCHAR) || '/' || lpad(CAST(doy AS VARCHAR), 3, '0') AS src,
  './raw/' || product || '/' || CAST(year AS VARCHAR) || '/' || lpad(CAST(doy AS VARCHAR), 3, '0') AS dest
  FROM parsed""",
    ),
)
def paths(spark, d):
    days = _parsed(spark, d).withColumnRenamed("doy", "day")
    return manifest.day_paths(days, "https://archive.example/61", "raw").select("name", "src", "dest")


@query(
    "o_a7_day_range",
    """SELECT c_custkey, CAST(unnest(range(1 + c_custkey % 300, 1 + c_custkey % 300 + c_custkey % 5)) AS BIGINT) AS day
  FROM customer""",
)
def day_range(spark, d):
    ranges = derived.table(spark, d, "customer").select(
        "c_custkey", F.expr("1 + c_custkey % 300").alias("start"), F.expr("c_custkey % 5").alias("n")
    )
    return manifest.day_range(ranges, "start", "n").select("c_custkey", "day")


@query(
    "o_a8_directories",
    sql_over("granules", "SELECT name, CASE WHEN size = 0 THEN 'dir' ELSE 'file' END AS kind FROM granules"),
)
def directories(spark, d):
    return manifest.classify_entries(derived.granules(spark, d)).select("name", "kind")


@query(
    "o_a9_recursive_scan",
    """SELECT 'orders.parquet' AS file, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders""",
)
def recursive_scan(spark, d):
    rows = listing.scan_files(spark, d, "orders.parquet")
    file = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    return rows.groupBy(file).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("o_a10_first_days", sql_over("parsed", "SELECT DISTINCT date FROM parsed ORDER BY date LIMIT 500"))
def first_days(spark, d):
    return manifest.first_days(_parsed(spark, d), 500)


@query(
    "o_a11_day_files",
    sql_over(
        "parsed",
        """SELECT date, count(*) AS n, min(name) AS first_name FROM parsed
  WHERE date IN (SELECT DISTINCT date FROM parsed ORDER BY date LIMIT 500) GROUP BY date""",
    ),
)
def day_files(spark, d):
    g = _parsed(spark, d)
    kept = manifest.on_days(g, manifest.first_days(g, 500))
    return kept.groupBy("date").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


_COMPLETE = "SELECT date FROM parsed GROUP BY date HAVING count(*) = 5"


@query(
    "o_a12_complete_days",
    sql_over(
        "parsed",
        """SELECT date, string_agg(name, ';' ORDER BY name) AS files FROM parsed
  WHERE date IN (SELECT date FROM complete) GROUP BY date""",
        complete=_COMPLETE,
    ),
)
def complete_days(spark, d):
    g = _parsed(spark, d)
    files = manifest.files_by_day(g, manifest.complete_days(g, 5))
    return files.select("date", F.array_join("files", ";").alias("files"))


@query(
    "o_a13_first_day_tiles",
    sql_over(
        "parsed",
        "SELECT DISTINCT tile FROM parsed WHERE date = (SELECT min(date) FROM complete)",
        complete=_COMPLETE,
    ),
)
def first_day_tiles(spark, d):
    g = _parsed(spark, d)
    return manifest.first_day_tiles(g, manifest.complete_days(g, 5))


@query(
    "o_a14_landcover_scan",
    sql_over("lctiles", "SELECT tile_lat, tile_lon, src_row, src_col, lc FROM lctiles"),
)
def landcover_scan(spark, d):
    path = workspace.new_path(spark, "landcover")
    tables.write_by(derived.landcover_tiles(spark, d), path, "tile_order")
    found = tables.scan_landcover(spark, f"{path}/*/*.parquet")
    return found.select("tile_lat", "tile_lon", "src_row", "src_col", "lc")


@query(
    "o_a15_region_clip",
    """SELECT o_orderkey, lat, lon FROM (SELECT o_orderkey, 35e0 + (o_orderkey % 3000) / 1e2 AS lat,
  -10e0 + (o_custkey % 5000) / 1e2 AS lon FROM orders)
  WHERE lat BETWEEN 39.75e0 AND 60.25e0 AND lon BETWEEN -0.75e0 AND 28.75e0""",
)
def region_clip(spark, d):
    points = derived.table(spark, d, "orders").select(
        "o_orderkey",
        (F.lit(35.0) + (F.col("o_orderkey") % 3000) / F.lit(100.0)).alias("lat"),
        (F.lit(-10.0) + (F.col("o_custkey") % 5000) / F.lit(100.0)).alias("lon"),
        "o_totalprice",
    )
    return landcover.clip_to_region(points, -0.5, 40.0, 28.5, 60.0, keep=["o_orderkey", "lat", "lon"])

"""Granule listing: name parsing, selection of days and tiles, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_granules(listing: DataFrame) -> DataFrame:
    """Product, year, day of year, tile and date of each granule name.

    Names of fewer than three dot-separated parts are skipped; a name without
    an acquisition day keeps NULL there.
    """
    parts = F.split("name", r"\.")
    stamp = r"A(\d{4})(\d{3})"

    def number(group):
        return F.regexp_extract("name", stamp, group).try_cast("int")

    return (
        listing.filter(F.size(parts) >= 3)
        .withColumns(
            {
                "product": parts[0],
                "year": number(1),
                "doy": number(2),
                "tile": parts[2],
            }
        )
        .withColumn("date", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("doy") - 1))
    )


def select_tiles(granules: DataFrame, tiles: list[str]) -> DataFrame:
    return granules.filter(F.col("tile").isin(tiles))


def classify_entries(listing: DataFrame) -> DataFrame:
    """Zero-sized entries are directories."""
    return listing.withColumn("kind", F.when(F.col("size") == 0, "dir").otherwise("file"))


def pending(
    granules: DataFrame, present: DataFrame, max_per_day: int = 10, order: str = "pos"
) -> DataFrame:
    """Files not yet stored with content, at most ``max_per_day`` a product and day in listing order.

    Directories are neither fetched nor counted. The cap on the row number reaches the
    map side as a group limit, so a day that holds most of the listing still
    sends few rows.
    """
    return cap_per_day(missing(granules, present), max_per_day, order)


def missing(granules: DataFrame, present: DataFrame) -> DataFrame:
    """Files among the entries that are not stored with content; directories (size 0) are no files."""
    stored = present.filter("size > 0").select("name")
    files = classify_entries(granules).filter("kind = 'file'").drop("kind")
    return files.join(stored, "name", "left_anti")


def cap_per_day(granules: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first ``n`` of each product and day; names without a day have no cap of a day and are kept."""
    rank = F.row_number().over(W.partitionBy("product", "date").orderBy(order, "name"))
    dated = granules.filter("date IS NOT NULL")
    capped = dated.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
    return capped.unionByName(granules.filter("date IS NULL"))


def day_range(df: DataFrame, start: str, count: str) -> DataFrame:
    """One row per day of ``start .. start + count - 1``; no row for a count below one."""
    days = F.sequence(F.col(start), F.col(start) + F.col(count) - 1)
    return df.filter(F.col(count) > 0).withColumn("day", F.explode(days))


def day_paths(df: DataFrame, archive: str, base: str, home: str | None = None) -> DataFrame:
    """Source URL and target folder per (product, year, day), the day padded to three digits.

    A base that does not start with a slash gets ``./`` in front, ``~`` included;
    give ``home`` to have ``~`` replaced instead.
    """
    root = base.rstrip("/")
    if home is not None and base.startswith("~"):
        root = home.rstrip("/") + root[1:]
    if not root.startswith("/"):
        root = "./" + root
    day = F.lpad(F.col("day").cast("string"), 3, "0")
    tail = [F.col("product"), F.col("year").cast("string"), day]
    return df.withColumns(
        {
            "src": F.concat_ws("/", F.lit(archive.rstrip("/")), *tail),
            "dest": F.concat_ws("/", F.lit(root), *tail),
        }
    )


def first_days(granules: DataFrame, first_n: int | None = None) -> DataFrame:
    """The first ``first_n`` distinct dates, or all of them."""
    days = granules.filter("date IS NOT NULL").select("date").distinct()
    return days if first_n is None else days.orderBy("date").limit(first_n)


def on_days(granules: DataFrame, days: DataFrame) -> DataFrame:
    # one row per calendar day: at most 366 rows per archive year
    return granules.join(F.broadcast(days), "date", "left_semi")


def complete_days(
    granules: DataFrame, tiles_per_day: int = 4, first_n: int | None = None
) -> DataFrame:
    """Dates with exactly ``tiles_per_day`` files, among the first ``first_n`` dates.

    The cut to ``first_n`` comes first, and a duplicate file disqualifies a day.
    """
    picked = granules if first_n is None else on_days(granules, first_days(granules, first_n))
    per_day = picked.filter("date IS NOT NULL").groupBy("date").agg(F.count("*").alias("n"))
    return per_day.filter(F.col("n") == tiles_per_day)


def files_by_day(granules: DataFrame, complete: DataFrame) -> DataFrame:
    """Sorted file names per complete day: groups are bounded by the tiles of a day."""
    return on_days(granules, complete.select("date")).groupBy("date").agg(
        F.sort_array(F.collect_list("name")).alias("files")
    )


def first_day_tiles(granules: DataFrame, complete: DataFrame) -> DataFrame:
    """Tile ids of the earliest complete day."""
    first = complete.agg(F.min("date").alias("date"))
    return on_days(granules, first).select("tile").distinct()

"""File listings: CSV or JSON text, and recursive scans of stored files."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_JSON = "content ARRAY<STRUCT<name: STRING, size: STRING>>"


def _entries(df: DataFrame) -> DataFrame:
    return df.select(F.col("name"), F.col("size").cast("bigint").alias("size"))


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    return _entries(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True))


def read_listing_json(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(_JSON).json(path, multiLine=True)
    return _entries(docs.select(F.explode("content").alias("f")).select("f.*"))


def read_listing(spark: SparkSession, csv_path: str, json_path: str) -> DataFrame:
    """The CSV listing, or the JSON one where no CSV listing can be read."""
    try:
        return read_listing_csv(spark, csv_path)
    except AnalysisException:
        return read_listing_json(spark, json_path)


def read_days(
    spark: SparkSession, csv_path: str, json_path: str, product: str, first: date, last: date
) -> DataFrame:
    """Entries of one product on the days ``first`` to ``last`` of a stored listing.

    Granule names begin with product, year and day of year in fixed width, so product and days are one range of names,
    which Spark hands to the CSV reader; each page (file, or part of a long one) is a task of its own.
    """
    names = [f"{product}.A{day:%Y%j}" for day in (first, last + timedelta(days=1))]
    found = read_listing(spark, csv_path, json_path)
    return found.filter((F.col("name") >= names[0]) & (F.col("name") < names[1]))


def parse_listing_lines(df: DataFrame, line: str) -> DataFrame:
    """Listing lines held in a column: name, size, blanks after commas dropped."""
    parsed = F.from_csv(line, "name STRING, size STRING", {"ignoreLeadingWhiteSpace": "true"})
    return _entries(df.select(parsed.alias("f")).select("f.*"))


def parse_listing_documents(df: DataFrame, document: str) -> DataFrame:
    """JSON listings held in a column."""
    parsed = F.from_json(document, _JSON)
    return _entries(df.select(F.explode(parsed["content"]).alias("f")).select("f.*"))


def scan_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Rows of all Parquet files below ``root`` whose name matches, with their path."""
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(root)
    )
    return rows.withColumn("path", F.col("_metadata.file_path"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per stored file below ``root``: path and length, contents not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )

"""Shared working folder, reuse of finished results, and lineage cuts."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}

#: Spark's setting that frees a query's shuffle files at its end, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster without it is refused, since executors share no local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/gridloom/{spark.conf.get('spark.app.id', 'run')}"
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def forget(spark: SparkSession) -> None:
    """Delete what this application wrote to its working folder; results still to be read from there are lost.

    Call it at the end of a run, when every result has been written elsewhere.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Everything downstream sees one fixed result, whatever executor is lost,
    and a second reader does not run the plan above again. Nobody reads the exchanges
    of that plan again either, so their files go as soon as the table is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` returned, once everything made of them is itself written."""
    for df in cuts:
        spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
        return True
    except AnalysisException:
        return False


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Reuse the finished result at ``path``; else compute, write and read it."""
    spark = df.sparkSession
    if not path_readable(spark, path.rstrip("/") + "/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame, inputs: list[str], params: dict | None = None) -> str:
    """A digest of the plan, the schema, the given parameters, and the files below the input paths.

    Files count by path, length and time of change; their hashes are added up where they are listed.
    """
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    parts = [plan, df.schema.json(), json.dumps(params or {}, sort_keys=True, default=str)]
    for path in inputs:
        files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        hashed = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        state = files.agg(F.count("*").alias("n"), F.sum(hashed).alias("h")).first()
        parts.append(f"{path} {state['n']} {state['h']}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def reuse(df: DataFrame, path: str, inputs: list[str], params: dict | None = None) -> DataFrame:
    """Reuse the finished result at ``path`` if plan, inputs and parameters are those it was made with; else make it anew.

    The fingerprint lies beside the result and is blanked while that is written, so a run that ends halfway leaves
    nothing that looks finished. ``materialize`` asks for the result alone.
    """
    spark, beside, wanted = df.sparkSession, path.rstrip("/") + ".fingerprint", fingerprint(df, inputs, params)

    def note(text: str) -> None:
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(beside)

    known = None
    if path_readable(spark, beside + "/_SUCCESS") and path_readable(spark, path.rstrip("/") + "/_SUCCESS"):
        known = spark.read.text(beside).first()
    if known is None or known["value"] != wanted:
        note("")
        df.write.mode("overwrite").parquet(path)
        note(wanted)
    return spark.read.schema(df.schema).parquet(path)

"""Run reports: stored size and throughput, format comparison, scaling, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.spectral import safe_div

MIB = 1024.0 * 1024.0


def write_report(files: DataFrame, timings: DataFrame) -> DataFrame:
    """Stored size and write speed per format from (format, length) and (format, seconds)."""
    sizes = files.groupBy("format").agg((F.sum("length") / MIB).alias("size_mb"))
    # one timing row per storage format
    return sizes.join(F.broadcast(timings), "format", "left").withColumn(
        "throughput_mb_per_s", safe_div(F.col("size_mb"), F.col("seconds"), 0.0)
    )


def read_report(
    reads: DataFrame, keys: list[str], frames: int, bands: int, patch: int, item_bytes: int
) -> DataFrame:
    """Read speed from (samples, seconds) rows, the bytes following from the sample shape."""
    patch_mb = frames * bands * patch * patch * item_bytes / MIB
    totals = reads.groupBy(*keys).agg(
        F.sum("samples").alias("samples"), F.sum("seconds").alias("seconds")
    )
    return totals.withColumns(
        {
            "total_mb": F.col("samples") * F.lit(patch_mb),
            "throughput_mb_per_s": safe_div(F.col("samples") * F.lit(patch_mb), F.col("seconds"), 0.0),
            "samples_per_second": safe_div(F.col("samples"), F.col("seconds"), 0.0),
        }
    )


def compare_formats(
    report: DataFrame, base: str, other: str, workers: int, keys: list[str] = ()
) -> DataFrame:
    """Speed-up, size ratio, scaling factor and parallel efficiency of two formats.

    ``report`` has (format, workers, size_mb, write_seconds, read_mb_per_s),
    workers being 0 or ``workers``; one conditional aggregate, no self join.
    """
    def at(fmt: str, n: int, column: str):
        hit = (F.col("format") == fmt) & (F.col("workers") == n)
        return F.max(F.when(hit, F.col(column)))

    row = report.groupBy(*keys).agg(
        safe_div(at(base, 0, "write_seconds"), at(other, 0, "write_seconds"), 0.0).alias("write_speedup"),
        safe_div(at(other, 0, "size_mb"), at(base, 0, "size_mb"), 0.0).alias("size_ratio"),
        safe_div(at(other, 0, "read_mb_per_s"), at(base, 0, "read_mb_per_s"), 0.0).alias("read_speedup"),
        safe_div(at(other, workers, "read_mb_per_s"), at(other, 0, "read_mb_per_s"), 0.0).alias("scaling_factor"),
    )
    return row.withColumn(
        "parallel_efficiency_pct", F.col("scaling_factor") / F.lit(float(workers)) * 100
    )


def scaling(runs: DataFrame, base_gpus: int = 8) -> DataFrame:
    """Throughput, speed-up and efficiency per model and number of workers.

    A repeat's throughput is its samples over its slowest worker's time. Speed-up
    is against the run with ``base_gpus`` workers, or against linear scaling
    down to that size where no such run exists.
    """
    repeats = runs.groupBy("model", "gpus", "repeat_id").agg(
        safe_div(F.sum("samples"), F.max("elapsed")).alias("throughput")
    )
    table = repeats.groupBy("model", "gpus").agg(
        F.avg("throughput").alias("throughput_total"), F.stddev_pop("throughput").alias("std")
    )
    base = F.max(F.when(F.col("gpus") == base_gpus, F.col("throughput_total"))).over(W.partitionBy("model"))
    ratio = F.col("gpus") / F.lit(float(base_gpus))
    reference = F.coalesce(F.col("_base"), F.try_divide(F.col("throughput_total"), ratio))
    speedup = safe_div(F.col("throughput_total"), reference)
    return (
        table.withColumn("_base", base)
        .select(
            "model",
            "gpus",
            "throughput_total",
            safe_div(F.col("throughput_total"), F.col("gpus")).alias("throughput_per_gpu"),
            "std",
            speedup.alias("speedup"),
            (speedup / ratio * 100).alias("efficiency_pct"),
        )
    )


def weak_scaling(runs: DataFrame) -> DataFrame:
    """Size and speed per (worker_count, days) from rows with data_size_mb and seconds."""
    return runs.groupBy("worker_count", "days").agg(
        F.sum("data_size_mb").alias("data_size_mb"),
        safe_div(F.sum("data_size_mb"), F.sum("seconds"), 0.0).alias("throughput_mbs"),
    )


def epochs(steps: DataFrame, durations: DataFrame, world: int, validation: DataFrame | None = None) -> DataFrame:
    """Loss, throughput and speed-up per model and epoch, and with ``validation`` steps its loss (``val_loss``).

    ``steps`` has (model, epoch, rank, batch, loss); the epoch loss is the sum
    over ranks and batches divided by workers and by the loader's batches.
    ``durations`` has (model, epoch, samples, batches, seconds), and ``val_batches``, the batches of the validation loader,
    beside ``validation``. Epochs without a validation step have no such loss.
    """
    losses = steps.groupBy("model", "epoch").agg(F.sum("loss").alias("_loss"))
    shown = []
    if validation is not None:
        tested = validation.groupBy("model", "epoch").agg(F.sum("loss").alias("_val"))
        losses = losses.join(tested, ["model", "epoch"], "left")
        shown = [safe_div(F.col("_val") / F.lit(float(world)), F.col("val_batches")).alias("val_loss")]
    first = W.partitionBy("model").orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = losses.join(durations, ["model", "epoch"])
    return joined.select(
        "model",
        "epoch",
        safe_div(F.col("_loss") / F.lit(float(world)), F.col("batches")).alias("loss"),
        *shown,
        safe_div(F.col("samples"), F.col("seconds")).alias("throughput"),
        safe_div(F.first_value("seconds").over(first), F.col("seconds")).alias("speedup"),
    )

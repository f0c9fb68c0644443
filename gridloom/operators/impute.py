"""Gap filling: temporal median, best single frame, user models on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.config import SampleConfig
from gridloom.functions.spectral import add
from gridloom.schemas import SAMPLE_KEY

_CELL = [*SAMPLE_KEY, "y", "x"]


def _scored(c: SampleConfig) -> list[str]:
    return [f"{kind}_{b}" for kind in ("target", "valid") for b in c.bands]


def temporal_median(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Lower median over the window of each cell and band, beside the cell's truth.

    The window lies in the row, so nothing moves.
    """
    middle = F.lit((c.window - 1) // 2)
    medians = [F.get(F.sort_array(f"in_{b}"), middle).alias(f"pred_{b}") for b in c.bands]
    return cells.select(*_CELL, *medians, *_scored(c))


def best_frames(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Per sample the input frame closest to the truth over all bands and cells, with its error.

    One partial aggregate of T sums per sample; the earliest frame wins ties.
    The mean is over the whole patch.
    """
    n = len(c.bands) * c.patch * c.patch

    def error(k: int):
        d = [F.get(f"in_{b}", F.lit(k)) - F.col(f"target_{b}") for b in c.bands]
        return F.sum(add([v * v for v in d])) / n

    options = [F.struct(error(k).alias("mse"), F.lit(k).alias("k")) for k in range(c.window)]
    best = cells.groupBy(*SAMPLE_KEY).agg(F.array_min(F.array(*options)).alias("_b"))
    return best.select(
        *SAMPLE_KEY,
        (F.col("t_start") + F.col("_b.k")).alias("t"),
        F.col("_b.mse").alias("frame_mse"),
    )


def oracle_frame(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """Every sample's best single frame as its prediction, in one pass over the cells.

    A sample's cells are buffered while the errors of its T frames are summed (a window without an order, whose buffer spills), then go
    out with the frame of least error, the earliest on ties. Cells placed by patch do not move.
    """
    n = len(c.bands) * c.patch * c.patch
    sample = W.partitionBy(*SAMPLE_KEY)

    def error(k: int):
        d = [F.get(f"in_{b}", F.lit(k)) - F.col(f"target_{b}") for b in c.bands]
        return F.sum(add([v * v for v in d])).over(sample) / n

    options = [F.struct(error(k).alias("mse"), F.lit(k).alias("k")) for k in range(c.window)]
    inputs = [f"in_{b}" for b in c.bands]
    summed = cells.select(*_CELL, *inputs, *_scored(c), F.array_min(F.array(*options)).alias("_b"))
    return summed.select(
        *_CELL,
        (F.col("t_start") + F.col("_b.k")).alias("t"),
        F.col("_b.mse").alias("frame_mse"),
        *[F.get(f"in_{b}", F.col("_b.k")).alias(f"pred_{b}") for b in c.bands],
        *_scored(c),
    )


def stack_inputs(cells: DataFrame, c: SampleConfig) -> DataFrame:
    """One flat array per sample, in (band, frame, row, column) order.

    A group is one dense sample: patch x patch cells. For wide patches take
    ``predict_cells``, which holds one sample at a time.
    """
    entry = F.struct("y", "x", *[F.col(f"in_{b}").cast("array<float>").alias(b) for b in c.bands])
    grouped = cells.groupBy(*SAMPLE_KEY).agg(F.sort_array(F.collect_list(entry)).alias("_c"))

    def plane(b: str, k: int):
        return F.transform("_c", lambda e: F.get(e[b], F.lit(k)))

    planes = [plane(b, k) for b in c.bands for k in range(c.window)]
    return grouped.select(*SAMPLE_KEY, F.concat(*planes).alias("input"))


def predict(
    stacks: DataFrame, model: Callable[[np.ndarray], np.ndarray], batch_rows: int = 64
) -> DataFrame:
    """Run a user model over samples: ``input`` is one flat float array per row.

    The model gets an array of shape (rows, values) and returns one of shape
    (rows, outputs). Rows arrive in Arrow batches within the session's row and
    byte limits, cut to ``batch_rows``; no group is collected. Load weights
    lazily inside ``model``.
    """
    schema = T.StructType([*stacks.schema.fields, T.StructField("output", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows].copy()
                made = model(np.stack(part["input"].to_numpy()).astype(np.float32))
                part["output"] = list(np.asarray(made, dtype=np.float32))
                yield part

    return stacks.mapInPandas(run, schema)


def predict_cells(
    cells: DataFrame, c: SampleConfig, model: Callable[[np.ndarray], np.ndarray], batch: int = 8, resources: ResourceProfile | None = None
) -> DataFrame:
    """Run a user model on up to ``batch`` samples at once; predictions come back beside each cell's truth.

    The model gets (samples, bands, frames, rows, columns) and returns (samples, bands, rows, columns); absent cells
    are 0. Cells already placed by patch do not move; a task streams them sorted by sample (the sort can spill) and holds
    the samples of one batch. The last batch of a task may be smaller. ``resources`` is a stage's own resource profile, say
    one GPU a task.
    """
    kept = [*_CELL, *_scored(c)]
    inputs = [f"in_{b}" for b in c.bands]
    number = F.row_number().over(W.partitionBy(*SAMPLE_KEY).orderBy("y", "x"))
    flat = cells.select(*kept, *inputs, number.alias("_number"))
    schema = T.StructType(
        [*(flat.schema[k] for k in kept), *(T.StructField(f"pred_{b}", T.DoubleType()) for b in c.bands)]
    )

    def predicted(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        sample = np.cumsum(table.column("_number").to_numpy() == 1) - 1
        y = table.column("y").to_numpy() - table.column("y_coord").to_numpy()
        x = table.column("x").to_numpy() - table.column("x_coord").to_numpy()
        stack = np.zeros((int(sample[-1]) + 1, len(c.bands), c.window, c.patch, c.patch))
        for i, name in enumerate(inputs):
            values = table.column(name).combine_chunks().flatten().to_numpy()
            stack[sample, i, :, y, x] = values.reshape(-1, c.window)
        made = np.asarray(model(stack), dtype=float)
        columns = [table.column(k).combine_chunks() for k in kept]
        columns += [pa.array(made[sample, i, y, x]) for i in range(len(c.bands))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], 0  # batches in hand, samples begun in them
        for rows in batches:
            starts = np.flatnonzero(rows.column("_number").to_numpy() == 1)
            at = 0
            while seen + len(starts) > batch:  # the sample after the last whole batch has begun
                cut = int(starts[batch - seen])
                yield predicted(pa.Table.from_batches([*held, rows.slice(at, cut - at)], rows.schema))
                held, starts, at, seen = [], starts[batch - seen :], cut, 0
            held.append(rows.slice(at))
            seen += len(starts)
        held = [h for h in held if h.num_rows]
        if held:
            yield predicted(pa.Table.from_batches(held))

    return flat.mapInArrow(run, schema, profile=resources)

"""Prediction scores per sample: RMSE, PSNR, SSIM, spectral angle, masked loss.

Predictions are cells with ``pred_*``, ``target_*`` and ``valid_*`` columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.spectral import add, psnr_from_rmse, spectral_angle
from gridloom.operators.samples import BLOCK_ROWS

# Fixed values of the structural similarity: window edge and stabilisers.
SSIM_WINDOW = 7
SSIM_K1 = 0.01
SSIM_K2 = 0.03


def _square(b: str) -> Column:
    d = F.col(f"pred_{b}") - F.col(f"target_{b}")
    return d * d


def _mse(bands: list[str]) -> Column:
    """Mean over valid values; over all values where none is valid."""
    valid_sum = add([F.sum(F.when(F.col(f"valid_{b}"), _square(b)).otherwise(0.0)) for b in bands])
    valid_n = add([F.count_if(f"valid_{b}") for b in bands])
    all_sum = add([F.sum(_square(b)) for b in bands])
    all_n = F.count("*") * len(bands)
    return F.when(valid_n > 0, F.try_divide(valid_sum, valid_n)).otherwise(all_sum / all_n)


def _sam(bands: list[str]) -> Column:
    """Mean angle over cells valid in every band, 0 where there is none."""
    angle = spectral_angle(
        [F.col(f"pred_{b}") for b in bands], [F.col(f"target_{b}") for b in bands]
    )
    every = F.col(f"valid_{bands[0]}")
    for b in bands[1:]:
        every = every & F.col(f"valid_{b}")
    return F.coalesce(F.avg(F.when(every, angle)), F.lit(0.0))


def _pixel_columns(rmse: Column, data_range: float) -> list[Column]:
    return [rmse.alias("rmse"), psnr_from_rmse(rmse, data_range).alias("psnr"), F.col("sam")]


def pixel_scores(cells: DataFrame, keys: list[str], bands: list[str], data_range: float = 1.0) -> DataFrame:
    """RMSE, PSNR and angle of each sample in one partial aggregate."""
    sums = cells.groupBy(*keys).agg(_mse(bands).alias("_mse"), _sam(bands).alias("sam"))
    return sums.select(*keys, *_pixel_columns(F.sqrt("_mse"), data_range))


def _box_means(stack: np.ndarray) -> np.ndarray:
    """Means over all full windows of the last two axes, by differences of running sums."""
    w = SSIM_WINDOW
    for axis in (-1, -2):
        total = np.cumsum(np.moveaxis(stack, axis, -1), axis=-1)
        total = np.concatenate([np.zeros_like(total[..., :1]), total], axis=-1)
        stack = np.moveaxis(total[..., w:] - total[..., :-w], -1, axis)
    return stack / float(w * w)


def _similarity(pred: np.ndarray, target: np.ndarray, data_range: float) -> np.ndarray:
    """Similarity of every full window of (..., row, column) stacks."""
    n = SSIM_WINDOW * SSIM_WINDOW
    c1, c2 = (SSIM_K1 * data_range) ** 2, (SSIM_K2 * data_range) ** 2
    mp, mt = _box_means(pred), _box_means(target)
    unbias = n / (n - 1.0)
    vp = unbias * (_box_means(pred * pred) - mp * mp)
    vt = unbias * (_box_means(target * target) - mt * mt)
    cov = unbias * (_box_means(pred * target) - mp * mt)
    return ((2 * mp * mt + c1) * (2 * cov + c2)) / ((mp * mp + mt * mt + c1) * (vp + vt + c2))


def _check(patch: int) -> None:
    if patch < SSIM_WINDOW:
        raise ValueError(f"patch must be at least {SSIM_WINDOW}")


def _row_blocks(cells: DataFrame, patch: int) -> tuple[DataFrame, int]:
    """Cells by block of ``BLOCK_ROWS`` window rows (column ``_unit``), and the rows of a block.

    A window starts in its block and reaches six rows further, so the first six rows of a block go to the one before
    as well. A patch of few rows is one block, and nothing is copied.
    """
    halo = SSIM_WINDOW - 1
    starts = patch - halo
    if starts <= BLOCK_ROWS:
        return cells.withColumn("_unit", F.lit(0)), patch
    line = F.col("y") - F.col("y_coord")
    own = F.floor(line / BLOCK_ROWS).cast("int")
    last = (starts - 1) // BLOCK_ROWS
    first = F.when(line % BLOCK_ROWS < halo, own - 1).otherwise(own)
    units = F.sequence(F.greatest(first, F.lit(0)), F.least(own, F.lit(last)))
    return cells.withColumn("_unit", F.explode(units)), BLOCK_ROWS + halo


def _window_sums(cells: DataFrame, keys: list[str], bands: list[str], patch: int, data_range: float) -> DataFrame:
    """Sum of the similarity over the windows of each block of a sample that has cells, and their number.

    A row number makes the planner bring a block's cells together (nothing moves where they already lie so); the sorted rows,
    which can spill, stream through Arrow batches. A task holds the batch at hand and the one block that is not
    complete yet, never a whole wide sample. Absent cells are 0.
    """
    values = [f"{kind}_{b}" for kind in ("pred", "target") for b in bands]
    blocks, height = _row_blocks(cells, patch)
    place = ((F.col("y") - F.col("y_coord") - F.col("_unit") * BLOCK_ROWS) * patch + F.col("x") - F.col("x_coord")).cast("int")
    number = F.row_number().over(W.partitionBy(*keys, "_unit").orderBy(F.lit(0)))
    rows = blocks.select(*keys, "_unit", place.alias("_pos"), *values).withColumn("_number", number)
    kept = [rows.schema[k] for k in keys]
    schema = T.StructType([*kept, T.StructField("_sum", T.DoubleType()), T.StructField("_windows", T.LongType())])
    area, starts = height * patch, patch - SSIM_WINDOW + 1
    step = max(1, 2**20 // (len(values) * area))

    def scored(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        first = np.flatnonzero(table.column("_number").to_numpy() == 1)
        ends = np.append(first[1:], table.num_rows)
        pos = table.column("_pos").to_numpy()
        # rows of windows that start in the block
        lines = np.minimum(height - SSIM_WINDOW + 1, starts - table.column("_unit").to_numpy()[first] * BLOCK_ROWS)
        found = []
        for at in range(0, len(first), step):
            n = len(first[at : at + step])
            low, high = first[at], ends[at + n - 1]
            unit = np.repeat(np.arange(n), ends[at : at + n] - first[at : at + n])
            stack = np.zeros((n, len(values), area))
            for i, name in enumerate(values):
                stack[unit, i, pos[low:high]] = table.column(name).slice(low, high - low).to_numpy()
            stack = stack.reshape(n, len(values), height, patch)
            per_line = _similarity(stack[:, : len(bands)], stack[:, len(bands) :], data_range).sum(axis=(1, 3))
            found.append(np.where(np.arange(per_line.shape[1]) < lines[at : at + n, None], per_line, 0.0).sum(axis=1))
        names = table.select(keys).take(pa.array(first)).combine_chunks()
        columns = [names.column(k).combine_chunks() for k in keys]
        columns += [pa.array(np.concatenate(found)), pa.array((lines * starts * len(bands)).astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_number").to_numpy() == 1)
            if len(starts):
                done = pa.Table.from_batches([*held, batch.slice(0, starts[-1])], batch.schema)
                if done.num_rows:
                    yield scored(done)
                held = [batch.slice(starts[-1])]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield scored(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def ssim(cells: DataFrame, keys: list[str], bands: list[str], patch: int, data_range: float = 1.0) -> DataFrame:
    """Structural similarity per sample: 7 by 7 uniform windows, interior mean, mask ignored.

    ``keys`` include y_coord and x_coord. Window sums per block of rows are added up per sample; a window without any cell
    is two equal pictures, so blocks without cells count 1 per window.
    """
    _check(patch)
    windows = F.lit(float(len(bands) * (patch - SSIM_WINDOW + 1) ** 2))
    sums = _window_sums(cells, keys, bands, patch, data_range).groupBy(*keys)
    sums = sums.agg(F.sum("_sum").alias("_sum"), F.sum("_windows").alias("_windows"))
    return sums.select(*keys, ((F.col("_sum") + windows - F.col("_windows")) / windows).alias("ssim"))


def ssim_windows(
    cells: DataFrame, keys: list[str], bands: list[str], patch: int, data_range: float = 1.0
) -> DataFrame:
    """The same score from built-in window sums, for dense cells.

    Rows first, then columns; one exchange by sample serves both passes. Needs
    every cell of the patch present, since a window is centred on a row.
    """
    half = SSIM_WINDOW // 2
    n = SSIM_WINDOW * SSIM_WINDOW
    c1, c2 = (SSIM_K1 * data_range) ** 2, (SSIM_K2 * data_range) ** 2
    moments = {}
    for b in bands:
        p, t = F.col(f"pred_{b}"), F.col(f"target_{b}")
        moments |= {f"p_{b}": p, f"t_{b}": t, f"pp_{b}": p * p, f"tt_{b}": t * t, f"pt_{b}": p * t}
    placed = cells.select(*keys, "y", "x", *[v.alias(k) for k, v in moments.items()]).repartition(*keys)
    along = W.partitionBy(*keys, "y").orderBy("x").rangeBetween(-half, half)
    down = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-half, half)
    sums = placed.select(*keys, "y", "x", *[F.sum(m).over(along).alias(m) for m in moments])
    sums = sums.select(*keys, "y", "x", *[(F.sum(m).over(down) / n).alias(m) for m in moments])
    ly, lx = F.col("y") - F.col("y_coord"), F.col("x") - F.col("x_coord")
    inner = sums.filter(ly.between(half, patch - 1 - half) & lx.between(half, patch - 1 - half))
    unbias = n / (n - 1.0)

    def value(b: str) -> Column:
        mp, mt = F.col(f"p_{b}"), F.col(f"t_{b}")
        vp = unbias * (F.col(f"pp_{b}") - mp * mp)
        vt = unbias * (F.col(f"tt_{b}") - mt * mt)
        cov = unbias * (F.col(f"pt_{b}") - mp * mt)
        return ((2 * mp * mt + c1) * (2 * cov + c2)) / ((mp * mp + mt * mt + c1) * (vp + vt + c2))

    mean = F.avg(add([value(b) for b in bands]) / len(bands))
    return inner.groupBy(*keys).agg(mean.alias("ssim"))


def score(cells: DataFrame, keys: list[str], bands: list[str], patch: int, data_range: float = 1.0) -> DataFrame:
    """All four scores per sample: three from partial sums, the similarity from blocks of rows.

    ``cells`` is read once for each, so it should be cheap to make or written. One small row per sample is joined.
    """
    _check(patch)
    sums = pixel_scores(cells, keys, bands, data_range)
    found = sums.join(ssim(cells, keys, bands, patch, data_range), keys)
    return found.select(*keys, "rmse", "psnr", "ssim", "sam")


def masked_loss(
    cells: DataFrame, bands: list[str], loss: str = "mse", by: list[str] = (),
    denominator: str = "values",
) -> DataFrame:
    """Loss over valid values divided by their number, or by the number of valid cells.

    ``denominator='pixels'`` is the reading for a mask without a band axis: the
    sum over all bands of cells valid by the ``valid`` column over their count.
    Without a valid value the loss is 0.
    """
    if loss not in ("mse", "l1"):
        raise ValueError(f"unknown loss {loss}")
    if denominator not in ("values", "pixels"):
        raise ValueError("denominator must be 'values' or 'pixels'")

    def error(b: str) -> Column:
        return _square(b) if loss == "mse" else F.abs(F.col(f"pred_{b}") - F.col(f"target_{b}"))

    def ok(b: str) -> Column:
        return F.col(f"valid_{b}") if denominator == "values" else F.col("valid")

    total = add([F.sum(F.when(ok(b), error(b)).otherwise(0.0)) for b in bands])
    n = (
        add([F.count_if(ok(b)) for b in bands])
        if denominator == "values"
        else F.count_if("valid")
    )
    return cells.groupBy(*by).agg(F.when(n > 0, F.try_divide(total, n)).otherwise(total).alias("loss"))

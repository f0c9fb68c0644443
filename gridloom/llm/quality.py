"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes log-count ratios.

A text becomes a set of hashed indicators: its words, its pairs of words, and the n-grams of its word shapes. A shape
tells case, digits, marks at the word's end, length class, and whether the word repeats the one or two before it, so that
kinds of junk are known by form and not by their vocabulary. Indicators are scaled by the log ratio of their
smoothed shares in the two classes; a linear hinge-loss model is fitted on them by dual coordinate descent,
and its margin becomes a probability by a logistic fit on the same rows' held-back part.

The model is fitted on a bounded sample of labelled rows: at most ``limit`` of each class, chosen by a hash of the
id. Every text is scored whole. Labels, language, source and id are no inputs of a score.

Defined results: NULL and empty texts have no indicators and get the score of the intercept. Labels that are NULL are
ignored, several labels of one document count as their mean; rows that repeat a ``doc_id`` are scored one by one, a NULL
``doc_id`` is scored and never a training row. Without labels of both classes every score is the share of label 1 (0.5
without any). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.columns import LETTER, coded, flat, give_back, hashed, mixed, pieces, rows_of, spans

BITS = 18
PIECE = 1_200_000  # bytes of text at a time; an indicator takes some tens of bytes on the way
UPPER, LOWER, DIGIT = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True


@dataclass
class Model:
    """Weights per indicator (already scaled), intercept, and the logistic fit of the margin."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(rows, weights=self.weights[features], minlength=n) if len(rows) else np.zeros(n)
        count = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n)
        margin = total / np.sqrt(np.maximum(count, 1)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A small number per word for its form."""
    if not len(starts):
        return np.zeros(0, np.int64)

    def count(kind: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        return upto[ends] - upto[starts]

    length = ends - starts
    upper, lower, digit = count(UPPER), count(LOWER), count(DIGIT)
    wide = count(np.arange(256) >= 0x80)
    marks = length - upper - lower - digit - wide
    first, last = data[starts].astype(np.int64), data[ends - 1].astype(np.int64)
    last = np.where(LETTER[last] | DIGIT[last] | (last >= 0x80), 0, last)
    case = np.where(upper == 0, 0, np.where((upper == 1) & UPPER[first], 1, np.where(lower == 0, 2, 3)))
    size = np.searchsorted([2, 4, 8, 16, 32], length)
    out = (((case * 6 + size) * 3 + np.minimum(digit, 2)) * 4 + np.minimum(marks, 3)) * 128 + last
    for back in (1, 2):
        same = np.zeros(len(codes), bool)
        same[back:] = (codes[back:] == codes[:-back]) & (rows[back:] == rows[:-back])
        out = out * 2 + same
    return out


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of the distinct indicators of each text, ordered by both."""
    data, offsets = flat(column)
    starts, ends = spans(data, offsets)
    rows = rows_of(starts, offsets)
    codes, distinct = coded(data, starts, ends)
    word = hashed(distinct)[codes]
    shape = shapes(data, starts, ends, codes, rows).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        for kind, (values, sizes) in enumerate(((word, (1, 2)), (shape, (1, 2, 3)))):
            for size in sizes:
                total = len(values) - size + 1
                if total <= 0:
                    continue
                key = np.full(total, np.uint64(16 * kind + size))
                for k in range(size):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[k : total + k])
                whole = rows[:total] == rows[size - 1 :]
                found.append(rows[:total][whole] << BITS | (key[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def descend(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, c: np.ndarray, dims: int, passes: int = 12):
    """Dual coordinate descent for the linear hinge loss; the last of ``dims`` weights is the intercept."""
    return descend_rows(lambda i: (index[indptr[i] : indptr[i + 1]], value[indptr[i] : indptr[i + 1]]), y, c, dims, passes)


def descend_rows(row: Callable[[int], tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: np.ndarray, dims: int, passes: int = 12):
    """The same for rows whose places and values are made when they are asked for."""
    w, alpha = np.zeros(dims), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, x = row(i)
            gradient = y[i] * (w[at] @ x) - 1
            new = min(max(alpha[i] - gradient / max(float(x @ x), 1e-12), 0.0), c[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * x
                alpha[i] = new
                moved = max(moved, abs(step) / c[i])
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by damped Newton steps on smoothed targets."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, theta = np.stack((margin, np.ones(len(margin)))), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        theta = theta - 0.7 * np.linalg.solve(hessian, (x * (weight * (p - target))).sum(axis=1))
    return float(max(theta[0], 0.1)), float(theta[1])


def fit(ends: np.ndarray, features: np.ndarray, labels: np.ndarray, smoothing: float = 1.0, cost: float = 0.1) -> Model:
    """Fits a model on the indicators of texts, row after row up to each of ``ends``, and their 0/1 labels.

    Beside the indicators themselves only arrays of one number per row, per weight or per block of rows are made.
    """
    good = labels >= 0.5
    n, dims = len(labels), (1 << BITS) + 1
    if not n or good.all() or not good.any():
        share = min(max(good.mean() if n else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(dims - 1), 0.0, 1.0, float(np.log(share / (1 - share))))
    # a hash-like split: every fourth row is held back for the logistic fit
    held = np.arange(n) % 4 == 3
    if len(set(good[held])) < 2 or len(set(good[~held])) < 2:
        held = np.zeros(n, bool)
    fitted = ~held
    begin = np.concatenate(([0], ends[:-1]))
    counts = ends - begin

    def row(i: int) -> np.ndarray:
        return features[begin[i] : ends[i]]

    def share(chosen: np.ndarray) -> np.ndarray:
        found = np.zeros(dims - 1, np.int64)
        for i in np.flatnonzero(chosen):
            found[row(i)] += 1  # a row's indicators are distinct
        return found + smoothing

    up, down = share(good & fitted), share(~good & fitted)
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    root = np.sqrt(np.maximum(counts, 1))

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        # one constant indicator per row carries the intercept
        return np.append(row(i), dims - 1), np.append(ratio[row(i)] / root[i], 1.0)

    y = np.where(good, 1.0, -1.0)
    take = np.flatnonzero(fitted)
    balance = np.where(y > 0, n / (2 * good.sum()), n / (2 * (~good).sum()))
    w = descend_rows(lambda i: scaled(take[i]), y[take], cost * balance[take], dims)
    weights = w[:-1] * ratio
    margin = np.array([weights[row(i)].sum() for i in range(n)]) / root + w[-1]
    used = held if held.any() else fitted
    slope, shift = logistic(margin[used], y[used], balance[used])
    return Model(weights, float(w[-1]), slope, shift)


def held_out(doc_id: Column | str) -> Column:
    """Rows whose labels are never used: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = 2000) -> Model:
    """A model from at most ``limit`` labelled rows of each class. Runs small jobs when called: bounded sample, class counts."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    )
    chosen = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit) for q in (0.0, 1.0)
    ]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * limit ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows, features = indicators(batch.column("text"))
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(batch)))))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), listed], names=["doc_id", "quality", "features"]
            )

    # what reaches the driver is bounded: 2 * limit rows of at most 2 ** BITS indicators
    table = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id")
        .groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
        .mapInArrow(run, "doc_id bigint, quality double, features array<int>")
        .toArrow().sort_by("doc_id").combine_chunks()
    )
    listed = pa.chunked_array(table["features"].chunks, pa.list_(pa.int32())).combine_chunks()
    model = fit(listed.offsets.to_numpy()[1:].astype(np.int64), listed.values.to_numpy(), table["quality"].to_numpy())
    del table, listed
    give_back()
    # the fit weighs both classes alike; the score speaks for the classes as they occur
    totals = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    if len(totals) == 2:
        model.shift += float(np.log(totals[1.0] / totals[0.0]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows, features = indicators(batch.column("text"))
            found = model.scores(rows, features, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = 2000) -> DataFrame:
    """Trains on the labelled rows that are not held out and scores every row."""
    return score(docs, train(docs, labels, limit), threshold)


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; no row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            rows, features = indicators(batch.column("text"))
            yield batch.filter(pa.array(model.scores(rows, features, len(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)

"""Joins that may broadcast, after a look at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be sent to every executor: some tens of MB there.
MOST_KEYS = 1_000_000


def small(frame: DataFrame) -> DataFrame:
    """A written table, to be sent to every executor if it has at most ``MOST_KEYS`` rows."""
    return F.broadcast(frame) if frame.count() <= MOST_KEYS else frame


def only(frame: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``frame`` whose ``column`` is one of the distinct ``keys``.

    The keys are counted first; up to ``MOST_KEYS`` of them are sent to the rows, which then need no exchange, more are joined.
    ``keys`` should be cheap to make twice, or written.
    """
    few = keys.count() <= MOST_KEYS
    return frame.join(F.broadcast(keys) if few else keys, column, "left_semi")

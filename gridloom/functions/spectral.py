"""Spectral expressions: NDVI, normalisation, angle, PSNR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.config import PHYSICAL_MAX, PHYSICAL_MIN


def ndvi(red: Column, nir: Column) -> Column:
    """NULL for a missing band and for a zero denominator."""
    return F.try_divide(nir - red, nir + red)


def ndvi_unbounded(red: Column, nir: Column) -> Column:
    """True where the ratio would be infinite: zero denominator, non-zero numerator."""
    return (nir + red == 0) & (nir - red != 0)


def normalise(v: Column) -> Column:
    return (v - F.lit(PHYSICAL_MIN)) / F.lit(PHYSICAL_MAX - PHYSICAL_MIN)


def sanitise(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(0.0))))


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def spectral_angle(pred: list[Column], target: list[Column]) -> Column:
    dot = add([p * t for p, t in zip(pred, target)])
    norm_p = F.sqrt(add([p * p for p in pred]))
    norm_t = F.sqrt(add([t * t for t in target]))
    cosine = dot / (norm_p * norm_t + F.lit(1e-8))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def quantile(ordered: Column, share: float) -> Column:
    """Linearly interpolated quantile of a sorted array without NULLs; NULL for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(share)
    below = F.floor(at).cast("int")
    low = F.get(ordered, below)
    return low + (F.coalesce(F.get(ordered, below + 1), low) - low) * (at - below)


def psnr_from_rmse(rmse: Column, data_range: float = 1.0) -> Column:
    """Infinite for a perfect match; NULL stays NULL."""
    return F.when(rmse > 0, F.lit(20.0) * F.log10(F.lit(data_range) / rmse)).when(
        rmse == 0, F.lit(float("inf"))
    )


def safe_div(num: Column, den: Column, default=None) -> Column:
    """Ratio, or ``default`` (None keeps NULL) for a zero or missing divisor or numerator."""
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))

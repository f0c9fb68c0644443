"""Sine/cosine position, date and location encodings as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _require(ok: bool, message: str):
    if not ok:
        raise ValueError(message)


def sincos(pos: Column, dim: int) -> Column:
    """``dim`` values: the sine half followed by the cosine half."""
    _require(dim > 0 and dim % 2 == 0, "dim must be a positive even number")
    half = dim // 2
    # dim is a small literal, so the frequencies are plan constants
    omega = F.array(*[F.lit(1.0 / 10000 ** (i / half)) for i in range(half)])
    p = pos.cast("double")
    return F.concat(
        F.transform(omega, lambda w: F.sin(p * w)), F.transform(omega, lambda w: F.cos(p * w))
    )


def sincos_3d(t: Column, h: Column, w: Column, dim: int) -> Column:
    """Six sixteenths for the column, six for the row, four for the frame."""
    _require(dim > 0 and dim % 16 == 0, "dim must be a positive multiple of 16")
    unit = dim // 16
    return F.concat(sincos(w, 6 * unit), sincos(h, 6 * unit), sincos(t, 4 * unit))


def _halves(first: Column, second: Column, dim: int, scale: float) -> Column:
    left = dim // 2
    both = F.concat(sincos(first, left), sincos(second, dim - left))
    return both if scale == 1.0 else F.transform(both, lambda v: v * F.lit(scale))


def date_encoding(date: Column, dim: int, scale: float = 1.0) -> Column:
    return _halves(F.year(date), F.dayofyear(date), dim, scale)


def location_encoding(lat: Column, lon: Column, dim: int, scale: float = 1.0) -> Column:
    return _halves(lat, lon, dim, scale)

"""Bit fields of the quality words, usability codes, and band cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.config import CubeConfig


def _bits(word: Column, offset: int, width: int) -> Column:
    return F.shiftright(word, offset).bitwiseAND(F.lit((1 << width) - 1))


def band_quality(qc: Column, band: int) -> Column:
    """Four quality bits of one band; the word's first two bits are not per band."""
    return _bits(qc, 2 + 4 * (band - 1), 4)


def band_good(qc: Column, band: int) -> Column:
    return band_quality(qc, band) == 0


def state_fields(state: Column) -> dict[str, Column]:
    return {
        "cloud": _bits(state, 0, 2),
        "shadow": _bits(state, 2, 1),
        "aerosol": _bits(state, 6, 2),
        "cirrus": _bits(state, 8, 2),
        "adjacent": _bits(state, 13, 1),
    }


def usability(state: Column, fill: int = 65535, mask_fill: int = 255) -> Column:
    """Usability code of a state word, worst condition first; cloud state 3 is clear. ``mask_fill`` stands for the fill word."""
    f = state_fields(state)
    return (
        F.when(state == fill, mask_fill)
        .when(f["cloud"].isin(1, 2), 4)
        .when((f["adjacent"] == 1) | (f["cirrus"] != 0), 3)
        .when(f["aerosol"] == 3, 2)
        .when(f["shadow"] == 1, 1)
        .when(state.isNotNull(), 0)
        .cast("smallint")
    )


def scaled(raw: Column, c: CubeConfig) -> Column:
    return raw.cast("double") * F.lit(float(c.scale_factor))


def in_range(raw: Column, c: CubeConfig) -> Column:
    tested = scaled(raw, c) if c.range_on == "scaled" else raw
    return tested.between(*c.valid_range)


def clean_band(raw: Column, qc: Column, band: int, c: CubeConfig) -> Column:
    """Scaled reflectance, NULL where out of range, flagged by the QC word, or a fill word the parameters name."""
    kept = in_range(raw, c) & band_good(qc, band)
    if c.reflectance_fill is not None:
        kept = kept & (raw != c.reflectance_fill)
    if c.qc_fill is not None:
        kept = kept & (qc != c.qc_fill)
    return F.when(kept, scaled(raw, c))

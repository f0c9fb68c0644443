"""Sinusoidal grid geometry as column math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public sinusoidal grid: sphere radius, tile edge in
# metres, and the upper-left corner of tile h00v00.
SPHERE_RADIUS = 6371007.181
TILE_METRES = 1111950.5196666666
ORIGIN_X = -20015109.354
ORIGIN_Y = 10007554.677


def tile_h(tile: Column) -> Column:
    return F.substring(tile, 2, 2).cast("int")


def tile_v(tile: Column) -> Column:
    return F.substring(tile, 5, 2).cast("int")


def cell_x_metres(tile: Column, col: Column, cols: int = 2400) -> Column:
    return F.lit(ORIGIN_X) + (tile_h(tile) + (col + 0.5) / cols) * F.lit(TILE_METRES)


def cell_y_metres(tile: Column, row: Column, rows: int = 2400) -> Column:
    return F.lit(ORIGIN_Y) - (tile_v(tile) + (row + 0.5) / rows) * F.lit(TILE_METRES)


def inverse_lat(y: Column) -> Column:
    return F.degrees(y / F.lit(SPHERE_RADIUS))


def inverse_lon(x: Column, y: Column) -> Column:
    return F.degrees(x / (F.lit(SPHERE_RADIUS) * F.cos(y / F.lit(SPHERE_RADIUS))))

"""Space-filling-curve cell codes of points, as native column expressions.

A point is scaled to a ``BITS`` by ``BITS`` grid over the globe and its two grid
coordinates are interleaved (Z-order), so that every square of side ``2**k``
grid steps that is aligned to a multiple of its side is one range of codes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of either grid coordinate; the code has twice as many.
BITS = 28
#: Radius in metres of the sphere on which distances are taken.
EARTH_M = 6_371_000.0
#: Mask and shift of each step that spreads 32 bits to every second bit of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def valid(lat: Column, lng: Column) -> Column:
    """Whether a position is one: not null, not NaN, within the globe's range."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0), F.lit(False))


def grid_x(lng: Column) -> Column:
    """The column of the grid, 0 to ``2**BITS - 1``."""
    top = float(2**BITS)
    return F.least(F.floor((lng + 180.0) / 360.0 * top), F.lit(2**BITS - 1)).cast("long")


def grid_y(lat: Column) -> Column:
    """The row of the grid, 0 to ``2**BITS - 1``; beyond a pole, the last one."""
    top = float(2**BITS)
    return F.greatest(F.lit(0), F.least(F.floor((lat + 90.0) / 180.0 * top), F.lit(2**BITS - 1))).cast("long")


def spread(x: Column) -> Column:
    """Each bit of ``x`` moved to twice its place."""
    for by, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def interleave(x: Column, y: Column) -> Column:
    """The Z-order code of a grid cell."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h)))


def level_for(radius_m: float) -> int:
    """The number of low grid bits inside one covering cell: the smallest cell at least twice as high as ``radius_m``,
    so a disc touches two rows of cells at most."""
    step = math.pi * EARTH_M / 2**BITS
    return min(BITS, max(0, math.ceil(math.log2(max(2 * radius_m / step, 1.0)))))

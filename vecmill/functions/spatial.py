"""Morton code of coordinates, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spread(x: Column) -> Column:
    """Bit i of 24 goes to bit 2i."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(lat: Column, lon: Column) -> Column:
    """48 bits: longitude in even bits, latitude in odd ones; both are clamped to their ranges."""
    top = float((1 << 24) - 1)
    part = lambda v, low, span: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / span)) * top).cast("long")
    return _spread(part(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(part(lat, -90.0, 180.0)), 1))

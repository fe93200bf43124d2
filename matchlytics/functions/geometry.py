"""Coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(x: Column) -> Column:
    """Whole part, toward zero."""
    return x.cast("int")


def center_x(x1="x1", x2="x2") -> Column:
    return (F.col(x1) + F.col(x2)) / 2


def center_y(y1="y1", y2="y2") -> Column:
    return (F.col(y1) + F.col(y2)) / 2


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def project(h: Column, x: Column, y: Column) -> Column:
    """struct<px,py> of the 3x3 row-major projective map `h`; null without map or at infinity."""
    row = [h[3 * r] * x + h[3 * r + 1] * y + h[3 * r + 2] for r in range(3)]
    ok = h.isNotNull() & (F.abs(row[2]) >= F.lit(1e-9))
    return F.when(ok, F.struct((row[0] / row[2]).alias("px"), (row[1] / row[2]).alias("py")))

"""Hilbert index of order 16 as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 16
#: Cells of the grid over a layer's extent.
CELLS = 65534


def cell(v: Column, low: Column, high: Column) -> Column:
    """The grid cell of a centre, halves up; 0 in an extent without size."""
    return F.when(high > low, F.floor((v - low) / (high - low) * CELLS + 0.5)).otherwise(0).cast("int")


def index(x: Column, y: Column) -> Column:
    """Distance along the curve, bit by bit from the highest: each quadrant adds its part and turns what is left."""

    def step(acc: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1), k)
        rx = F.when(acc["x"].bitwiseAND(side) > 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(side) > 0, 1).otherwise(0)
        d = acc["d"] + F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * k) * ((3 * rx).bitwiseXOR(ry)).cast("bigint")
        top = F.lit((1 << ORDER) - 1)
        nx, ny = F.when((ry == 0) & (rx == 1), top - acc["x"]).otherwise(acc["x"]), F.when((ry == 0) & (rx == 1), top - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, ny).otherwise(nx).cast("int").alias("x"), F.when(ry == 0, nx).otherwise(ny).cast("int").alias("y"), d.alias("d"))

    start = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(0).cast("bigint").alias("d"))
    return F.aggregate(F.sequence(F.lit(ORDER - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"])

"""Multidimensional arrays as long tables: index columns i0, i1, ... and v."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """A dimension; labels start, start + step, ... (without a step: the index)."""

    name: str
    size: int
    start: float = 0.0
    step: float = 1.0

    def label(self, index):  # noqa: ANN001, ANN201
        return index * self.step + self.start


def stats(df: DataFrame) -> DataFrame:
    return df.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.count("v").alias("valid_count"))


def subset(df: DataFrame, dims: list[Dimension], spec: str) -> tuple[DataFrame, list[Dimension]]:
    """`D(lo,hi)` keeps labels in a range (indexes start again from 0); `D(v)` keeps one label and drops the dimension."""
    name, body = re.fullmatch(r"\s*([^()]+)\(([^()]*)\)\s*", spec).groups()
    k = next(i for i, d in enumerate(dims) if d.name == name)
    d, own = dims[k], [float(x) for x in body.split(",")]
    if len(own) == 1:
        at = round((own[0] - d.start) / d.step)
        out = df.filter(F.col(f"i{k}") == at).drop(f"i{k}")
        for j in range(k + 1, len(dims)):
            out = out.withColumnRenamed(f"i{j}", f"i{j - 1}")
        return out, dims[:k] + dims[k + 1 :]
    a, b = sorted((x - d.start) / d.step for x in own)
    first, last = max(0, math.ceil(a - 1e-9)), min(d.size - 1, math.floor(b + 1e-9))
    out = df.filter(F.col(f"i{k}").between(first, last)).withColumn(f"i{k}", F.col(f"i{k}") - first)
    return out, [*dims[:k], Dimension(d.name, max(0, last - first + 1), d.label(first), d.step), *dims[k + 1 :]]


def decimate(df: DataFrame, dims: list[Dimension], name: str, factor: int) -> tuple[DataFrame, list[Dimension]]:
    """Every factor-th index of a dimension."""
    k = next(i for i, d in enumerate(dims) if d.name == name)
    d = dims[k]
    out = df.filter(F.col(f"i{k}") % factor == 0).withColumn(f"i{k}", F.expr(f"i{k} div {factor}"))
    return out, [*dims[:k], Dimension(d.name, -(-d.size // factor), d.start, d.step * factor), *dims[k + 1 :]]


def transpose(df: DataFrame, order: list[int]) -> DataFrame:
    return df.select(*[F.col(f"i{old}").alias(f"i{new}") for new, old in enumerate(order)], "v")


def mosaic(arrays: list[tuple[DataFrame, Dimension]], axis: int = 0) -> tuple[DataFrame, Dimension]:
    """Union along a dimension with regular labels: spacing must agree; where arrays overlap, the later one wins."""
    step = arrays[0][1].step
    if any(abs(d.step - step) > 1e-9 * abs(step) for _, d in arrays):
        raise ValueError("the arrays' spacings differ")
    start = min(d.start for _, d in arrays) if step > 0 else max(d.start for _, d in arrays)
    parts, end = [], 0
    for seq, (df, d) in enumerate(arrays):
        offset = math.floor((d.start - start) / step + 0.5)
        end = max(end, offset + d.size)
        parts.append(df.withColumn(f"i{axis}", (F.col(f"i{axis}") + offset).cast(df.schema[f"i{axis}"].dataType)).withColumn("__seq", F.lit(seq)))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    keys = [c for c in arrays[0][0].columns if c != "v"]
    return union.groupBy(*keys).agg(F.max_by("v", "__seq").alias("v")), Dimension(arrays[0][1].name, end, start, step)


def to_raster(df: DataFrame) -> DataFrame:
    """A two-dimensional array as cells."""
    return df.select(F.lit(1).alias("band"), F.col("i0").cast("int").alias("row"), F.col("i1").cast("int").alias("col"), "v")

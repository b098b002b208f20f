"""Layer algebra over polygon layers whose method layer is convex: candidate pairs by grid cells, then exact clipping.

Features are dealt to the cells of a grid that their envelopes touch and meet by an equality join; a pair that shares
several cells is kept once. Nothing is paired that doesn't share a cell. Features of the same shape go as one until their
common part is known.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g


def candidates(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """fid_a, fid_b of features whose envelopes meet. a, b: fid, env."""

    def dealt(df: DataFrame, name: str) -> DataFrame:
        span = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"env.{low}") / cell), F.floor(F.col(f"env.{high}") / cell)))
        return df.filter("env is not null").select(F.col("fid").alias(f"fid_{name}"), F.col("env").alias(name), span("xmin", "xmax").alias("cx")).withColumn("env", F.col(name)).withColumn("cy", span("ymin", "ymax")).drop("env")

    met = dealt(a, "a").join(dealt(b, "b"), ["cx", "cy"])
    return met.filter("a.xmin <= b.xmax and a.xmax >= b.xmin and a.ymin <= b.ymax and a.ymax >= b.ymin").select("fid_a", "fid_b").distinct()


def clip_convex(ring: list, window: list) -> list:
    """A ring within a convex ring, by the half-planes of its sides."""
    side = 1.0 if g._ring_area(window) >= 0 else -1.0
    pts = [p[:2] for p in (ring[:-1] if ring[0] == ring[-1] else ring)]
    closed = window if window[0] == window[-1] else [*window, window[0]]
    for p, q in zip(closed, closed[1:], strict=False):
        d = lambda x, p=p, q=q: side * ((q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0]))
        out = []
        for k, x in enumerate(pts):
            y = pts[k - 1]
            if (d(x) >= 0) != (d(y) >= 0):
                t = d(y) / (d(y) - d(x))
                out.append([y[0] + t * (x[0] - y[0]), y[1] + t * (x[1] - y[1])])
            if d(x) >= 0:
                out.append(x)
        pts = out
    return [*pts, pts[0]] if len(pts) > 2 else []


def _meet(a: bytes, b: bytes) -> bytes | None:
    (ka, ca), (kb, cb) = g.from_wkb(a), g.from_wkb(b)
    if ka != 3 or kb != 3 or len(cb) != 1:
        raise ValueError("overlays take polygons; those of the method layer are convex, without holes")
    rings = [r for r in (clip_convex(r, cb[0]) for r in ca) if r]
    return g.to_wkb((3, rings)) if rings and g.area((3, rings)) > 0 else None


def _alike(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A feature for each shape (fid, the least; geom, env), and the features by it (fid, rep)."""
    placed = df.filter("env is not null")
    one = placed.groupBy("geom", "env").agg(F.min("fid").alias("fid"))
    return one, placed.select("fid", "geom", "env").join(one.withColumnRenamed("fid", "rep"), ["geom", "env"]).select("fid", "rep")


def _common(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """fid_a, fid_b, geom of the parts that both layers cover, feature by feature."""

    @F.pandas_udf("binary")
    def meet(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_meet(bytes(p), bytes(q)) for p, q in zip(x, y, strict=True)], dtype="object")

    pairs = candidates(a, b, cell)
    shapes = pairs.join(a.select(F.col("fid").alias("fid_a"), F.col("geom").alias("ga")), "fid_a").join(b.select(F.col("fid").alias("fid_b"), F.col("geom").alias("gb")), "fid_b")
    return shapes.select("fid_a", "fid_b", meet("ga", "gb").alias("geom")).filter("geom is not null")


def intersection(a: DataFrame, b: DataFrame, cell: float, columns: dict[str, Column] | None = None) -> DataFrame:
    """fid_a, fid_b, geom of the parts that both layers cover, a row for each pair of features. a, b: fid, geom, env.

    columns: further ones from geom; they and geom are worked out once for all pairs of the same two shapes.
    """
    (one_a, all_a), (one_b, all_b) = _alike(a), _alike(b)
    met = _common(one_a, one_b, cell).withColumns(columns or {}).withColumnsRenamed({"fid_a": "rep_a", "fid_b": "rep_b"})
    own_a, own_b = (df.withColumnsRenamed({"fid": f"fid_{n}", "rep": f"rep_{n}"}) for n, df in (("a", all_a), ("b", all_b)))
    # The second join multiplies most: its rows are dealt out by feature, not by shape.
    return met.join(own_a, "rep_a").repartition("fid_a").join(own_b, "rep_b").select("fid_a", "fid_b", "geom", *(columns or {}))


def disjoint(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Features of a that no feature of b overlaps."""
    (one_a, all_a), (one_b, _) = _alike(a), _alike(b)
    hit = _common(one_a, one_b, cell).select(F.col("fid_a").alias("rep")).distinct()
    return a.join(all_a.join(hit, "rep").select("fid"), "fid", "left_anti")

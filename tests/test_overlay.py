"""Overlays of layers with many features of the same shape."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators import overlay
from geoloom.operators.geometry import area, make_rectangle


def areas():
    return {"area": F.round(area(F.col("geom")), 6)}


def rectangles(spark, rows):
    df = spark.createDataFrame(rows, "fid long, x double, y double, w double")
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    return make_rectangle(df, x, y, x + w, y + w).select("fid", "geom", "env")


def brute(a, b):
    out = []
    for f, x, y, w in a:
        for k, p, q, v in b:
            s, t = min(x + w, p + v) - max(x, p), min(y + w, q + v) - max(y, q)
            if s > 0 and t > 0:
                out.append((f, k, round(s * t, 6)))
    return sorted(out)


def test_pairs_of_two_layers_with_copies(spark):
    """Every pair of features has its row, copies within and between the layers included; touching ones have none."""
    a = [(k, float(k % 4 * 2), float(k % 3), 2.0 + k % 2) for k in range(40)]
    b = [(100 + k, float(k % 5), float(k % 2 * 3), 2.0) for k in range(30)] + [(200, 50.0, 50.0, 1.0)]
    z, y = rectangles(spark, a), rectangles(spark, b)
    got = overlay.intersection(z, y, 3.0, areas()).collect()
    assert sorted((r["fid_a"], r["fid_b"], r["area"]) for r in got) == brute(a, b)
    assert all(round(g.area(g.from_wkb(bytes(r["geom"]))), 6) == r["area"] for r in got)
    assert overlay.intersection(z, y, 3.0).columns == ["fid_a", "fid_b", "geom"]
    empty = spark.createDataFrame([(300, None, None)], "fid long, geom binary, env struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    assert {r["fid"] for r in overlay.disjoint(y.union(empty), z, 3.0).collect()} == {200, 300} | {f[0] for f in b} - {r["fid_b"] for r in got}


def test_common_parts_are_worked_out_by_shape(spark):
    """3,000 features of two shapes are 9 million pairs, each of which went through Python."""
    z = spark.range(3000).select(F.col("id").alias("fid"), (F.col("id") % 2).cast("double").alias("x"))
    z = make_rectangle(z, F.col("x"), F.lit(0.0), F.col("x") + 3, F.lit(3.0)).select("fid", "geom", "env")
    began = time.time()
    got = overlay.intersection(z, z, 8.0, areas()).agg(F.count("*"), F.sum("area"), F.sum("fid_a")).first()
    assert tuple(got) == (9_000_000, 4_500_000 * 9.0 + 4_500_000 * 6.0, 3000 * sum(range(3000)))
    assert time.time() - began < 30

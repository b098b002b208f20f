"""Mean distance of all pairs of a node's points, with copies, many places and limits."""

from __future__ import annotations

import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import grid

FIELDS = "fid long, x double, y double, z double"


def brute(rows, node, radius, keep=None):
    near = sorted((math.hypot(x - node[0], y - node[1]), f, x, y) for f, x, y, _ in rows if math.hypot(x - node[0], y - node[1]) <= radius)[:keep]
    d = [math.hypot(a[2] - b[2], a[3] - b[3]) for a, b in combinations(near, 2)]
    return sum(d) / len(d) if d else -1.0


@pytest.mark.parametrize("keep", [None, 5])
def test_against_brute_force(spark, keep):
    """900 places in more blocks than one, a third of them with copies; far nodes have one point or none."""
    at = np.random.default_rng(3)
    rows = [(k, float(x), float(y), 1.0) for k, (x, y) in enumerate(at.uniform(0, 10, (900, 2)))]
    rows += [(1000 + k, *rows[k][1:]) for k in range(300)] + [(2000, 25.0, 5.0, 1.0), (2001, None, 5.0, 1.0)]
    nodes = grid.nodes(spark, 4, 1, 0.0, 0.0, 10.0, 10.0)
    got = {r["i"]: r["v"] for r in grid.grid(nodes, spark.createDataFrame(rows, FIELDS), "average_distance_points", 6.0, nodata=-1.0, max_points=keep).collect()}
    placed = [r for r in rows if r[1] is not None]
    assert got == {i: pytest.approx(brute(placed, (i * 10 + 5.0, 5.0), 6.0, keep), rel=1e-12) for i in range(4)}


def test_copies_go_as_one(spark):
    """200,000 points of four places around one node, which were 40 billion pairs."""
    corner = F.col("id") % 4
    points = spark.range(200_000).select(F.col("id").alias("fid"), (corner % 2 * 3).cast("double").alias("x"), (F.floor(corner / 2) * 4).cast("double").alias("y"), F.lit(0.0).alias("z"))
    began = time.time()
    v = grid.grid(grid.nodes(spark, 1, 1, 0.0, 0.0, 3.0, 4.0), points, "average_distance_points", 12.0).first()["v"]
    n = 200_000
    assert v == pytest.approx(4 * (n / 4) ** 2 * (3 + 4 + 5) / (n * (n - 1)), rel=1e-12)
    assert time.time() - began < 60

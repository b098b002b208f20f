"""Interpolation of scattered points (fid, x, y, z) to nodes (i, j, cx, cy).

Points within an ellipse of a node count. Points and nodes are dealt to buckets of the radius' size, a point to the
buckets around its own, so they meet by an equality join; nothing is paired beyond neighbouring buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(spark, width: int, height: int, x0: float, y0: float, dx: float, dy: float) -> DataFrame:  # noqa: ANN001
    cell = spark.range(width * height).select((F.col("id") % width).cast("int").alias("i"), (F.col("id") / width).cast("int").alias("j"))
    return cell.withColumns({"cx": x0 + (F.col("i") + 0.5) * dx, "cy": y0 + (F.col("j") + 0.5) * dy})


def near(grid: DataFrame, points: DataFrame, r1: float, r2: float | None = None, angle: float = 0.0, also: tuple[str, ...] = ()) -> DataFrame:
    """i, j, fid, z, dx, dy, d2 of every point within the (turned) ellipse of a node; also: further fields of the points."""
    r2 = r2 or r1
    size = max(r1, r2)
    bucket = lambda c: F.floor(c / size).cast("int")
    around = F.explode(F.array(*[F.struct((bucket(F.col("x")) + a).alias("bx"), (bucket(F.col("y")) + b).alias("by")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    sent = points.select("fid", "x", "y", "z", *also, around.alias("b")).select("fid", "x", "y", "z", *also, "b.*")
    own = grid.withColumns({"bx": bucket(F.col("cx")), "by": bucket(F.col("cy"))})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    if angle:
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        dx, dy = dx * c + dy * s, dy * c - dx * s
    out = own.join(sent, ["bx", "by"]).select("i", "j", "fid", "x", "y", "z", *also, dx.alias("dx"), dy.alias("dy"))
    return out.filter(F.pow(F.col("dx") * r2, F.lit(2)) + F.pow(F.col("dy") * r1, F.lit(2)) <= (r1 * r2) ** 2).withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))


def _mean(power: float, smoothing: float) -> Column:
    r2 = F.col("d2") + smoothing * smoothing
    w = F.when(r2 > 0, F.pow(F.when(r2 > 0, r2), F.lit(-power / 2)))
    same = F.max(F.when(F.col("d2") < 1e-13, F.struct("fid", "z")))["z"]
    return F.coalesce(same, F.sum(F.col("z") * w) / F.sum(w))


def simple(algorithm: str) -> Column:
    return {
        "average": lambda: F.avg("z"),
        "nearest": lambda: F.max_by("z", F.struct(-F.col("d2"), F.col("fid"))),
        "minimum": lambda: F.min("z"),
        "maximum": lambda: F.max("z"),
        "range": lambda: F.max("z") - F.min("z"),
        "count": lambda: F.count("*").cast("double"),
        "average_distance": lambda: F.avg(F.sqrt("d2")),
    }[algorithm]()


#: Places that a row of the pairs of a node's places holds on either side, and the most parts that one side is dealt to.
BLOCK, PARTS = 128, 16


def _pair_distance(found: DataFrame) -> DataFrame:
    """i, j, v (mean distance of all pairs of a node's points), n (the points). found: i, j, x, y, points (at that place).

    Points of one place go as one. A node's places meet in blocks, so neither memory nor a task is bound to a node.
    """
    by = Window.partitionBy("i", "j")
    places = found.groupBy("i", "j", "x", "y").agg(F.sum("points").alias("points"))
    numbered = places.withColumn("b", F.floor((F.row_number().over(by.orderBy("x", "y")) - 1) / BLOCK).cast("int")).withColumn("last", F.max("b").over(by))
    m = F.collect_list(F.struct("x", "y", F.col("points").cast("double").alias("n")))
    blocks = numbered.groupBy("i", "j", "b").agg(m.alias("m"), F.max("last").alias("last")).select("i", "j", "b", "last", *[F.col(f"m.{c}").alias(c) for c in "xyn"])
    parts = F.least(F.col("last") + 1, F.lit(PARTS))
    a = blocks.select("i", "j", F.pmod("b", parts).alias("part"), *[F.col(c).alias(f"{c}a") for c in "bxyn"])
    b = blocks.select("i", "j", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}b") for c in "bxyn"])

    @F.pandas_udf("double")
    def total(xa: pd.Series, ya: pd.Series, na: pd.Series, xb: pd.Series, yb: pd.Series, nb: pd.Series) -> pd.Series:
        each = zip(xa, ya, na, xb, yb, nb, strict=True)
        return pd.Series([float(n @ np.hypot(np.subtract.outer(x, p), np.subtract.outer(y, q)) @ k) for x, y, n, p, q, k in each], dtype="float64")

    met = a.join(b, ["i", "j", "part"]).filter("ba <= bb")
    sums = met.select("i", "j", (total("xa", "ya", "na", "xb", "yb", "nb") * F.when(F.col("ba") < F.col("bb"), 2.0).otherwise(1.0)).alias("t")).groupBy("i", "j").agg(F.sum("t").alias("t"))
    n = F.col("n").cast("double")
    return places.groupBy("i", "j").agg(F.sum("points").alias("n")).join(sums, ["i", "j"]).select("i", "j", F.when(n >= 2, F.col("t") / (n * (n - 1))).alias("v"), "n")


def grid(nodes_df: DataFrame, points: DataFrame, algorithm: str, r1: float, r2: float | None = None, angle: float = 0.0, min_points: int = 0, max_points: int | None = None, per_quadrant: int | None = None, power: float = 2.0, smoothing: float = 0.0, nodata: float = 0.0) -> DataFrame:
    """i, j, v for every node; nodata where too few points are near.

    max_points keeps the nearest of a node, per_quadrant the nearest of each quadrant (ties: the lesser fid).
    """
    pairs = algorithm == "average_distance_points"
    if pairs and not per_quadrant and not max_points:  # all points count, so those of one place may go as one at once
        points = points.groupBy("x", "y").agg(F.count("*").alias("points"), F.min("fid").alias("fid"), F.min("z").alias("z"))
    elif pairs:
        points = points.withColumn("points", F.lit(1).cast("bigint"))
    found = near(nodes_df, points, r1, r2, angle, ("points",) if pairs else ())
    if per_quadrant:
        quadrant = F.when(F.col("dx") >= 0, 1).otherwise(0) + F.when(F.col("dy") >= 0, 2).otherwise(0)
        found = found.withColumn("q", quadrant).withColumn("rank", F.row_number().over(Window.partitionBy("i", "j", "q").orderBy("d2", "fid"))).filter(F.col("rank") <= per_quadrant)
        if max_points:
            found = found.withColumn("turn", F.row_number().over(Window.partitionBy("i", "j").orderBy("rank", "q"))).filter(F.col("turn") <= max_points)
    elif max_points or algorithm == "invdistnn":
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("i", "j").orderBy("d2", "fid"))).filter(F.col("rank") <= (max_points or 12))
    if pairs:
        out = _pair_distance(found)
    else:
        value = _mean(power, smoothing) if algorithm in ("invdist", "invdistnn") else simple(algorithm)
        out = found.groupBy("i", "j").agg(value.alias("v"), F.count("*").alias("n"))
    enough = F.coalesce(F.col("n"), F.lit(0)) >= max(min_points, 0 if algorithm == "count" else 1)
    empty = F.lit(0.0) if algorithm == "count" and min_points == 0 else F.lit(float(nodata))
    return nodes_df.select("i", "j").join(out, ["i", "j"], "left").select("i", "j", F.when(enough & F.col("v").isNotNull(), F.col("v")).otherwise(empty).alias("v"))


def triangulate(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles (Bowyer-Watson)."""
    n = len(xy)
    mid, size = xy.mean(0), float(np.ptp(xy, axis=0).max() or 1.0) * 1e3
    pts = np.concatenate([xy, mid + size * np.array([[-2.0, -1.0], [2.0, -1.0], [0.0, 2.0]])])
    tri = np.array([[n, n + 1, n + 2]])

    def circle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = pts[t[:, 0]], pts[t[:, 1]], pts[t[:, 2]]
        d = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
        d = np.where(d == 0, 1e-300, d)
        bb, cc = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
        u = np.stack([((c - a)[:, 1] * bb - (b - a)[:, 1] * cc) / d, ((b - a)[:, 0] * cc - (c - a)[:, 0] * bb) / d], 1)
        return a + u, (u**2).sum(1)

    centre, r2 = circle(tri)
    for k in range(n):
        bad = ((pts[k] - centre) ** 2).sum(1) < r2 * (1 - 1e-12)
        if not bad.any():
            continue
        edges = np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]])
        key = np.sort(edges, axis=1)
        _, at, count = np.unique(key, axis=0, return_index=True, return_counts=True)
        new = np.concatenate([edges[at[count == 1]], np.full(((count == 1).sum(), 1), k)], axis=1)
        c, r = circle(new)
        tri, centre, r2 = np.concatenate([tri[~bad], new]), np.concatenate([centre[~bad], c]), np.concatenate([r2[~bad], r])
    return tri[(tri < n).all(1)]


def linear(nodes_df: DataFrame, points: DataFrame, radius: float, nodata: float = 0.0, max_points: int = 200_000) -> DataFrame:
    """Barycentric in Delaunay triangles; outside the hull, the nearest point within the radius.

    The triangulation is made on the driver and refuses more than max_points points.
    """
    rows = points.select("fid", "x", "y", "z").dropDuplicates(["x", "y"]).limit(max_points + 1).toPandas().sort_values("fid")
    if len(rows) > max_points:
        raise ValueError(f"more than {max_points} points to triangulate")
    xy, z = rows[["x", "y"]].to_numpy(float), rows["z"].to_numpy(float)
    tri = triangulate(xy) if len(rows) > 2 else np.zeros((0, 3), int)

    def run(batches):  # noqa: ANN001, ANN202
        a, b, c = (xy[tri[:, k]] for k in range(3))
        det = (b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0] if len(tri) else np.zeros(0)
        for batch in batches:
            out = []
            for x, y in zip(batch["cx"].to_pylist(), batch["cy"].to_pylist(), strict=True):
                p = np.array([x, y])
                v = None
                if len(tri):
                    u = ((p - a)[:, 0] * (c - a)[:, 1] - (p - a)[:, 1] * (c - a)[:, 0]) / det
                    w = ((b - a)[:, 0] * (p - a)[:, 1] - (b - a)[:, 1] * (p - a)[:, 0]) / det
                    inside = np.flatnonzero((u >= -1e-12) & (w >= -1e-12) & (u + w <= 1 + 1e-12))
                    if len(inside):
                        t = inside[0]
                        v = float(z[tri[t, 0]] * (1 - u[t] - w[t]) + z[tri[t, 1]] * u[t] + z[tri[t, 2]] * w[t])
                if v is None and len(xy):
                    d = ((xy - p) ** 2).sum(1)
                    k = len(d) - 1 - int(np.argmin(d[::-1]))
                    v = float(z[k]) if d[k] <= radius * radius else nodata
                out.append(nodata if v is None else v)
            yield pa.RecordBatch.from_arrays([batch["i"], batch["j"], pa.array(out, pa.float64())], names=["i", "j", "v"])

    return nodes_df.mapInArrow(run, "i int, j int, v double")

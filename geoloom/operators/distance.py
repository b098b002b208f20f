"""Distances and fills over cells: proximity, fill-nodata, viewshed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _envelope(g: np.ndarray) -> np.ndarray:
    """min over j of (i - j)^2 + g[j], for every i: lower envelope of parabolas; inf stays out."""
    own = np.flatnonzero(np.isfinite(g))
    n = len(g)
    if not len(own):
        return np.full(n, np.inf)
    v, z = [own[0]], [-np.inf]
    for q in own[1:]:
        while True:
            p = v[-1]
            s = ((g[q] + q * q) - (g[p] + p * p)) / (2.0 * (q - p))
            if s > z[-1] or len(v) == 1 and s == -np.inf:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    k = np.searchsorted(np.array(z[1:]), np.arange(n), "left")
    at = np.array(v)[k]
    return (np.arange(n) - at) ** 2 + g[at]


def proximity(df: DataFrame, targets: list[float] | None = None, max_distance: float | None = None, fixed: float | None = None) -> DataFrame:
    """Exact Euclidean distance in pixels to the nearest target cell (a value in targets, or any that isn't 0).

    Separable: along rows by windows, then along each column by the lower envelope of parabolas, a column per group.
    """
    hit = F.col("v").isin(targets) if targets else F.col("v") != 0
    place = F.when(hit, F.col("col"))
    by = Window.partitionBy("row").orderBy("col")
    left, right = F.last(place, True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first(place, True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = df.select("row", "col", "v", left.alias("l"), right.alias("r")).select("row", "col", F.least(F.col("col") - F.col("l"), F.col("r") - F.col("col")).cast("double").alias("d"))

    def run(t: pa.Table) -> pa.Table:
        r, d = t["row"].to_numpy(), t["d"].to_numpy(zero_copy_only=False)
        g = np.full(r.max() + 1, np.inf)
        g[r] = np.where(np.isnan(d), np.inf, d * d)
        return pa.table({"row": pa.array(r, pa.int32()), "col": t["col"].cast(pa.int32()), "v": np.sqrt(_envelope(g))[r]})

    out = rows.groupBy("col").applyInArrow(run, "row int, col int, v double")
    v = F.when(F.col("v") < float("inf"), F.col("v"))
    if max_distance is not None:
        v = F.when(v <= max_distance, v)
    if fixed is not None:
        v = F.when(v.isNotNull(), F.lit(float(fixed)))
    return out.withColumn("v", v)


def fill_nodata(df: DataFrame, max_distance: int = 100, strategy: str = "invdist", smoothing: int = 0) -> DataFrame:
    """Null cells from the nearest valid cells in four directions: inverse-distance mean, or the nearest (ties: left, right, up, down)."""
    row, col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    back, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    pick = lambda axis: F.when(F.col("v").isNotNull(), F.struct(F.col(axis).alias("at"), F.col("v").alias("v")))
    x = df.withColumns({"L": F.last(pick("col"), True).over(row.rowsBetween(*back)), "R": F.first(pick("col"), True).over(row.rowsBetween(*ahead))})
    x = x.withColumns({"U": F.last(pick("row"), True).over(col.rowsBetween(*back)), "D": F.first(pick("row"), True).over(col.rowsBetween(*ahead))})
    ways = [("L", F.col("col") - F.col("L.at")), ("R", F.col("R.at") - F.col("col")), ("U", F.col("row") - F.col("U.at")), ("D", F.col("D.at") - F.col("row"))]
    taps = F.filter(F.array(*[F.when(d <= max_distance, F.struct(d.cast("double").alias("d"), F.lit(k).alias("k"), F.col(f"{n}.v").alias("v"))) for k, (n, d) in enumerate(ways)]), lambda t: t.isNotNull())
    if strategy == "nearest":
        new = F.array_min(taps)["v"]
    else:
        total = F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + 1 / t["d"])
        new = F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["v"] / t["d"]) / F.when(total > 0, total)
    out = x.select("band", "row", "col", F.coalesce("v", new).alias("v"), F.col("v").isNull().alias("filled"))
    from .stencil import neighbors

    for _ in range(smoothing):
        mean = neighbors(out.select("band", "row", "col", "v"), "equal").withColumnRenamed("v", "m")
        out = out.join(mean, ["band", "row", "col"]).select("band", "row", "col", F.when(F.col("filled"), F.col("m")).otherwise(F.col("v")).alias("v"), "filled")
    return out.drop("filled")


def row_viewshed(df: DataFrame, observer_col: int, height: float = 2.0, target: float = 0.0, curvature: float = 0.0) -> DataFrame:
    """Whether each cell of a row is seen from that row's observer: the steepest sight line so far decides (a running maximum)."""
    d = F.abs(F.col("col") - observer_col).cast("double")
    eye = Window.partitionBy("row")
    base = F.max(F.when(F.col("col") == observer_col, F.col("v"))).over(eye) + height
    fall = curvature * d * d
    x = df.select("row", "col", "v", d.alias("d"), base.alias("eye")).withColumns({"side": F.signum(F.col("col") - observer_col), "ground": (F.col("v") - fall - F.col("eye")) / F.when(F.col("d") > 0, F.col("d")), "top": (F.col("v") + target - fall - F.col("eye")) / F.when(F.col("d") > 0, F.col("d"))})
    before = F.max("ground").over(Window.partitionBy("row", "side").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    return x.select("row", "col", F.when((F.col("d") <= 1) | before.isNull() | (F.col("top") >= before), 255).otherwise(0).alias("v"))


def _seen(grid: np.ndarray, row: int, col: int, height: float, target: float) -> np.ndarray:
    """Cells in sight of an observer: lines to the border cells, each with a running steepest slope."""
    h, w = grid.shape
    eye = grid[row, col] + height
    out = np.zeros((h, w), bool)
    out[row, col] = True
    ends = [(r, c) for r in range(h) for c in (0, w - 1)] + [(r, c) for c in range(w) for r in (0, h - 1)]
    for r, c in set(ends):
        n = max(abs(r - row), abs(c - col))
        if n:
            k = np.arange(1, n + 1)
            rr, cc = np.rint(row + (r - row) * k / n).astype(int), np.rint(col + (c - col) * k / n).astype(int)
            d = np.hypot(rr - row, cc - col)
            ground, top = (grid[rr, cc] - eye) / d, (grid[rr, cc] + target - eye) / d
            before = np.concatenate([[-np.inf], np.maximum.accumulate(ground)[:-1]])
            seen = top >= before
            out[rr[seen], cc[seen]] = True
    return out


def viewshed(df: DataFrame, observers: list[tuple[int, int]], height: float = 2.0, target: float = 0.0) -> DataFrame:
    """row, col, n: by how many observers a cell is seen. A raster goes to each observer's group: observers are the parallel axis."""
    spark = df.sparkSession
    who = spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(observers)], "k int, orow int, ocol int")
    sent = df.select("row", "col", "v").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(observers) - 1)))).join(F.broadcast(who), "k")

    def run(t: pa.Table) -> pa.Table:
        r, c, v = t["row"].to_numpy(), t["col"].to_numpy(), t["v"].to_numpy(zero_copy_only=False)
        grid = np.full((r.max() + 1, c.max() + 1), -np.inf)
        grid[r, c] = np.where(np.isnan(v), -np.inf, v)
        seen = _seen(grid, t["orow"][0].as_py(), t["ocol"][0].as_py(), height, target)
        return pa.table({"row": pa.array(r, pa.int32()), "col": pa.array(c, pa.int32()), "n": pa.array(seen[r, c].astype(np.int64))})

    return sent.groupBy("k").applyInArrow(run, "row int, col int, n long").groupBy("row", "col").agg(F.sum("n").alias("n"))

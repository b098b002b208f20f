"""Between rasters and vectors: zonal statistics, sampling, burning, contours, and cells as features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zonal(df: DataFrame, zone: str = "zone", value: str = "v", weight: str | None = None, stats: list[str] | None = None, width: int = 0) -> DataFrame:
    """Statistics of the cells of each zone. Needs row and col for the extremes' centres.

    mode and minority need the counts of each value first: the values of a zone are counted where they are, then merged.
    """
    stats = stats or ["count", "sum", "mean", "min", "max", "variance", "stdev"]
    v = F.col(value)
    pos = F.col("row").cast("bigint") * max(width, 1) + F.col("col") if "row" in df.columns else F.lit(0)
    known = {
        "count": F.count(v), "sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "variance": F.var_pop(v), "stdev": F.stddev_pop(v),
        "variety": F.count_distinct(v), "median": F.percentile(v, F.lit(0.5)),
    }
    if "row" in df.columns:
        known |= {f"{k}_center_{a}": (F.min_by if k == "min" else F.max_by)(F.col("col" if a == "x" else "row") + 0.5, F.when(v.isNotNull(), F.struct(v, pos if k == "min" else -pos))) for k in ("min", "max") for a in "xy"}
    if weight:
        w = F.when(v.isNotNull(), F.col(weight))
        known |= {"weighted_sum": F.sum(v * w), "weighted_mean": F.sum(v * w) / F.sum(w)}
        if {"weighted_variance", "weighted_stdev"}.intersection(stats):  # of the distances from the zone's mean: nothing cancels
            means = df.groupBy(zone).agg(known["weighted_mean"].alias("__mean"))
            df = df.join(means, zone)
            known["weighted_variance"] = F.sum(w * (v - F.col("__mean")) * (v - F.col("__mean"))) / F.sum(w)
            known["weighted_stdev"] = F.sqrt(known["weighted_variance"])
    plain = [known[s].alias(s) for s in stats if s in known]
    out = df.groupBy(zone).agg(*plain) if plain else df.select(zone).distinct()
    listed = [s for s in stats if s in ("values", "center_x", "center_y", "weights", "coverage")]
    if listed:  # lists of all cells of a zone, in order of place: as large as the zone
        ws = F.col(weight).cast("double") if weight else F.lit(1.0)
        one = F.struct(pos.alias("pos"), v.alias("values"), (F.col("col") + 0.5).alias("center_x"), (F.col("row") + 0.5).alias("center_y"), ws.alias("weights"), F.lit(1.0).alias("coverage"))
        cells = df.filter(v.isNotNull()).groupBy(zone).agg(F.array_sort(F.collect_list(one)).alias("cells"))
        out = out.join(cells.select(zone, *[F.col(f"cells.{s}").alias(s) for s in listed]), zone, "left")
    counted = [s for s in stats if s in ("mode", "minority", "unique", "frac")]
    if counted:
        n = df.filter(v.isNotNull()).groupBy(zone, v.alias("x")).agg(F.count("*").alias("n"))
        top = {"mode": F.max(F.struct("n", "x"))["x"], "minority": F.min(F.struct("n", "x"))["x"], "unique": F.array_sort(F.collect_list("x")), "frac": F.transform(F.array_sort(F.collect_list(F.struct("x", "n"))), lambda s: s["n"])}
        out = out.join(n.groupBy(zone).agg(*[top[s].alias(s) for s in counted]), zone, "left")
    return out


def zone_cells(zones: DataFrame, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), all_touched: bool = False) -> DataFrame:
    """Rectangular zones (zone, env) as cells (zone, row, col): those whose centre is inside, or all that they touch."""
    x0, dx, _, y0, _, dy = gt
    c0, c1 = (F.col("env.xmin") - x0) / dx, (F.col("env.xmax") - x0) / dx
    r0, r1 = (F.col("env.ymin") - y0) / dy, (F.col("env.ymax") - y0) / dy
    r0, r1 = F.least(r0, r1), F.greatest(r0, r1)
    first = (lambda c: F.floor(c)) if all_touched else (lambda c: F.ceil(c - 0.5))
    last = (lambda c: F.ceil(c) - 1) if all_touched else (lambda c: F.ceil(c - 0.5) - 1)
    span = lambda a, b: F.when(last(b) >= first(a), F.sequence(first(a).cast("int"), last(b).cast("int")))
    return zones.select("zone", F.explode(span(r0, r1)).alias("row"), c0.alias("c0"), c1.alias("c1")).select("zone", "row", F.explode(span(F.col("c0"), F.col("c1"))).alias("col"))


def polygon_cells(zones: DataFrame, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), all_touched: bool = False) -> DataFrame:
    """Polygon zones (zone, geom) as cells by scan lines through cell centres: even-odd spans between crossings.

    all_touched adds the cells that an edge runs through.
    """
    from geoloom.functions.geometry import geometry_udf

    x0, dx, _, y0, _, dy = gt

    def spans(g):  # noqa: ANN001, ANN202
        polygons = [g[1]] if g[0] == 3 else g[1] if g[0] == 6 else []
        edges = [((a[0] - x0) / dx, (a[1] - y0) / dy, (b[0] - x0) / dx, (b[1] - y0) / dy) for p in polygons for ring in p for a, b in zip(ring, ring[1:], strict=False)]
        if not edges:
            return []
        out = []
        low, high = min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)
        for row in range(math.ceil(low - 0.5), math.ceil(high - 0.5)):
            y = row + 0.5
            xs = sorted(a + (y - b) * (c - a) / (d - b) for a, b, c, d in edges if (b <= y) != (d <= y))
            for a, b in zip(xs[::2], xs[1::2], strict=False):
                c0, c1 = math.ceil(a - 0.5), math.ceil(b - 0.5)
                if c1 > c0:
                    out.append((row, c0, c1))
        if all_touched:
            for x1, y1, x2, y2 in edges:
                for row in range(math.floor(min(y1, y2)), math.ceil(max(y1, y2))):
                    ends = [x1, x2] if y1 == y2 else [x1 + (min(max(y, min(y1, y2)), max(y1, y2)) - y1) / (y2 - y1) * (x2 - x1) for y in (row, row + 1)]
                    a, b = min(ends), max(ends)
                    c0 = math.floor(a)
                    c1 = max(c0 + (a != b or a != c0), math.ceil(b))
                    if c1 > c0:
                        out.append((row, c0, c1))
        return [{"row": r, "c0": a, "c1": b} for r, a, b in out]

    s = zones.select("zone", F.explode(geometry_udf(spans, "array<struct<row:int,c0:int,c1:int>>")("geom")).alias("s"))
    cells = s.select("zone", "s.row", F.explode(F.sequence(F.col("s.c0"), F.col("s.c1") - 1)).alias("col")).filter("col >= 0 and row >= 0")
    return cells.distinct() if all_touched else cells


def pixel_info(points: DataFrame, df: DataFrame, resampling: str = "nearest") -> DataFrame:
    """points (fid, x, y in pixels) with the raster's value: the cell under the point, or the bilinear mean of four."""
    cells = df.select("row", "col", "v")
    if resampling == "nearest":
        at = points.withColumns({"row": F.floor("y").cast("int"), "col": F.floor("x").cast("int")})
        return at.join(cells, ["row", "col"], "left").select(*points.columns, "v")
    fx, fy = F.col("x") - 0.5, F.col("y") - 0.5
    bx, by = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    tx, ty = fx - bx, fy - by
    corners = F.array(*[F.struct((by + i).alias("row"), (bx + j).alias("col"), ((ty if i else 1 - ty) * (tx if j else 1 - tx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    sent = points.withColumn("t", F.explode(corners)).select(*points.columns, "t.*").filter("w > 0")
    agg = sent.join(cells, ["row", "col"]).filter("v is not null").groupBy(*points.columns).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return points.join(agg, points.columns, "left")


def pixel_info_lines(lines: DataFrame, df: DataFrame, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)) -> DataFrame:
    """Lines (value: "x y", in georeferenced coordinates) with the raster's value there; lines may be a stream."""
    x0, dx, _, y0, _, dy = gt
    part = F.split(F.trim("value"), r"[\s,]+")
    x, y = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    at = lines.select("value", F.floor((y - y0) / dy).cast("int").alias("row"), F.floor((x - x0) / dx).cast("int").alias("col"))
    return at.join(df.select("row", "col", "v"), ["row", "col"], "left").select("value", "row", "col", "v")


def rasterize_points(points: DataFrame, value: Column, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), add: bool = False, init: float | None = None) -> DataFrame:
    """Burns points: the last feature (by fid) wins, or values add up."""
    x0, dx, _, y0, _, dy = gt
    cells = points.select("fid", value.alias("b"), F.floor((F.col("y") - y0) / dy).cast("int").alias("row"), F.floor((F.col("x") - x0) / dx).cast("int").alias("col"))
    burnt = (F.sum("b") + (init or 0.0)) if add else F.max_by("b", "fid")
    return cells.groupBy("row", "col").agg(burnt.alias("v"))


def rasterize_lines(lines: DataFrame, value: Column) -> DataFrame:
    """Burns segments (fid, x, y, x2, y2, in pixels) cell by cell along their longer side; the last feature wins."""
    n = F.greatest(F.abs(F.floor("x2") - F.floor("x")), F.abs(F.floor("y2") - F.floor("y"))).cast("int")
    steps = lines.withColumn("b", value).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = F.when(F.col("n") > 0, F.col("k") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    at = steps.select("fid", "b", F.floor(F.col("y") + (F.col("y2") - F.col("y")) * part).cast("int").alias("row"), F.floor(F.col("x") + (F.col("x2") - F.col("x")) * part).cast("int").alias("col"))
    return at.groupBy("row", "col").agg(F.max_by("b", "fid").alias("v"))


def rasterize_inverse(zones: DataFrame, size: tuple[int, int], value: float, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), all_touched: bool = False) -> DataFrame:
    """Burns value where no polygon (zone, geom) is, in a raster of size (height, width)."""
    height, width = size
    every = zones.sparkSession.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("row"), F.expr(f"cast(id % {width} as int)").alias("col"))
    return every.join(polygon_cells(zones.select("zone", "geom"), gt, all_touched), ["row", "col"], "left_anti").withColumn("v", F.lit(float(value)))


def rasterize_polygons(zones: DataFrame, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), add: bool = False, all_touched: bool = False) -> DataFrame:
    """Burns polygons (zone: feature number, geom, burn)."""
    cells = polygon_cells(zones.select("zone", "geom"), gt, all_touched).join(zones.select("zone", "burn"), "zone")
    return cells.groupBy("row", "col").agg((F.sum("burn") if add else F.max_by("burn", "zone")).alias("v"))


def as_features(df: DataFrame, bands: int = 1, gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), skip_nodata: bool = False) -> DataFrame:
    """A row per pixel: CENTER_X, CENTER_Y, ROW, COL, BAND_1..n."""
    x0, dx, _, y0, _, dy = gt
    values = [F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"BAND_{b}") for b in range(1, bands + 1)]
    wide = df.select("row", "col", F.col("v").alias("BAND_1")) if bands == 1 else df.groupBy("row", "col").agg(*values)
    if skip_nodata:
        wide = wide.filter(" and ".join(f"BAND_{b} is not null" for b in range(1, bands + 1)))
    return wide.select((x0 + (F.col("col") + 0.5) * dx).alias("CENTER_X"), (y0 + (F.col("row") + 0.5) * dy).alias("CENTER_Y"), F.col("row").alias("ROW"), F.col("col").alias("COL"), *[f"BAND_{b}" for b in range(1, bands + 1)])


#: Marching squares: for each of the sides n, e, s, w of a square of centres, its ends among the corners a b / d c.
SIDES = {"n": ("a", "b"), "e": ("b", "c"), "s": ("d", "c"), "w": ("a", "d")}


def contour_segments(df: DataFrame, interval: float | None = None, base: float = 0.0, levels: list[float] | None = None, exp_base: float | None = None) -> DataFrame:
    """level, row, col, x1, y1, x2, y2: the contour segments of every square of four cell centres.

    Levels: base and multiples of interval from it; or those given; or the powers of exp_base.

    A side is crossed where one end is below the level and the other at or above it; saddles are split by the mean.
    """
    from pyspark.sql import Window

    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    sq = df.select("row", "col", F.col("v").alias("a")).withColumn("b", F.lead("a").over(by_row)).withColumns({"d": F.lead("a").over(by_col), "c": F.lead("b").over(by_col)}).dropna()
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    if levels is not None:
        lev = sq.withColumn("level", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in levels]), lambda x: (x > low) & (x <= high))))
    elif exp_base is not None:
        log = lambda x: F.log(F.greatest(x, F.lit(1e-300))) / math.log(exp_base)
        powers = F.transform(F.sequence(F.floor(log(low)).cast("int"), F.ceil(log(high)).cast("int")), lambda k: F.pow(F.lit(float(exp_base)), k))
        lev = sq.filter(high > 0).withColumn("level", F.explode(F.filter(powers, lambda x: (x > low) & (x <= high))))
    else:
        first, last = F.floor((low - base) / interval) + 1, F.floor((high - base) / interval)
        lev = sq.filter(last >= first).withColumn("level", F.explode(F.transform(F.sequence(first, last), lambda k: k * interval + base)))
    place = {"a": (0.5, 0.5), "b": (1.5, 0.5), "c": (1.5, 1.5), "d": (0.5, 1.5)}

    def cross(side: str) -> Column:
        p, q = SIDES[side]
        t = (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))
        (px, py), (qx, qy) = place[p], place[q]
        hit = (F.col(p) < F.col("level")) != (F.col(q) < F.col("level"))
        return F.when(hit, F.struct((F.col("col") + px + (qx - px) * t).alias("x"), (F.col("row") + py + (qy - py) * t).alias("y")))

    pts = lev.withColumns({s: cross(s) for s in SIDES})
    all4 = F.col("n").isNotNull() & F.col("e").isNotNull() & F.col("s").isNotNull() & F.col("w").isNotNull()
    high_mean = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= F.col("level")
    a_high = F.col("a") >= F.col("level")
    seg = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    n, e, s, w = (F.col(k) for k in "nesw")
    saddle = F.when(a_high == high_mean, F.array(seg(n, e), seg(s, w))).otherwise(F.array(seg(n, w), seg(s, e)))
    some = F.filter(F.array(n, e, s, w), lambda x: x.isNotNull())
    out = pts.withColumn("g", F.explode(F.when(all4, saddle).otherwise(F.array(seg(F.get(some, F.lit(0)), F.get(some, F.lit(1)))))))
    return out.select("level", "row", "col", F.col("g.p.x").alias("x1"), F.col("g.p.y").alias("y1"), F.col("g.q.x").alias("x2"), F.col("g.q.y").alias("y2"))


def contour_lines(df: DataFrame, interval: float, base: float = 0.0) -> DataFrame:
    """level, line (array of points): segments put together where ends meet, a level per group."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t[c].to_pylist() for c in ("x1", "y1", "x2", "y2")), strict=True))
        rows.sort()
        at = lambda p: (round(p[0], 9), round(p[1], 9))
        ends: dict[tuple, list[int]] = {}
        for k in reversed(range(len(rows))):
            for p in (rows[k][:2], rows[k][2:]):
                ends.setdefault(at(p), []).append(k)
        used, lines = [False] * len(rows), []
        for k in range(len(rows)):
            if used[k]:
                continue
            used[k] = True
            halves = []
            for p in (rows[k][2:], rows[k][:2]):
                half = [list(p)]
                while True:
                    own = ends[at(half[-1])]
                    while own and used[own[-1]]:
                        own.pop()
                    if not own:
                        break
                    nxt = own.pop()
                    used[nxt] = True
                    a, b = rows[nxt][:2], rows[nxt][2:]
                    half.append(list(b if at(a) == at(half[-1]) else a))
                halves.append(half)
            lines.append(halves[1][::-1] + halves[0])
        return pa.table({"level": [t["level"][0].as_py()] * len(lines), "line": pa.array(lines, pa.list_(pa.list_(pa.float64())))})

    return contour_segments(df, interval, base).groupBy("level").applyInArrow(run, "level double, line array<array<double>>")

"""Resampling over cells: overviews, resize, reproject, update, tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overview(df: DataFrame, factor: int = 2, method: str = "average") -> DataFrame:
    """A level reduced by factor: average, nearest, mode, min, max, sum, rms."""
    cells = df.withColumns({"r": F.expr(f"row div {factor}").cast("int"), "c": F.expr(f"col div {factor}").cast("int")})
    if method == "mode":
        n = cells.filter("v is not null").groupBy("band", "r", "c", "v").agg(F.count("*").alias("n"))
        out = n.groupBy("band", "r", "c").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    else:
        agg = {"average": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "sum": F.sum("v"), "rms": F.sqrt(F.avg(F.col("v") * F.col("v"))), "nearest": F.max(F.when((F.col("row") % factor == factor // 2) & (F.col("col") % factor == factor // 2), F.col("v")))}[method]
        out = cells.groupBy("band", "r", "c").agg(agg.alias("v"))
    return out.select("band", F.col("r").alias("row"), F.col("c").alias("col"), "v")


def pyramid(df: DataFrame, levels: int, method: str = "average") -> dict[int, DataFrame]:
    """Overviews by 2, 4, 8, ...: each from the one before."""
    out, now = {}, df
    for k in range(1, levels + 1):
        now = overview(now, 2, method)
        out[1 << k] = now
    return out


def refresh(level: DataFrame, df: DataFrame, factor: int, window: tuple[int, int, int, int], method: str = "average") -> DataFrame:
    """An overview level computed anew for the cells that a window (row0, col0, row1, col1, end exclusive) touches."""
    r0, c0, r1, c1 = window[0] // factor, window[1] // factor, -(-window[2] // factor), -(-window[3] // factor)
    touched = F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)
    source = df.filter(F.col("row").between(r0 * factor, r1 * factor - 1) & F.col("col").between(c0 * factor, c1 * factor - 1))
    return level.filter(~touched).unionByName(overview(source, factor, method).select(*level.columns))


def _cubic(x: Column) -> Column:
    a, t = -0.5, F.abs(x)
    return F.when(t <= 1, (a + 2) * t * t * t - (a + 3) * t * t + 1).when(t < 2, a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a).otherwise(0.0)


def _bspline(x: Column) -> Column:
    t = F.abs(x)
    return F.when(t <= 1, 2 / 3 - t * t + t * t * t / 2).when(t < 2, F.pow(2 - t, F.lit(3)) / 6).otherwise(0.0)


def _lanczos(x: Column) -> Column:
    import math

    p = math.pi * x
    return F.when(x == 0, 1.0).when(F.abs(x) < 3, 3 * F.sin(p) * F.sin(p / 3) / F.when(x != 0, p * p)).otherwise(0.0)


KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda x: F.greatest(F.lit(0.0), 1 - F.abs(x))),
    "cubic": (2, _cubic),
    "cubicspline": (2, _bspline),
    "lanczos": (3, _lanczos),
}


def resize(df: DataFrame, size: tuple[int, int], new: tuple[int, int], method: str = "nearest") -> DataFrame:
    """From size (height, width) to new. Kernels are separable: an aggregate by row, then one by column; valid taps are renormalised.

    method: nearest, bilinear, cubic, cubicspline, lanczos; by area: average, sum, rms, min, max; by centres: mode, med, q1, q3.
    """
    (h, w), (nh, nw) = size, new
    if method == "nearest":
        spread = lambda c, old, now: F.filter(F.transform(F.sequence(F.floor(c * now / old).cast("int") - 1, F.ceil((c + 1) * now / old).cast("int")), lambda k: F.when((k >= 0) & (k < now) & (F.floor((k + 0.5) * old / now + 1e-10) == c), k)), lambda k: k.isNotNull())
        out = df.withColumn("nr", F.explode(spread(F.col("row"), h, nh))).withColumn("nc", F.explode(spread(F.col("col"), w, nw)))
        return out.select("band", F.col("nr").alias("row"), F.col("nc").alias("col"), "v")
    area = ("average", "sum", "rms", "min", "max")
    if method in ("mode", "med", "q1", "q3"):  # of the source cells whose centre is in the target cell
        k = {"med": 0.5, "q1": 0.25, "q3": 0.75}
        at = lambda c, old, now: F.floor((F.col(c) + 0.5) * now / old).cast("int")
        inside = df.filter("v is not null").select("band", at("row", h, nh).alias("row"), at("col", w, nw).alias("col"), "v")
        if method == "mode":
            counts = inside.groupBy("band", "row", "col", "v").agg(F.count("*").alias("n"))
            return counts.groupBy("band", "row", "col").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
        return inside.groupBy("band", "row", "col").agg(F.percentile("v", F.lit(k[method])).alias("v"))
    if method in area:
        taps = lambda c, old, now: F.transform(F.sequence(F.floor(c * now / old).cast("int"), F.ceil((c + 1) * now / old).cast("int") - 1), lambda k: F.struct(k.alias("k"), (F.least((k + 1) * old / now, c + 1.0) - F.greatest(k * old / now, c.cast("double"))).alias("w")))
    else:
        radius, fn = KERNELS[method]

        def taps(c: Column, old: int, now: int) -> Column:
            scale = max(1.0, old / now)  # a kernel widens when it shrinks the raster
            first = F.floor((c + 0.5 - radius * scale) * now / old - 0.5).cast("int")
            last = F.ceil((c + 0.5 + radius * scale) * now / old).cast("int")
            return F.transform(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(now - 1))), lambda k: F.struct(k.alias("k"), fn((c + 0.5 - (k + 0.5) * old / now) / scale).alias("w")))

    valid = df.filter("v is not null")

    def one(x: DataFrame, axis: str, other: str, old: int, now: int) -> DataFrame:
        sent = x.withColumn("t", F.explode(taps(F.col(axis), old, now))).filter("t.w <> 0")
        by = sent.groupBy("band", F.col("t.k").alias(axis), other)
        if method in ("min", "max"):
            return by.agg((F.min if method == "min" else F.max)("v").alias("v"))
        if method == "sum":
            return by.agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))
        sums = by.agg(F.sum(F.col("v") * F.col("t.w")).alias("s"), F.sum("t.w").alias("n"))
        return sums.filter("n <> 0").select("band", axis, other, (F.col("s") / F.col("n")).alias("v"))

    if method == "rms":
        valid = valid.withColumn("v", F.col("v") * F.col("v"))
    out = one(one(valid, "col", "row", w, nw), "row", "col", h, nh).select("band", "row", "col", "v")
    return out.withColumn("v", F.sqrt("v")) if method == "rms" else out


def reproject(df: DataFrame, target: DataFrame, inverse: Callable[[Column, Column], tuple[Column, Column]], source_gt: tuple[float, ...], target_gt: tuple[float, ...], method: str = "nearest") -> DataFrame:
    """Values at the centres of target cells (row, col), found in the source by the inverse transform."""
    x0, dx, _, y0, _, dy = target_gt
    sx, sdx, _, sy, _, sdy = source_gt
    x, y = inverse(x0 + (F.col("col") + 0.5) * dx, y0 + (F.col("row") + 0.5) * dy)
    place = target.select("row", "col", ((x - sx) / sdx).alias("px"), ((y - sy) / sdy).alias("py"))
    cells = df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "band", "v")
    if method == "nearest":
        at = place.withColumns({"sr": F.floor(F.col("py") + 1e-10).cast("int"), "sc": F.floor(F.col("px") + 1e-10).cast("int")})
        return at.join(cells, ["sr", "sc"]).select("band", "row", "col", "v")
    radius, fn = KERNELS[method]
    br, bc = F.floor(F.col("py") - 0.5).cast("int"), F.floor(F.col("px") - 0.5).cast("int")
    offsets = [(i, j) for i in range(1 - radius, radius + 1) for j in range(1 - radius, radius + 1)]
    taps = F.explode(F.array(*[F.struct((br + i).alias("sr"), (bc + j).alias("sc"), (fn(F.col("py") - 0.5 - (br + i)) * fn(F.col("px") - 0.5 - (bc + j))).alias("w")) for i, j in offsets]))
    sent = place.select("row", "col", taps.alias("t")).select("row", "col", "t.*").filter("w <> 0")
    sums = sent.join(cells.filter("v is not null"), ["sr", "sc"]).groupBy("band", "row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("n"))
    return sums.filter("n <> 0").select("band", "row", "col", (F.col("s") / F.col("n")).alias("v"))


def update(target: DataFrame, source: DataFrame, row0: int = 0, col0: int = 0) -> DataFrame:
    """Pastes source into target at an offset; null source cells leave what is there."""
    moved = source.select("band", (F.col("row") + row0).alias("row"), (F.col("col") + col0).alias("col"), F.col("v").alias("s"))
    return target.join(moved, ["band", "row", "col"], "left").select("band", "row", "col", F.coalesce("s", "v").alias("v"))


def tiles(df: DataFrame, size: int = 256, max_zoom: int = 0, min_zoom: int = 0, tms: bool = False) -> DataFrame:
    """z, tx, ty, and the cells of each tile as an array of (row, col, v): max_zoom is full resolution, lower ones overviews."""
    out, now = None, df
    for z in range(max_zoom, min_zoom - 1, -1):
        ty = F.expr(f"row div {size}").cast("int")
        own = now.groupBy("band", F.lit(z).alias("z"), F.expr(f"col div {size}").cast("int").alias("tx"), (F.lit((1 << z) - 1) - ty if tms else ty).alias("ty")).agg(F.array_sort(F.collect_list(F.struct((F.col("row") % size).alias("row"), (F.col("col") % size).alias("col"), "v"))).alias("cells"))
        out = own if out is None else out.unionByName(own)
        now = overview(now, 2)
    return out


def mercator_tiles(df: DataFrame, gt: tuple[float, ...], zoom: int, size: int = 256) -> DataFrame:
    """z, tx, ty, row, col, v of the pixels of the world's square tiles (EPSG:3857, from the top left corner): each is the mean
    of the raster's cells whose centre is in it. gt is the raster's, in the same projection."""
    import math

    x0, dx, _, y0, _, dy = gt
    half = math.pi * 6378137.0
    step = 2 * half / (size << zoom)
    px = F.floor((x0 + (F.col("col") + 0.5) * dx + half) / step)
    py = F.floor((half - (y0 + (F.col("row") + 0.5) * dy)) / step)
    pixels = df.filter("v is not null").groupBy("band", px.alias("px"), py.alias("py")).agg(F.avg("v").alias("v"))
    tile, inside = lambda c: F.expr(f"cast({c} div {size} as int)"), lambda c: (F.col(c) % size).cast("int")
    return pixels.select("band", F.lit(zoom).alias("z"), tile("px").alias("tx"), tile("py").alias("ty"), inside("py").alias("row"), inside("px").alias("col"), "v")

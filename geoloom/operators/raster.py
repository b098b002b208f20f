"""Raster algebra and management over cells: DataFrames (band, row, col, v), where a null v is no data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import pixel

CELL = ["band", "row", "col"]
#: Ranges of the sample types, and the primes of the checksum.
RANGES = {"Byte": (0, 255), "Int8": (-128, 127), "UInt16": (0, 65535), "Int16": (-32768, 32767), "UInt32": (0, 4294967295), "Int32": (-2147483648, 2147483647)}
PRIMES = (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43)
FLOAT16_MAX = 65504.0


def as_bands(inputs: list[DataFrame]) -> DataFrame:
    """One-band rasters as the bands 1, 2, ... of one."""
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k + 1).alias("band"), "row", "col", F.col("v").cast("double").alias("v")) for k, df in enumerate(inputs)])


def calc(inputs: list[DataFrame], function: str, propagate: bool = False, **args: float) -> DataFrame:
    """A pixel function over rasters on one grid: one shuffle by cell, then one expression."""
    n = len(inputs)
    grouped = as_bands(inputs).groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == k + 1, F.col("v"))).alias(f"v{k}") for k in range(n)])
    vals = F.array(*[F.col(f"v{k}") for k in range(n)])
    return grouped.select(F.lit(1).alias("band"), "row", "col", pixel.apply(function, vals, propagate, **args).alias("v"))


def calc_bands(df: DataFrame, columns: list[str], function: str, propagate: bool = False, **args: float) -> DataFrame:
    """A pixel function over columns that hold the bands of a cell already: no shuffle."""
    return df.withColumn("v", pixel.apply(function, F.array(*[F.col(c).cast("double") for c in columns]), propagate, **args))


def parse_mapping(text: str) -> list[tuple[str, str]]:
    """`source=target` pairs, separated by `;` or lines; `#` begins a comment."""
    text = "\n".join(line.split("#")[0] for line in text.splitlines())
    return [tuple(p.strip() for p in part.split("=", 1)) for part in re.split(r"[;\n]", text) if part.strip()]


def reclassify(v: Column, mapping: str) -> Column:
    """Ordered mapping of values and intervals; the first match wins and an unmapped value is an error.

    Sources: a number, `[a,b]` with round or square ends (inf allowed), NO_DATA, DEFAULT. Targets: a number, NO_DATA, PASS_THROUGH.
    """
    out, default = None, None
    for source, target in parse_mapping(mapping):
        value = F.lit(None).cast("double") if target == "NO_DATA" else v.cast("double") if target == "PASS_THROUGH" else F.lit(float(target))
        if source == "DEFAULT":
            default = value
            continue
        if source == "NO_DATA":
            test = v.isNull()
        elif m := re.fullmatch(r"([\[(])\s*([^,]+)\s*,\s*([^\])]+)\s*([\])])", source):
            low, high = float(m[2]), float(m[3])
            test = (v >= low if m[1] == "[" else v > low) & (v <= high if m[4] == "]" else v < high)
        else:
            test = F.isnan(v) if source.lower() == "nan" else v == float(source)
        out = F.when(test, value) if out is None else out.when(test, value)
    end = default if default is not None else F.when(v.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit("no mapping for "), v.cast("string"))).cast("double"))
    return end if out is None else out.otherwise(end)


def rescale(v: Column, source: tuple[float, float], target: tuple[float, float], exponent: float | None = None, clip: bool = True) -> Column:
    low, high = source
    high = high + 0.1 if high == low else high
    part = (v - low) / (high - low)
    if exponent is not None:
        part = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), F.lit(float(exponent)))
    out = target[0] + (target[1] - target[0]) * part
    return F.greatest(F.lit(float(min(target))), F.least(F.lit(float(max(target))), out)) if clip else out


def scale(df: DataFrame, target: tuple[float, float] = (0.0, 255.0), source: tuple[float, float] | None = None, exponent: float | None = None) -> DataFrame:
    """Linear or power rescale; without a source range, the raster's own."""
    if source is None:
        source = tuple(float(x) for x in df.agg(F.min("v"), F.max("v")).first())
    return df.withColumn("v", rescale(F.col("v"), source, target, exponent))


def unscale(df: DataFrame, scale_by: float, offset: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * scale_by + offset)


def round_half_away(v: Column) -> Column:
    return F.signum(v) * F.floor(F.abs(v) + 0.5)


def store(v: Column, dtype: str) -> Column:
    """A value as a sample type holds it: integers rounded half away and clamped, floats saturated."""
    if dtype in RANGES:
        low, high = RANGES[dtype]
        return F.when(~F.isnan(v), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), round_half_away(v)))).otherwise(F.when(v.isNotNull(), F.lit(0.0)))
    if dtype == "Float16":
        return F.greatest(F.lit(-FLOAT16_MAX), F.least(F.lit(FLOAT16_MAX), v))
    return v.cast("float").cast("double") if dtype == "Float32" else v


def set_type(df: DataFrame, dtype: str) -> DataFrame:
    return df.withColumn("v", store(F.col("v"), dtype))


def select_bands(df: DataFrame, bands: list[int], exclude: bool = False) -> DataFrame:
    if exclude:
        return df.filter(~F.col("band").isin(bands)) if bands else df
    wanted = F.array(*[F.struct(F.lit(b).alias("old"), F.lit(k + 1).alias("new")) for k, b in enumerate(bands)])
    hits = F.filter(wanted, lambda w: w["old"] == F.col("band"))
    return df.withColumn("__hit", F.explode(hits)).withColumn("band", F.col("__hit.new")).drop("__hit")


def stack(inputs: list[tuple[DataFrame, int]]) -> DataFrame:
    """Bands of several rasters, one after another. inputs: cells and their number of bands."""
    parts, at = [], 0
    for df, n in inputs:
        parts.append(df.withColumn("band", (F.col("band") + at).cast("int")))
        at += n
    return reduce(lambda a, b: a.unionByName(b), parts)


def mosaic(inputs: list[DataFrame], function: str | None = None, offsets: list[tuple[int, int]] | None = None, **args: float) -> DataFrame:
    """Union of rasters on one grid: the last valid value wins, or a pixel function over what overlaps, in order."""
    offsets = offsets or [(0, 0)] * len(inputs)
    parts = [df.select("band", (F.col("row") + r).cast("int").alias("row"), (F.col("col") + c).cast("int").alias("col"), F.col("v").cast("double").alias("v"), F.lit(k).alias("seq")) for k, (df, (r, c)) in enumerate(zip(inputs, offsets, strict=True))]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    if function is None:
        return union.groupBy(*CELL).agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("seq"))).alias("v"))
    simple = {"sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "mean": F.avg("v")}
    if function in simple and not args:  # these combine before the shuffle
        return union.groupBy(*CELL).agg(simple[function].alias("v"))
    vals = F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda s: s["v"])  # at most one value per input
    return union.groupBy(*CELL).agg(vals.alias("vals")).select(*CELL, pixel.apply(function, F.col("vals"), **args).alias("v"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that differ: band, row, col, a, b."""
    joined = a.select(*CELL, F.col("v").alias("a")).join(b.select(*CELL, F.col("v").alias("b")), CELL, "full_outer")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b")))


def nodata_to_alpha(df: DataFrame, bands: int = 1) -> DataFrame:
    alpha = df.filter("band = 1").withColumn("band", F.lit(bands + 1)).withColumn("v", F.when(F.col("v").isNull(), 0.0).otherwise(255.0))
    return df.withColumn("band", F.col("band").cast("int")).unionByName(alpha.withColumn("band", F.col("band").cast("int")))


def stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    v = F.when(~F.isnan("v"), F.col("v"))
    return df.groupBy(*(by or [])).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), (F.count(v) * 100.0 / F.count("*")).alias("valid_percent"))


def info(r) -> dict:  # noqa: ANN001
    """Size, extent and statistics of each band of a raster."""
    x0, dx, _, y0, _, dy = r.gt
    xs, ys = sorted((x0, x0 + r.width * dx)), sorted((y0, y0 + r.height * dy))
    found = stats(r.df, ["band"]).orderBy("band").collect()
    return {"width": r.width, "height": r.height, "bands": r.bands, "dtype": r.dtype, "crs": r.crs, "nodata": r.nodata, "gt": list(r.gt), "extent": [xs[0], ys[0], xs[1], ys[1]], "statistics": [x.asDict() for x in found]}


def histogram(df: DataFrame, low: float, high: float, buckets: int = 256) -> DataFrame:
    place = F.floor((F.col("v") - low) * buckets / (high - low)).cast("int")
    return df.filter("v is not null").groupBy(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), place)).alias("bucket")).agg(F.count("*").alias("n"))


def checksum(df: DataFrame, width: int) -> DataFrame:
    """Sum of the values modulo a cycle of primes in scan order, in 16 bits. Values are rounded half up first."""
    v = F.greatest(F.lit(-2147483647), F.least(F.lit(2147483647), F.floor(F.col("v") + 0.5).cast("bigint")))
    place = (F.col("row").cast("bigint") * width + F.col("col")) % len(PRIMES)
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (place + 1).cast("int"))
    return df.agg(F.sum(v % prime).bitwiseAND(F.lit(65535)).cast("bigint").alias("checksum"))


def approx_stats(df: DataFrame, block_rows: int, step: int) -> DataFrame:
    """Statistics of every step-th block of rows."""
    return stats(df.filter(F.floor(F.col("row") / block_rows) % step == 0))


def create(spark, width: int, height: int, bands: int = 1, burn: float | None = None) -> DataFrame:  # noqa: ANN001
    cell = F.col("id") % (width * height)
    return spark.range(width * height * bands).select((F.col("id") / (width * height)).cast("int").alias("band0"), (cell / width).cast("int").alias("row"), (cell % width).cast("int").alias("col"), F.lit(burn).cast("double").alias("v")).select((F.col("band0") + 1).alias("band"), "row", "col", "v")


def clip(df: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    inside = df.filter(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
    return inside.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def color_map(v: Column, stops: list[tuple[float, tuple[int, ...]]], mode: str = "interpolate") -> Column:
    """Value to array of colour components by breakpoints: interpolate, nearest or exact (null if none)."""
    stops = sorted(stops)
    color = lambda c: F.array(*[F.lit(x) for x in c])
    if mode == "exact":
        out = F.when(v == stops[0][0], color(stops[0][1]))
        for s, c in stops[1:]:
            out = out.when(v == s, color(c))
        return out
    out = F.when(v <= stops[0][0], color(stops[0][1]))
    for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False):
        if mode == "nearest":
            out = out.when(v <= (a + b) / 2, color(ca)).when(v <= b, color(cb))
        else:
            part = (v - a) / (b - a)
            out = out.when(v <= b, F.array(*[F.floor(F.lit(float(x)) + (float(y) - float(x)) * part + 0.5).cast("int") for x, y in zip(ca, cb, strict=True)]))
    return F.when(v.isNotNull(), out.otherwise(color(stops[-1][1])))


#: Blend operators of two 0..255 components, in integers.
BLEND = {
    "src_over": lambda a, b: b,
    "multiply": lambda a, b: F.call_function("div", a * b + 127, F.lit(255)),
    "screen": lambda a, b: a + b - F.call_function("div", a * b + 127, F.lit(255)),
    "overlay": lambda a, b: F.when(a < 128, F.call_function("div", 2 * a * b + 127, F.lit(255))).otherwise(255 - F.call_function("div", 2 * (255 - a) * (255 - b) + 127, F.lit(255))),
    "hard_light": lambda a, b: F.when(b < 128, F.call_function("div", 2 * a * b + 127, F.lit(255))).otherwise(255 - F.call_function("div", 2 * (255 - a) * (255 - b) + 127, F.lit(255))),
    "darken": lambda a, b: F.least(a, b),
    "lighten": lambda a, b: F.greatest(a, b),
    "add": lambda a, b: F.least(F.lit(255), a + b),
    "color_dodge": lambda a, b: F.when(b >= 255, F.when(a == 0, 0).otherwise(255)).otherwise(F.least(F.lit(255), F.call_function("div", a * 255, F.greatest(F.lit(1), 255 - b)))),
    "color_burn": lambda a, b: F.when(b == 0, F.when(a == 255, 255).otherwise(0)).otherwise(255 - F.least(F.lit(255), F.call_function("div", (255 - a) * 255, F.greatest(F.lit(1), b)))),
}


def blend(base: DataFrame, overlay: DataFrame, operator: str, opacity: int = 255) -> DataFrame:
    """Composes byte rasters; opacity 0..255 is the overlay's weight."""
    joined = base.select(*CELL, F.col("v").cast("long").alias("a")).join(overlay.select(*CELL, F.col("v").cast("long").alias("b")), CELL, "left")
    mixed = BLEND[operator](F.col("a"), F.col("b"))
    out = F.call_function("div", F.col("a") * (255 - opacity) + mixed * opacity + 127, F.lit(255))
    return joined.select(*CELL, F.when(F.col("b").isNull(), F.col("a")).otherwise(out).cast("double").alias("v"))


def pansharpen(pan: DataFrame, spectral: list[DataFrame], weights: list[float], factor: int = 1) -> DataFrame:
    """Weighted Brovey: each spectral band, taken up to the pan grid by `factor`, times pan / weighted sum."""
    out = pan.select("row", "col", F.col("v").alias("pan"), F.expr(f"row div {factor}").cast("int").alias("r"), F.expr(f"col div {factor}").cast("int").alias("c"))
    for k, s in enumerate(spectral):
        out = out.join(s.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("v").alias(f"s{k}")), ["r", "c"])
    pseudo = reduce(lambda a, b: a + b, [F.col(f"s{k}") * w for k, w in enumerate(weights)])
    ratio = F.when(pseudo != 0, F.col("pan") / F.when(pseudo != 0, pseudo)).otherwise(0.0)
    bands = F.posexplode(F.array(*[F.col(f"s{k}") * ratio for k in range(len(spectral))])).alias("band", "v")
    return out.select("row", "col", bands).select((F.col("band") + 1).alias("band"), "row", "col", "v")


def color_histogram(df: DataFrame, bits: int = 5) -> DataFrame:
    """Counts of (r, g, b) cut to `bits` bits: at most 2**(3 bits) rows."""
    cut = [F.shiftright(F.col(c).cast("int"), 8 - bits).alias(c) for c in "rgb"]
    return df.select(*cut).groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def median_cut(histogram: list[tuple[int, int, int, int]], colors: int, bits: int = 5) -> list[tuple[int, int, int]]:
    """A palette: boxes of the colour histogram are split at the median of their longest side, the fullest first."""
    boxes, step = [list(histogram)], 1 << (8 - bits)
    while len(boxes) < colors:
        able = [b for b in boxes if len(b) > 1]
        if not able:
            break
        box = max(able, key=lambda b: sum(x[3] for x in b))
        boxes.remove(box)
        axis = max(range(3), key=lambda a: max(x[a] for x in box) - min(x[a] for x in box))
        box.sort(key=lambda x: (x[axis], x))
        half, seen, at = sum(x[3] for x in box) / 2, 0, 0
        while at < len(box) - 1 and seen + box[at][3] <= half:
            seen += box[at][3]
            at += 1
        boxes += [box[: max(at, 1)], box[max(at, 1) :]]
    return [tuple(int(sum((x[a] + 0.5) * step * x[3] for x in b) / sum(x[3] for x in b)) for a in range(3)) for b in boxes]


def rgb_to_palette(df: DataFrame, colors: int = 256, bits: int = 5) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Cells (row, col, r, g, b) as palette indexes, and the palette: the nearest colour, the first among equals."""
    palette = median_cut([tuple(r) for r in color_histogram(df, bits).collect()], colors, bits)
    far = F.array(*[F.struct(((F.col("r") - p[0]) * (F.col("r") - p[0]) + (F.col("g") - p[1]) * (F.col("g") - p[1]) + (F.col("b") - p[2]) * (F.col("b") - p[2])).alias("d"), F.lit(k).alias("k")) for k, p in enumerate(palette)])
    return df.select("row", "col", F.array_min(far)["k"].alias("v")), palette


def with_row_window(order: str = "col") -> Window:
    return Window.partitionBy("band", "row" if order == "col" else "col").orderBy(order)


def calc_expression(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """An infix expression over columns that hold the bands of a cell: v."""
    from geoloom.functions.expression import expression

    return df.withColumn("v", expression(text, {c: F.col(c).cast("double") for c in columns}))


def edit(raster, **changes):  # noqa: ANN001, ANN003, ANN201
    """Overrides of what is said about a raster (crs, gt, nodata, dtype, metadata); the cells stay."""
    return raster.with_df(raster.df, **changes)


def index(rasters: list[tuple[str, object]], spark) -> DataFrame:  # noqa: ANN001
    """A tile index: location, crs and extent of each raster, from what is said about it."""
    rows = []
    for location, r in rasters:
        x0, dx, _, y0, _, dy = r.gt
        xs, ys = sorted((x0, x0 + r.width * dx)), sorted((y0, y0 + r.height * dy))
        rows.append((location, r.crs, float(xs[0]), float(ys[0]), float(xs[1]), float(ys[1])))
    return spark.createDataFrame(rows, "location string, crs string, xmin double, ymin double, xmax double, ymax double")

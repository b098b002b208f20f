"""Neighbourhood operators over cells (band, row, col, v).

Terrain verbs see the 3 x 3 window of a cell: beyond the edge a value is mirrored (2 p - q), a null neighbour is
replaced by the centre, and a null centre gives null. The nine values come by two window functions: left and right
within the row, then above and below for the three of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPS = ["nw", "n", "ne", "w", "c", "e", "sw", "s", "se"]


def window3(df: DataFrame) -> DataFrame:
    """band, row, col and the nine taps; missing neighbours mirrored, then nulls replaced by the centre."""
    by_row = Window.partitionBy("band", "row").orderBy("col")
    by_col = Window.partitionBy("band", "col").orderBy("row")
    some = lambda v: F.struct(v.alias("v"))  # a null inside differs from no row at all
    rows = df.select("band", "row", "col", some(F.col("v")).alias("c")).withColumns({"l": F.lag("c").over(by_row), "r": F.lead("c").over(by_row)})
    both = rows.withColumns({"t": F.struct("l", "c", "r")}).withColumns({"u": F.lag("t").over(by_col), "d": F.lead("t").over(by_col)})
    v = lambda row, side: F.col(f"{row}.{side}.v")
    centre = v("t", "c")

    def line(row: str) -> list[Column]:
        mid = v(row, "c")
        left = F.when(F.col(f"{row}.l").isNull(), 2 * mid - v(row, "r")).otherwise(v(row, "l"))
        right = F.when(F.col(f"{row}.r").isNull(), 2 * mid - v(row, "l")).otherwise(v(row, "r"))
        return [left, mid, right]

    # Each step is a projection of its own: its columns are used several times in the next.
    sides = both.select("band", "row", "col", centre.alias("c"), F.col("u").isNull().alias("top"), F.col("d").isNull().alias("bottom"), *[x.alias(f"{r}{k}") for r in "utd" for k, x in enumerate(line(r))])
    u, m, d = ([F.col(f"{r}{k}") for k in range(3)] for r in "utd")
    up = [F.when(F.col("top"), 2 * b - c).otherwise(a) for a, b, c in zip(u, m, d, strict=True)]
    down = [F.when(F.col("bottom"), 2 * b - a).otherwise(c) for a, b, c in zip(u, m, d, strict=True)]
    taps = sides.select("band", "row", "col", "c", *[t.alias(f"x_{n}") for n, t in zip(TAPS, [*up, *m, *down], strict=True)])
    return taps.select("band", "row", "col", *[F.when(F.col("c").isNotNull(), F.coalesce(f"x_{n}", "c")).alias(n) for n in TAPS])


def _gradient(algorithm: str, dx: float, dy: float, z: float) -> tuple[Column, Column]:
    """Rise to the east and to the south, per unit."""
    c = {n: F.col(n) for n in TAPS}
    if algorithm == "horn":
        gx = (c["ne"] + 2 * c["e"] + c["se"]) - (c["nw"] + 2 * c["w"] + c["sw"])
        gy = (c["sw"] + 2 * c["s"] + c["se"]) - (c["nw"] + 2 * c["n"] + c["ne"])
        return gx * (z / (8 * dx)), gy * (z / (8 * dy))
    return (c["e"] - c["w"]) * (z / (2 * dx)), (c["s"] - c["n"]) * (z / (2 * dy))


def slope(df: DataFrame, dx: float = 1.0, dy: float = 1.0, z: float = 1.0, percent: bool = False, algorithm: str = "horn") -> DataFrame:
    gx, gy = _gradient(algorithm, dx, dy, z)
    rise = F.sqrt(gx * gx + gy * gy)
    return window3(df).select("band", "row", "col", (100 * rise if percent else F.degrees(F.atan(rise))).alias("v"))


def aspect(df: DataFrame, trigonometric: bool = False, zero_for_flat: bool = False, algorithm: str = "horn") -> DataFrame:
    """Direction of descent: degrees from north clockwise, or from east counter-clockwise; flat: -9999 or 0."""
    gx, gy = _gradient(algorithm, 1.0, 1.0, 1.0)
    angle = F.degrees(F.atan2(gy, -gx))
    if trigonometric:
        out = F.when(angle < 0, angle + 360).otherwise(angle)
    else:
        turned = F.when(angle > 90, 450 - angle).otherwise(90 - angle)
        out = F.when(turned == 360, 0.0).otherwise(turned)
    return window3(df).select("band", "row", "col", F.when((gx == 0) & (gy == 0), F.lit(0.0 if zero_for_flat else -9999.0)).otherwise(out).alias("v"))


def hillshade(df: DataFrame, dx: float = 1.0, dy: float = 1.0, z: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, variant: str = "regular", algorithm: str = "horn") -> DataFrame:
    """1 + 254 x shade, rounded to a byte. variant: regular, combined, igor, multidirectional."""
    gx, gy = _gradient(algorithm, dx, dy, z)
    steep = gx * gx + gy * gy
    alt = math.radians(altitude)

    def shade(az: float) -> Column:
        a = math.radians(az)
        # Light from azimuth az: the surface normal is (-gx, gy, 1) east, north, up.
        return (math.sin(alt) + math.cos(alt) * (math.sin(a) * -gx + math.cos(a) * gy)) / F.sqrt(1 + steep)

    if variant == "combined":
        lit = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shade(azimuth)))) * F.atan(F.sqrt(steep)) / (math.pi * math.pi / 4)
    elif variant == "igor":
        facing = F.atan2(-gx, gy)
        turn = F.abs(facing - math.radians(azimuth))
        turn = F.pmod(turn, F.lit(2 * math.pi))
        turn = F.when(turn > math.pi, 2 * math.pi - turn).otherwise(turn)
        lit = 1 - F.atan(F.sqrt(steep)) / (math.pi / 2) * (turn / math.pi)
    elif variant == "multidirectional":
        weights = [(225.0, gx * gx), (270.0, gx * gx), (315.0, gy * gy), (360.0, gy * gy)]
        total = reduce(lambda a, b: a + b, [w for _, w in weights])
        mean = reduce(lambda a, b: a + b, [F.greatest(F.lit(0.0), shade(az)) * w for az, w in weights])
        lit = F.when(total > 0, mean / F.when(total > 0, total)).otherwise(F.lit(math.sin(alt)))
    else:
        lit = shade(azimuth)
    return window3(df).select("band", "row", "col", F.floor(1 + 254 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit)) + 0.5).alias("v"))


def roughness(df: DataFrame) -> DataFrame:
    return window3(df).select("band", "row", "col", (F.greatest(*TAPS) - F.least(*TAPS)).alias("v"))


def _around() -> list[Column]:
    return [F.col(n) for n in TAPS if n != "c"]


def tpi(df: DataFrame) -> DataFrame:
    return window3(df).select("band", "row", "col", (F.col("c") - reduce(lambda a, b: a + b, _around()) / 8).alias("v"))


def tri(df: DataFrame, algorithm: str = "riley") -> DataFrame:
    d = [x - F.col("c") for x in _around()]
    out = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in d])) if algorithm == "riley" else reduce(lambda a, b: a + b, [F.abs(x) for x in d]) / 8
    return window3(df).select("band", "row", "col", out.alias("v"))


#: Named kernels.
KERNELS = {
    "edge1": [[0, -1, 0], [-1, 4, -1], [0, -1, 0]],
    "edge2": [[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]],
    "sharpen": [[0, -1, 0], [-1, 5, -1], [0, -1, 0]],
    "u": [[1, 2, 1], [0, 0, 0], [-1, -2, -1]],
    "v": [[1, 0, -1], [2, 0, -2], [1, 0, -1]],
    "equal": [[1, 1, 1], [1, 1, 1], [1, 1, 1]],
    "gaussian": [[1, 2, 1], [2, 4, 2], [1, 2, 1]],
    "gaussian5": [[1, 4, 6, 4, 1], [4, 16, 24, 16, 4], [6, 24, 36, 24, 6], [4, 16, 24, 16, 4], [1, 4, 6, 4, 1]],
    "unsharp-masking": [[1, 4, 6, 4, 1], [4, 16, 24, 16, 4], [6, 24, -476, 24, 6], [4, 16, 24, 16, 4], [1, 4, 6, 4, 1]],
}


def neighbors(df: DataFrame, kernel: str | list[list[float]], method: str = "mean", height: int | None = None, width: int | None = None) -> DataFrame:
    """Focal statistic: taps beyond the edge are those of the edge, null taps and zero coefficients are left out.

    Every cell is sent to the cells that see it, and what arrives is aggregated (sums combine before the shuffle).
    """
    k = KERNELS[kernel] if isinstance(kernel, str) else kernel
    reach = len(k) // 2
    if height is None or width is None:
        height, width = (x + 1 for x in df.agg(F.max("row"), F.max("col")).first())
    # A cell at the edge also stands for those beyond it.
    taps = F.explode(F.array(*[F.struct(F.lit(i - reach).alias("dr"), F.lit(j - reach).alias("dc"), F.lit(float(w)).alias("w")) for i, row in enumerate(k) for j, w in enumerate(row) if w]))
    span = lambda c, n: F.when(F.col(c) == 0, F.sequence(F.lit(-reach), F.lit(0 if n > 1 else reach))).when(F.col(c) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + reach))).otherwise(F.array(F.col(c).cast("int")))
    seen = df.filter("v is not null").withColumn("er", F.explode(span("row", height))).withColumn("ec", F.explode(span("col", width)))
    sent = seen.select("band", "er", "ec", "v", taps.alias("t")).select("band", (F.col("er") - F.col("t.dr")).alias("row"), (F.col("ec") - F.col("t.dc")).alias("col"), "v", F.col("t.w").alias("w"))
    sent = sent.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    x = F.col("v") * F.col("w")
    agg = {
        "sum": F.sum(x), "mean": F.sum(x) / F.when(F.sum("w") != 0, F.sum("w")).otherwise(1.0), "min": F.min(x), "max": F.max(x),
        "stddev": F.stddev_pop(x), "median": F.percentile(x, F.lit(0.5)), "mode": F.mode(x),
    }[method]
    found = sent.groupBy("band", "row", "col").agg(agg.alias("out"))
    return df.select("band", "row", "col", "v").join(found, ["band", "row", "col"], "left").select("band", "row", "col", F.when(F.col("v").isNotNull(), F.col("out")).alias("v"))

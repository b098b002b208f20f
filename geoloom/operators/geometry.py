"""Geometry verbs over layers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g

RADIUS = 6378137.0


def _number(df: DataFrame, name: str) -> Column:
    """A field as a coordinate; strings must be numbers."""
    return F.col(name).cast("double")


def make_point(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Points from fields: geom and env, built by the JVM."""
    cx, cy = _number(df, x), _number(df, y)
    env = F.struct(cx.alias("xmin"), cy.alias("ymin"), cx.alias("xmax"), cy.alias("ymax"))
    return df.withColumns({"geom": g.point_wkb(cx, cy, _number(df, z) if z else None), "env": F.when(cx.isNotNull() & cy.isNotNull(), env)})


def make_rectangle(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    big = lambda c: F.unhex(F.lpad(F.hex(g._bits(c.cast("double"))), 16, "0"))
    ring = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    wkb = F.concat(F.unhex(F.lit("00000000030000000100000005")), *[big(c) for p in ring for c in p])
    return df.withColumns({"geom": wkb, "env": F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))})


def swap_xy(df: DataFrame) -> DataFrame:
    out = df.withColumn("geom", g.geometry_udf(lambda x: g.map_vertices(x, lambda p: [p[1], p[0], *p[2:]]), "binary")("geom"))
    e = "env"
    return out.withColumn(e, F.struct(F.col("env.ymin").alias("xmin"), F.col("env.xmin").alias("ymin"), F.col("env.ymax").alias("xmax"), F.col("env.xmax").alias("ymax"))) if e in df.columns else out


def area(geom: Column) -> Column:
    return g.geometry_udf(g.area, "double")(geom)


def segmentize_segments(df: DataFrame, max_length: float) -> DataFrame:
    """Segments (x, y) - (x2, y2) as their first point and those put in between: k, x, y."""
    d2 = F.pow(F.col("x2") - F.col("x"), F.lit(2)) + F.pow(F.col("y2") - F.col("y"), F.lit(2))
    n = F.greatest(F.floor(F.sqrt(d2 / (max_length * max_length)) - 0.01), F.lit(0)).cast("int")
    out = df.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = F.col("k") / (F.col("n") + 1)
    return out.withColumns({"x": F.col("x") + (F.col("x2") - F.col("x")) * part, "y": F.col("y") + (F.col("y2") - F.col("y")) * part})


def _dense(c: list, max_length: float) -> list:
    out = []
    for a, b in zip(c, c[1:], strict=False):
        flip = tuple(b[:2]) < tuple(a[:2])  # both directions of a shared edge give the same points
        p, q = (b, a) if flip else (a, b)
        n = max(0, math.floor(math.sqrt(((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) / max_length**2) - 0.01))
        inner = [[p[0] + (q[0] - p[0]) * k / (n + 1), p[1] + (q[1] - p[1]) * k / (n + 1), *a[2:]] for k in range(1, n + 1)]
        out += [a, *(inner[::-1] if flip else inner)]
    return out + c[-1:]


def segmentize(df: DataFrame, max_length: float) -> DataFrame:
    def run(x: g.Geometry) -> g.Geometry:
        kind, c = x
        if kind == 2:
            return 2, _dense(c, max_length)
        if kind in (3, 5):
            return kind, [_dense(r, max_length) for r in c]
        if kind == 6:
            return 6, [[_dense(r, max_length) for r in p] for p in c]
        return (7, [run(m) for m in c]) if kind == 7 else x

    return df.withColumn("geom", g.geometry_udf(run, "binary")("geom"))


def explode_collections(df: DataFrame) -> DataFrame:
    """One row per member: pos, geom, env; other fields as they are."""
    split = g.geometry_udf(lambda x: [g.to_wkb(m) for m in g.members(x)], "array<binary>")
    out = df.withColumn("__parts", split("geom")).select(*[c for c in df.columns if c not in ("geom", "env")], F.posexplode_outer("__parts").alias("pos", "geom"))
    return out.withColumn("env", g.env_of(F.col("geom")))


def set_geom_type(df: DataFrame, target: str, skip: bool = False) -> DataFrame:
    """Forces the geometry type; rows that can't take it stay as they are, or go."""
    out = df.withColumn("__g", g.geometry_udf(lambda x: g.force_to(x, target), "binary")("geom"))
    if skip:
        out = out.filter(F.col("__g").isNotNull() | F.col("geom").isNull())
    return out.withColumn("geom", F.coalesce("__g", "geom")).drop("__g")


def _utm(zone: int, south: bool) -> tuple[Callable, Callable]:
    """Krueger series to the sixth order, as columns."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Series coefficients in the third flattening.
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    be = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    de = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    k0, e0, n0, lon0 = 0.9996, 500000.0, 1e7 if south else 0.0, math.radians(zone * 6 - 183)
    c = 2 * math.sqrt(n) / (1 + n)

    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        la, dl = F.radians(lat), F.radians(lon) - lon0
        t = F.sinh(F.atanh(F.sin(la)) - c * F.atanh(c * F.sin(la)))
        xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, a in enumerate(al, 1):
            x, y = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta), y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return e0 + k0 * big * x, n0 + k0 * big * y

    def inverse(east: Column, north: Column) -> tuple[Column, Column]:
        xi, eta = (north - n0) / (k0 * big), (east - e0) / (k0 * big)
        x, y = xi, eta
        for j, b in enumerate(be, 1):
            x, y = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta), y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(x) / F.cosh(y))
        lat = chi
        for j, d in enumerate(de, 1):
            lat = lat + d * F.sin(2 * j * chi)
        return F.degrees(lon0 + F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)

    return forward, inverse


def _mercator() -> tuple[Callable, Callable]:
    return (
        lambda lon, lat: (F.radians(lon) * RADIUS, RADIUS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))),
        lambda x, y: (F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)),
    )


def _crs(name: str) -> tuple[Callable, Callable]:
    """To and from geographic coordinates. Known: EPSG:4326, OGC:CRS84, EPSG:3857, EPSG:326zz and 327zz."""
    code = name.upper()
    if code in ("EPSG:4326", "OGC:CRS84"):
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if code == "EPSG:3857":
        return _mercator()
    if code[:8] in ("EPSG:326", "EPSG:327") and 1 <= int(code[8:]) <= 60:
        return _utm(int(code[8:]), code[:8] == "EPSG:327")
    raise ValueError(f"unknown CRS {name}")


def transform(source: str, target: str) -> Callable[[Column, Column], tuple[Column, Column]]:
    inverse, forward = _crs(source)[1], _crs(target)[0]
    return lambda x, y: forward(*inverse(x, y))


def vertices(df: DataFrame) -> DataFrame:
    """fid, seq, x, y of every vertex, by Arrow."""
    flat = g.geometry_udf(lambda x: [v for p in g.vertices(x) for v in p[:2]], "array<double>")
    xy = F.col("xy")
    out = df.select("fid", flat("geom").alias("xy"))
    return out.select("fid", F.posexplode(F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(xy), F.lit(2)).cast("int") - 1), lambda k: F.struct(F.get(xy, 2 * k).alias("x"), F.get(xy, 2 * k + 1).alias("y")))).alias("seq", "p")).select("fid", "seq", "p.*")


def clip(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features that meet the rectangle, cut by it."""
    x0, y0, x1, y1 = box
    near = df.filter((F.col("env.xmin") <= x1) & (F.col("env.xmax") >= x0) & (F.col("env.ymin") <= y1) & (F.col("env.ymax") >= y0))
    out = near.withColumn("geom", g.geometry_udf(lambda x: g.clip(x, box), "binary")("geom")).filter("geom is not null")
    return out.withColumn("env", g.env_of(F.col("geom")))


def convex_hull(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", g.geometry_udf(g.convex_hull, "binary")("geom"))


def simplify(df: DataFrame, tolerance: float) -> DataFrame:
    return df.withColumn("geom", g.geometry_udf(lambda x: g.simplify(x, tolerance), "binary")("geom"))


def check_geometry(df: DataFrame) -> DataFrame:
    """fid and problem of the geometries that are not valid."""
    return df.select("fid", g.geometry_udf(g.problems, "string")("geom").alias("problem")).filter("problem is not null")


def buffer_point(df: DataFrame, distance: float, segments: int = 8) -> DataFrame:
    """Points as polygons around them."""

    def run(x: g.Geometry) -> g.Geometry | None:
        if x[0] != 1 or not x[1]:
            return None
        n = 4 * segments
        ring = [[x[1][0] + distance * math.cos(2 * math.pi * k / n), x[1][1] + distance * math.sin(2 * math.pi * k / n)] for k in range(n)]
        return 3, [[*ring, ring[0]]]

    return df.withColumn("geom", g.geometry_udf(run, "binary")("geom"))



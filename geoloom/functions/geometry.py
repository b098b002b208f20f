"""WKB and WKT codecs and measures over nested coordinate lists, and the column forms built on them.

A geometry is (type, coordinates): point (x, y[, z]); line and ring lists of points; polygons lists of rings; collections
lists of geometries.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v.upper(): k for k, v in NAMES.items()}
Geometry = tuple[int, list]


def to_wkb(g: Geometry) -> bytes:
    kind, c = g
    dims = _dims(g)
    code = kind + (1000 if dims == 3 else 0)
    head = struct.pack("<BI", 1, code)
    if kind == 1:
        return head + struct.pack(f"<{dims}d", *(c if c else [math.nan] * dims))
    if kind == 2:
        return head + struct.pack("<I", len(c)) + b"".join(struct.pack(f"<{dims}d", *p[:dims]) for p in c)
    if kind == 3:
        return head + struct.pack("<I", len(c)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack(f"<{dims}d", *p[:dims]) for p in r) for r in c)
    members = [(kind - 3, x) for x in c] if kind < 7 else c
    return head + struct.pack("<I", len(members)) + b"".join(to_wkb(m) for m in members)


def from_wkb(raw: bytes) -> Geometry:
    return _read(raw, 0)[0]


def _read(raw: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if raw[at] else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    dims = 2 + bool(code & 0x80000000 or code % 10000 // 1000 in (1, 3)) + bool(code & 0x40000000 or code % 10000 // 1000 in (2, 3))
    kind = (code & 0x0FFFFFFF) % 1000
    at += 5

    def points(at: int) -> tuple[list, int]:
        n = struct.unpack_from(order + "I", raw, at)[0]
        flat = struct.unpack_from(f"{order}{n * dims}d", raw, at + 4)
        return [list(flat[k * dims : (k + 1) * dims]) for k in range(n)], at + 4 + n * dims * 8

    if kind == 1:
        p = list(struct.unpack_from(f"{order}{dims}d", raw, at))
        return (1, [] if math.isnan(p[0]) else p), at + 8 * dims
    if kind == 2:
        c, at = points(at)
        return (2, c), at
    n = struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    out = []
    for _ in range(n):
        if kind == 3:
            ring, at = points(at)
            out.append(ring)
        else:
            member, at = _read(raw, at)
            out.append(member if kind == 7 else member[1])
    return (kind, out), at


def vertices(g: Geometry) -> Iterator[list[float]]:
    kind, c = g
    if kind == 1:
        if c:
            yield c
    elif kind in (2, 4):
        yield from c
    elif kind in (3, 5):
        for r in c:
            yield from r
    elif kind == 6:
        for p in c:
            for r in p:
                yield from r
    else:
        for m in c:
            yield from vertices(m)


def _dims(g: Geometry) -> int:
    return max((min(len(p), 3) for p in vertices(g)), default=2)


def map_vertices(g: Geometry, fn: Callable[[list[float]], list[float]]) -> Geometry:
    def deep(x: list, level: int) -> list:
        return fn(x) if level == 0 else [deep(y, level - 1) for y in x]

    kind, c = g
    if kind == 7:
        return kind, [map_vertices(m, fn) for m in c]
    return kind, (deep(c, {1: 0, 2: 1, 4: 1, 3: 2, 5: 2, 6: 3}[kind]) if c else c)


def envelope(g: Geometry) -> tuple[float, float, float, float] | None:
    pts = list(vertices(g))
    if not pts:
        return None
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def _ring_area(r: list) -> float:
    return 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) if r else 0.0


def area(g: Geometry) -> float:
    kind, c = g
    if kind == 3:
        return abs(_ring_area(c[0])) - sum(abs(_ring_area(r)) for r in c[1:]) if c else 0.0
    if kind == 6:
        return sum(area((3, p)) for p in c)
    return sum(area(m) for m in c) if kind == 7 else 0.0


def _num(v: float) -> str:
    return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def to_wkt(g: Geometry) -> str:
    kind, c = g
    point = lambda p: " ".join(_num(v) for v in p)
    seq = lambda ps: "(" + ",".join(point(p) for p in ps) + ")"
    name = NAMES[kind].upper() + (" Z" if _dims(g) == 3 else "")
    if not c:
        return name + " EMPTY"
    if kind == 1:
        return f"{name} ({point(c)})"
    if kind == 2:
        return f"{name} {seq(c)}"
    if kind == 4:
        return f"{name} ({','.join('(' + point(p) + ')' for p in c)})"
    if kind in (3, 5):
        return f"{name} ({','.join(seq(r) for r in c)})"
    if kind == 6:
        return f"{name} ({','.join('(' + ','.join(seq(r) for r in p) + ')' for p in c)})"
    return f"{name} ({','.join(to_wkt(m) for m in c)})"


def from_geojson(x: dict | None) -> Geometry | None:
    if not x:
        return None
    if x["type"] == "GeometryCollection":
        return 7, [from_geojson(m) for m in x["geometries"]]
    return CODES[x["type"].upper()], x["coordinates"]


def to_geojson(g: Geometry) -> dict:
    kind, c = g
    return {"type": NAMES[kind], "geometries": [to_geojson(m) for m in c]} if kind == 7 else {"type": NAMES[kind], "coordinates": c}


def members(g: Geometry) -> list[Geometry]:
    kind, c = g
    return [(kind - 3, x) for x in c] if 4 <= kind <= 6 else list(c) if kind == 7 else [g]


def force_to(g: Geometry, target: str) -> Geometry | None:
    """A geometry as another type: multi to single (of one member), single to multi, polygon to lines; None if it can't be."""
    want = CODES[target.upper()]
    kind, c = g
    if kind == want:
        return g
    if want == 7:
        return 7, members(g)
    if want in (4, 5, 6):
        if kind == want - 3:
            return want, [c]
        if kind == 7 and all(m[0] == want - 3 for m in c):
            return want, [m[1] for m in c]
        if want == 5 and kind == 3:
            return 5, c
    if kind in (4, 5, 6) and want == kind - 3 and len(c) == 1:
        return want, c[0]
    if want == 2 and kind == 3 and len(c) == 1:
        return 2, c[0]
    if want == 3 and kind == 2 and len(c) >= 4 and c[0] == c[-1]:
        return 3, [c]
    return None


def convex_hull(g: Geometry) -> Geometry:
    """Monotone chain."""
    pts = sorted({(p[0], p[1]) for p in vertices(g)})
    if len(pts) < 3:
        return (1, list(pts[0])) if len(pts) == 1 else (2, [list(p) for p in pts])

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ring = half(pts)[:-1] + half(pts[::-1])
    return 3, [[list(p) for p in ring]]


def simplify_line(c: list, tolerance: float) -> list:
    """Douglas-Peucker, without recursion."""
    if len(c) < 3:
        return c
    keep, todo = {0, len(c) - 1}, [(0, len(c) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = c[a][:2], c[b][:2]
        length = math.hypot(x1 - x0, y1 - y0)
        best, at = -1.0, -1
        for k in range(a + 1, b):
            x, y = c[k][:2]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if d > best:
                best, at = d, k
        if best > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [c[k] for k in sorted(keep)]


def simplify(g: Geometry, tolerance: float) -> Geometry:
    kind, c = g
    if kind == 2:
        return 2, simplify_line(c, tolerance)
    if kind in (3, 5):
        return kind, [simplify_line(r, tolerance) if len(r) > 4 else r for r in c]
    if kind == 6:
        return 6, [simplify((3, p), tolerance)[1] for p in c]
    return (7, [simplify(m, tolerance) for m in c]) if kind == 7 else g


def clip_ring(ring: list, box: tuple[float, float, float, float]) -> list:
    """Sutherland-Hodgman against a rectangle; the ring is closed again."""
    pts = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for k, p in enumerate(pts):
            q = pts[k - 1]
            p_in, q_in = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if p_in != q_in:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                out.append([a + t * (b - a) for a, b in zip(q, p, strict=True)])
            if p_in:
                out.append(p)
        pts = out
    return [*pts, pts[0]] if pts else []


def clip(g: Geometry, box: tuple[float, float, float, float]) -> Geometry | None:
    """Points and polygons within a rectangle; lines keep the parts of their segments inside."""
    kind, c = g
    if kind == 1:
        return g if c and box[0] <= c[0] <= box[2] and box[1] <= c[1] <= box[3] else None
    if kind == 3:
        rings = [r for r in (clip_ring(r, box) for r in c) if len(r) > 3]
        return (3, rings) if rings else None
    if kind == 2:
        parts: list[list] = []
        for a, b in zip(c, c[1:], strict=False):
            t0, t1 = 0.0, 1.0
            for axis, low, high in ((0, box[0], box[2]), (1, box[1], box[3])):
                d = b[axis] - a[axis]
                if d == 0:
                    if not low <= a[axis] <= high:
                        t1 = -1.0
                else:
                    u, v = sorted(((low - a[axis]) / d, (high - a[axis]) / d))
                    t0, t1 = max(t0, u), min(t1, v)
            if t0 <= t1:
                p, q = ([x + t * (y - x) for x, y in zip(a, b, strict=True)] for t in (t0, t1))
                if parts and parts[-1][-1] == p:
                    parts[-1].append(q)
                else:
                    parts.append([p, q])
        return None if not parts else (2, parts[0]) if len(parts) == 1 else (5, parts)
    inner = [m for m in (clip(m, box) for m in members(g)) if m]
    return (7, inner) if inner else None


def problems(g: Geometry) -> str | None:
    """Why a geometry is not valid, as far as rings go."""
    kind, c = g
    if kind == 3:
        for r in c:
            if len(r) < 4:
                return "a ring has less than four points"
            if r[0] != r[-1]:
                return "a ring isn't closed"
            for i in range(len(r) - 1):
                for j in range(i + 2, len(r) - 1):
                    if not (i == 0 and j == len(r) - 2) and _cross(r[i], r[i + 1], r[j], r[j + 1]):
                        return "a ring crosses itself"
        return None
    if kind == 2:
        return "a line has less than two points" if len(c) == 1 else None
    return next((p for p in (problems(m) for m in members(g)) if p), None) if kind > 3 else None


def _cross(a: list, b: list, c: list, d: list) -> bool:
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


# --- columns ---


def point_wkb(x: Column, y: Column, z: Column | None = None) -> Column:
    """WKB of a point, built by the JVM: the eight bytes of a double are those of its bit pattern."""
    big = lambda c: F.unhex(F.lpad(F.hex(_bits(c)), 16, "0"))
    head = F.unhex(F.lit("0000000001" if z is None else "00000003E9"))  # big-endian
    return F.concat(head, big(x), big(y), *([] if z is None else [big(z)]))


def line_wkb(points: list[tuple[Column, Column]]) -> Column:
    """WKB of a line, built by the JVM."""
    return F.concat(F.unhex(F.lit(f"0000000002{len(points):08X}")), *[_big(c) for p in points for c in p])


def polygon_wkb(ring: list[tuple[Column, Column]]) -> Column:
    """WKB of a polygon of one closed ring, built by the JVM."""
    return F.concat(F.unhex(F.lit(f"000000000300000001{len(ring):08X}")), *[_big(c) for p in ring for c in p])


def multipoint_wkb(points: list[tuple[Column, Column]]) -> Column:
    return F.concat(F.unhex(F.lit(f"0000000004{len(points):08X}")), *[point_wkb(x.cast("double"), y.cast("double")) for x, y in points])


def _big(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(_bits(c.cast("double"))), 16, "0"))


def _bits(c: Column) -> Column:
    """IEEE bits of a double, as the JVM has them."""
    return F.when(c.isNotNull(), F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c).cast("bigint"))


def geometry_udf(fn: Callable[[Geometry], object], kind: str):  # noqa: ANN201
    """A pandas UDF over WKB; nulls stay null. A geometry that fn returns becomes WKB if kind is binary."""

    @F.pandas_udf(kind)
    def run(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> object:
            if b is None:
                return None
            out = fn(from_wkb(bytes(b)))
            return to_wkb(out) if kind == "binary" and out is not None else out

        return raw.map(one)

    return run


def env_of(geom: Column) -> Column:
    """The envelope of WKB as a struct."""

    @F.pandas_udf("xmin double, ymin double, xmax double, ymax double")
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = [(envelope(from_wkb(bytes(b))) if b is not None else None) or (None,) * 4 for b in raw]
        return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")

    return run(geom)

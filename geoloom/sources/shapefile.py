"""ESRI shapefiles: .shp geometry records and .dbf attributes, decoded a file per task."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as g
from geoloom.model import Layer


def dbf_fields(raw: bytes) -> list[tuple[str, str, int, int]]:
    """name, type, width, decimals."""
    out, at = [], 32
    while at < len(raw) and raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return out


def spark_type(kind: str, width: int, decimals: int) -> T.DataType:
    if kind == "N":
        return T.DoubleType() if decimals or width >= 19 else T.IntegerType() if width < 10 else T.LongType()
    return {"F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(kind, T.StringType())


def dbf_columns(raw: bytes, encoding: str = "latin-1") -> list[list[object]]:
    """The values of each field, record by record."""
    import datetime

    def whole(text: str) -> int:
        try:
            return int(text)
        except ValueError:
            return int(float(text))

    date = lambda x: datetime.date(int(x[:4]), int(x[4:6]), int(x[6:8])) if x.isdigit() else None
    convert = {T.DoubleType: float, T.IntegerType: whole, T.LongType: whole, T.BooleanType: lambda x: x in "YyTt" if x != "?" else None, T.DateType: date}
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    out, at = [], head + 1
    for _, kind, width, decimals in dbf_fields(raw):
        texts = [raw[k : k + width].decode(encoding).strip(" \0") for k in range(at, at + n * size, size)]
        of = convert.get(type(spark_type(kind, width, decimals)), str)
        out.append([of(x) if x and (x[0] != "*" or x.strip("*")) else None for x in texts])
        at += width
    return out


def shapes(raw: bytes) -> list[g.Geometry | None]:
    out: list[g.Geometry | None] = []
    at = 100
    while at + 8 <= len(raw):
        size = struct.unpack_from(">I", raw, at + 4)[0] * 2
        kind = struct.unpack_from("<i", raw, at + 8)[0]
        p, base, z = at + 12, kind % 10, 10 < kind < 20
        if base == 1:
            out.append((1, list(struct.unpack_from("<3d" if z else "<2d", raw, p))))
        elif base == 8:
            n = struct.unpack_from("<i", raw, p + 32)[0]
            out.append((4, [list(struct.unpack_from("<2d", raw, p + 36 + 16 * k)) for k in range(n)]))
        elif base in (3, 5):
            parts, n = struct.unpack_from("<2i", raw, p + 32)
            first = [*struct.unpack_from(f"<{parts}i", raw, p + 40), n]
            flat = struct.unpack_from(f"<{2 * n}d", raw, p + 40 + 4 * parts)
            pts = [[flat[2 * k], flat[2 * k + 1]] for k in range(n)]
            if z:
                zs = struct.unpack_from(f"<{n}d", raw, p + 40 + 4 * parts + 16 * n + 16)
                pts = [[*q, v] for q, v in zip(pts, zs, strict=True)]
            lines = [pts[a:b] for a, b in zip(first, first[1:], strict=False)]
            if base == 3:
                out.append((2, lines[0]) if len(lines) == 1 else (5, lines))
            else:
                polygons: list[list] = []
                for r in lines:  # clockwise rings are shells
                    if g._ring_area(r) <= 0 or not polygons:
                        polygons.append([r])
                    else:
                        polygons[-1].append(r)
                out.append((3, polygons[0]) if len(polygons) == 1 else (6, polygons))
        else:
            out.append(None)
        at += 8 + size
    return out


#: Records of a file whose shapes are all points, and points as WKB.
POINT, WKB_POINT = np.dtype([("k", ">u4"), ("n", ">u4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")]), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def shapes_wkb(raw: bytes) -> pa.Array:
    """The shapes as WKB; those of a file of points alone without an object for each."""
    if len(raw) >= 100 and (len(raw) - 100) % POINT.itemsize == 0:
        own = np.frombuffer(raw, POINT, offset=100)
        if (own["n"] == 10).all() and (own["kind"] == 1).all():
            out = np.empty(len(own), WKB_POINT)
            out["order"], out["kind"], out["x"], out["y"] = 1, 1, own["x"], own["y"]
            return pa.Array.from_buffers(pa.binary(WKB_POINT.itemsize), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pa.array([g.to_wkb(s) if s else None for s in shapes(raw)], pa.binary())


def read(spark: SparkSession, path: str) -> Layer:
    """path: the .shp file, or a pattern of them with the same fields; the .dbf stands beside."""
    dbf = path[:-4] + ".dbf"
    head = bytes(spark.read.format("binaryFile").load(dbf).select("content").first()[0])
    fields = dbf_fields(head)
    schema = T.StructType([T.StructField("fid", T.LongType()), *[T.StructField(n, spark_type(k, w, d)) for n, k, w, d in fields], T.StructField("geom", T.BinaryType())])
    stem = F.regexp_replace("path", r"\.[a-z]+$", "")
    files = lambda p: spark.read.format("binaryFile").load(p).select(stem.alias("stem"), "content")
    both = files(path).withColumnRenamed("content", "shp").join(files(dbf).withColumnRenamed("content", "dbf"), "stem")
    types = [{"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}.get(f.dataType.typeName(), pa.string()) for f in schema.fields[1:-1]]

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for shp, attributes in zip(b["shp"], b["dbf"], strict=True):
                geom, table = shapes_wkb(shp.as_py()), attributes.as_py()
                if len(geom) != (n := struct.unpack_from("<I", table, 4)[0]):
                    raise ValueError(f"{len(geom)} shapes beside {n} rows of attributes")
                cols = [pa.array(c, t) for c, t in zip(dbf_columns(table), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(geom)), pa.int64()), *cols, geom], names=schema.names)

    return Layer(both.mapInArrow(run, schema).withColumn("env", g.env_of(F.col("geom"))))


def encode_points(rows: list[tuple], fields: list[tuple[str, str, int, int]]) -> tuple[bytes, bytes]:
    """.shp and .dbf of points: rows of (x, y, value, ...)."""
    xs, ys = (np.frombuffer(array("d", [r[k] for r in rows])) for k in (0, 1))
    own = np.empty(len(rows), POINT)
    own["k"], own["n"], own["kind"], own["x"], own["y"] = np.arange(1, len(rows) + 1), 10, 1, xs, ys
    box = [v for f in (np.min, np.max) for v in (f(xs), f(ys))] if rows else [0.0] * 4
    shp = struct.pack(">I20xI", 9994, (100 + own.nbytes) // 2) + struct.pack("<2i8d", 1000, 1, *box, 0, 0, 0, 0) + own.tobytes()
    width = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 125, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for name, kind, size, decimals in fields:
        dbf += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, decimals]) + b"\0" * 14
    dbf += b"\r"

    def cells(values: Iterable[object], kind: str, size: int, decimals: int) -> list[bytes]:
        number = kind == "N"
        texts = ("" if v is None else f"{v:.{decimals}f}" if number and decimals else str(v) for v in values)
        return [(x.rjust(size) if number else x.ljust(size))[:size].encode("latin-1") for x in texts]

    columns = [cells((r[k] for r in rows), *f[1:]) for k, f in enumerate(fields, 2)]
    return shp, b"".join([dbf, *map(b"".join, zip([b" "] * len(rows), *columns, strict=True)), b"\x1a"])


#: Bytes of a .shp and its .dbf that write_points puts into one pair of files.
FILE_BYTES = 8 << 20


def write_points(df: DataFrame, path: str, fields: list[tuple[str, str, int, int]], file_bytes: int = FILE_BYTES) -> list[str]:
    """Points (x, y, then a column per field) as a folder of shapefiles of up to file_bytes, from each partition that has rows.

    Files are encoded in parallel and laid down as rows; the driver holds one at a time while it writes it.
    """
    from . import files

    spark = df.sparkSession
    names = ["x", "y", *[f[0] for f in fields]]
    most = max(1, file_bytes // (POINT.itemsize + 1 + sum(f[2] for f in fields)))

    def run(batches):  # noqa: ANN001, ANN202
        rows: list[tuple] = []

        def encoded(own: list[tuple]) -> pa.RecordBatch:
            shp, dbf = encode_points(own, fields)
            return pa.RecordBatch.from_arrays([pa.array([shp], pa.binary()), pa.array([dbf], pa.binary())], names=["shp", "dbf"])

        for b in batches:
            rows += zip(*(b[c].to_pylist() for c in names), strict=True)
            while len(rows) >= most:
                yield encoded(rows[:most])
                rows = rows[most:]
        if rows:
            yield encoded(rows)

    out, parts = [], f"{path}.parts"
    df.select(*names).mapInArrow(run, "shp binary, dbf binary").write.mode("overwrite").option("compression", "none").parquet(parts)
    for k, row in enumerate(spark.read.parquet(parts).toLocalIterator()):
        out.append(f"{path}/part-{k:05d}.shp")
        files.write_bytes(spark, out[-1], bytes(row["shp"]))
        files.write_bytes(spark, out[-1][:-4] + ".dbf", bytes(row["dbf"]))
    files.delete(spark, parts, True)
    return out

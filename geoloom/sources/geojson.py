"""GeoJSON, GeoJSON text sequences, ESRI JSON and TopoJSON.

Line-delimited features are read as text in splits of the file, and so are documents with a feature a line; other
documents are read a file per task. Fields are typed by a lattice of the values seen (see infer), or by a schema given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geometry as g
from geoloom.model import Layer

#: Names of the lattice's types and how Spark holds them.
SPARK = {"bool": T.BooleanType(), "int": T.IntegerType(), "int64": T.LongType(), "real": T.DoubleType(), "string": T.StringType(), "json": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType(), "time": T.StringType(), "ints": T.ArrayType(T.IntegerType()), "int64s": T.ArrayType(T.LongType()), "reals": T.ArrayType(T.DoubleType()), "strings": T.ArrayType(T.StringType())}
DATE, DATETIME, TIME = re.compile(r"\d{4}[-/]\d\d[-/]\d\d"), re.compile(r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[-+]\d\d(:?\d\d)?)?"), re.compile(r"\d\d:\d\d:\d\d(\.\d+)?")
NUMBERS, LISTS = ("int", "int64", "real"), ("ints", "int64s", "reals")


def infer(v: object) -> str | None:
    """The type of one value; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int" if -(2**31) <= v < 2**31 else "int64"
    if isinstance(v, float):
        return "real"
    if isinstance(v, str):
        return "date" if DATE.fullmatch(v) else "datetime" if DATETIME.fullmatch(v) else "time" if TIME.fullmatch(v) else "string"
    if isinstance(v, list) and v:
        kinds = {infer(x) for x in v}
        if kinds <= {"int"}:
            return "ints"
        if kinds <= {"int", "int64"}:
            return "int64s"
        if kinds <= set(NUMBERS):
            return "reals"
        if kinds <= {"string", "date", "datetime", "time"}:
            return "strings"
    return "json"


def merge(a: str | None, b: str | None) -> str | None:
    """The least type that holds values of both."""
    if a is None or b is None or a == b:
        return a or b
    pair = {a, b}
    if "bool" in pair and pair & set(NUMBERS):
        return (pair - {"bool"}).pop()
    if pair <= set(NUMBERS):
        return "real" if "real" in pair else "int64"
    if pair <= {*NUMBERS, *LISTS}:
        return "reals" if pair & {"real", "reals"} else "int64s"
    if pair == {"date", "datetime"}:
        return "datetime"
    if "time" in pair and pair & {"date", "datetime"}:
        return "json"
    if pair <= {"date", "datetime", "time", "string"}:
        return "string"
    if "strings" in pair and pair & {"string", "date", "datetime", "time", *LISTS}:
        return "strings"
    return "json"


def infer_fields(rows: Iterable[dict]) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for r in rows:
        for k, v in r.items():
            out[k] = merge(out.get(k), infer(v))
    return out


def _value(v: object, kind: str) -> object:
    if v is None:
        return None
    if kind in ("json", "string"):
        return v if isinstance(v, str) else json.dumps(v)
    if kind in (*LISTS, "strings"):
        items = v if isinstance(v, list) else [v]
        return [float(x) if kind == "reals" else str(x) if kind == "strings" else x for x in items]
    if kind == "real":
        return float(v)
    return int(v) if kind in ("int", "int64") else v


def _typed(features: DataFrame, schema: T.StructType | None, known: dict[str, str | None] | None = None) -> DataFrame:
    """features: raw (a feature as JSON text). Infers the fields over all rows unless they are known or a schema is given, then types them."""
    if schema is None and known is not None:
        kinds = {k: v or "string" for k, v in known.items()}
    elif schema is None:

        def states(batches):  # noqa: ANN001, ANN202
            import pandas as pd

            own: dict[str, str | None] = {}
            for b in batches:
                for k, kind in infer_fields((json.loads(x).get("properties") or {}) for x in b["raw"]).items():
                    own[k] = merge(own.get(k), kind)
            yield pd.DataFrame([(k, v) for k, v in own.items()], columns=["k", "kind"], dtype="object")

        found: dict[str, str | None] = {}
        for r in features.mapInPandas(states, "k string, kind string").collect():  # a row per field and partition
            found[r["k"]] = merge(found.get(r["k"]), r["kind"])
        kinds = {k: v or "string" for k, v in found.items()}
    else:
        back = {v.simpleString(): k for k, v in SPARK.items() if k not in ("json", "time")}
        kinds = {f.name: back[f.dataType.simpleString()] for f in schema}
    loose = {k: T.StringType() if v in ("date", "datetime", "time") else SPARK[v] for k, v in kinds.items()}
    row_type = T.StructType([T.StructField("fid", T.LongType()), *[T.StructField(k, t) for k, t in loose.items()], T.StructField("geom", T.BinaryType())])

    def rows(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for raw in b["raw"]:
                f = json.loads(raw)
                p, shape = f.get("properties") or {}, g.from_geojson(f.get("geometry"))
                fid = f.get("id") if isinstance(f.get("id"), int) else None
                out.append((fid, *[_value(p.get(k), kind) for k, kind in kinds.items()], g.to_wkb(shape) if shape else None))
            frame = pd.DataFrame(out, columns=row_type.names, dtype="object")
            yield frame

    out = features.mapInPandas(rows, row_type)
    casts = {k: F.try_to_timestamp(F.translate(F.col(f"`{k}`"), "/", "-")).cast(SPARK[v]) for k, v in kinds.items() if v in ("date", "datetime")}
    return out.withColumns(casts).withColumn("env", g.env_of(F.col("geom")))


def read_seq(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Layer:
    """Features a line each (record separators are skipped; lines that aren't features are, too)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\x1e", "").alias("raw"))
    return Layer(_typed(lines.filter(F.get_json_object("raw", "$.type") == "Feature"), schema), crs="OGC:CRS84")


def _feature(line: str) -> tuple[dict, bool, bool] | None:
    """A line's feature, and whether a comma stands before and after it; None if it holds anything else."""
    text = line.strip(" \t")
    before = text.startswith(",")
    after = len(text) > 1 and text.endswith(",")
    text = text[before : len(text) - after].strip(" \t")
    if not (text.startswith("{") and text.endswith("}")):
        return None
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    return (doc, before, after) if doc.get("type") == "Feature" else None


#: Characters that the lines before and after the features may have.
AROUND = 1 << 16


def _by_lines(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str | None]] | None:
    """raw and fields of a collection with a feature a line, read in splits of the file; None if a document isn't proven to be one.

    Each line is parsed. The features must be one run with a comma between any two, and what stands around them a
    collection whose features go exactly there; so they are what the whole document would give.
    """
    from . import files

    fs, p = files._fs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory() or b"\n" not in files.head(spark, path, AROUND):
        return None
    lines = spark.read.text(path)

    def runs(batches):  # noqa: ANN001, ANN202
        """Of each split its other lines and its runs of features: split, line, its length, features, commas before, after, before the first, after the last."""
        import pandas as pd

        at, own = [], {}
        for b in batches:
            for start, value in zip(b["start"], b["value"], strict=True):
                found = _feature(value)
                if found is None:
                    if value.strip(" \t"):
                        at.append((int(start), value[:AROUND], len(value), 0, 0, 0, False, False))
                else:
                    doc, before, after = found
                    for k, kind in infer_fields([doc.get("properties") or {}]).items():
                        own[k] = merge(own.get(k), kind)
                    if at and at[-1][1] is None and at[-1][0] == start:
                        old = at[-1]
                        at[-1] = (*old[:3], old[3] + 1, old[4] + before, old[5] + after, old[6], after)
                    else:
                        at.append((int(start), None, 0, 1, int(before), int(after), before, after))
                if len(at) > 1000:
                    break
            if len(at) > 1000:
                break
        yield pd.DataFrame([(json.dumps([at, own]),)], columns=["found"])

    done = lines.select("value", F.col("_metadata.file_block_start").alias("start")).mapInPandas(runs, "found string").collect()
    states = sorted((json.loads(r["found"]) for r in done), key=lambda x: x[0][0][0] if x[0] else 0)
    if any(len(x[0]) > 1000 for x in states):
        return None
    at = sorted((x for own, _ in states for x in own), key=lambda x: x[0])  # stable: within a split as they stand
    inner = [k for k, x in enumerate(at) if x[1] is None]
    if not inner or any(x[1] is not None for x in at[inner[0] : inner[-1]]) or sum(x[2] for x in at) > AROUND:
        return None
    run = at[inner[0] : inner[-1] + 1]
    n, before, after = (sum(x[k] for x in run) for k in (3, 4, 5))
    if (before, after) != (n - 1, 0) and (before, after) != (0, n - 1) or run[0][6] or run[-1][7]:
        return None
    head, tail = ("\n".join(x[1] for x in part) for part in (at[: inner[0]], at[inner[-1] + 1 :]))
    mark = "\N{REPLACEMENT CHARACTER} features"
    try:
        doc = json.loads(f"{head}{json.dumps(mark)}{tail}")
    except ValueError:
        return None
    if not isinstance(doc, dict) or doc.get("type") != "FeatureCollection" or doc.get("features") != [mark]:
        return None
    others = [x[1] for x in at if x[1] is not None]
    raw = F.regexp_replace("value", r"^[ \t]*,?|,?[ \t]*$", "").alias("raw")
    fields: dict[str, str | None] = {}
    for _, own in states:
        for k, kind in own.items():
            fields[k] = merge(fields.get(k), kind)
    return lines.filter(~F.col("value").isin(others) & (F.trim(F.translate("value", "\t", " ")) != "")).select(raw), fields


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Layer:
    """A GeoJSON document: a collection, a feature, or a bare geometry. A collection with a feature a line is read in splits."""
    if found := _by_lines(spark, path):
        return Layer(_typed(found[0], schema, found[1]), crs="OGC:CRS84")

    def split(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            for text in b["value"]:
                doc = json.loads(text)
                own = doc["features"] if doc.get("type") == "FeatureCollection" else [doc] if doc.get("type") == "Feature" else [{"type": "Feature", "properties": {}, "geometry": doc}]
                yield pd.DataFrame({"raw": [json.dumps(f) for f in own]}, dtype="object")

    return Layer(_typed(spark.read.text(path, wholetext=True).mapInPandas(split, "raw string"), schema), crs="OGC:CRS84")


def read_esri(spark: SparkSession, path: str) -> Layer:
    """ESRI JSON: attributes and rings, paths or x and y; dates are milliseconds since 1970."""

    def split(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            for text in b["value"]:
                doc = json.loads(text)
                dates = {f["name"] for f in doc.get("fields", []) if f.get("type") == "esriFieldTypeDate"}
                out = []
                for f in doc.get("features", []):
                    shape = f.get("geometry") or {}
                    geo = {"type": "Point", "coordinates": [shape["x"], shape["y"]]} if "x" in shape else {"type": "MultiLineString", "coordinates": shape["paths"]} if "paths" in shape else {"type": "MultiPoint", "coordinates": shape["points"]} if "points" in shape else _esri_polygon(shape["rings"]) if "rings" in shape else None
                    props = {k: pd.Timestamp(v, unit="ms").isoformat() if k in dates and v is not None else v for k, v in f.get("attributes", {}).items()}
                    out.append(json.dumps({"type": "Feature", "properties": props, "geometry": geo}))
                yield pd.DataFrame({"raw": out}, dtype="object")

    return Layer(_typed(spark.read.text(path, wholetext=True).mapInPandas(split, "raw string"), None))


def _esri_polygon(rings: list) -> dict:
    """Clockwise rings are shells, the others holes of the shell before them."""
    polygons: list[list] = []
    for r in rings:
        if g._ring_area(r) <= 0 or not polygons:
            polygons.append([r])
        else:
            polygons[-1].append(r)
    return {"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons}


def read_topojson(spark: SparkSession, path: str) -> dict[str, Layer]:
    """One layer per object; arcs are delta-coded under a transform."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    scale, move = doc.get("transform", {}).get("scale", [1, 1]), doc.get("transform", {}).get("translate", [0, 0])
    arcs = []
    for arc in doc["arcs"]:
        x = y = 0
        line = []
        for p in arc:
            x, y = (x + p[0], y + p[1]) if "transform" in doc else (p[0], p[1])
            line.append([x * scale[0] + move[0], y * scale[1] + move[1]])
        arcs.append(line)

    def line(refs: list[int]) -> list:
        out: list = []
        for k in refs:
            part = arcs[k] if k >= 0 else arcs[~k][::-1]
            out += part[1:] if out else part
        return out

    def geometry(o: dict) -> dict | None:
        kind, a = o.get("type"), o.get("arcs")
        if kind in ("Point", "MultiPoint"):
            at = lambda p: [p[0] * scale[0] + move[0], p[1] * scale[1] + move[1]]
            return {"type": kind, "coordinates": at(o["coordinates"]) if kind == "Point" else [at(p) for p in o["coordinates"]]}
        if kind == "LineString":
            return {"type": kind, "coordinates": line(a)}
        if kind in ("MultiLineString", "Polygon"):
            return {"type": kind, "coordinates": [line(r) for r in a]}
        return {"type": kind, "coordinates": [[line(r) for r in p] for p in a]} if kind == "MultiPolygon" else None

    out = {}
    for name, o in doc["objects"].items():
        members = o["geometries"] if o.get("type") == "GeometryCollection" else [o]
        raw = [(json.dumps({"type": "Feature", "id": m.get("id"), "properties": m.get("properties", {}), "geometry": geometry(m)}),) for m in members]
        out[name] = Layer(_typed(spark.createDataFrame(raw, "raw string"), None), name)
    return out


def features(df: DataFrame, precision: int | None = None) -> DataFrame:
    """value: a GeoJSON feature per row, as text."""
    names = [c for c in df.columns if c not in ("fid", "geom", "env")]
    digits = precision

    def shape(x: g.Geometry) -> str:
        cut = x if digits is None else g.map_vertices(x, lambda p: [round(v, digits) for v in p])
        return json.dumps(g.to_geojson(cut))

    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    geo = F.coalesce(g.geometry_udf(shape, "string")(F.col("geom")), F.lit("null")) if "geom" in df.columns else F.lit("null")
    fid = F.concat(F.lit('"id":'), F.col("fid").cast("string"), F.lit(",")) if "fid" in df.columns else F.lit("")
    return df.select(F.concat(F.lit('{"type":"Feature",'), F.coalesce(fid, F.lit("")), F.lit('"properties":'), props, F.lit(',"geometry":'), geo, F.lit("}")).alias("value"))


def write_seq(df: DataFrame, path: str, mode: str = "error", precision: int | None = None) -> None:
    """A folder of text files, a feature per line; append adds files."""
    features(df, precision).write.mode(mode).text(path)


def write(df: DataFrame, path: str, precision: int | None = None) -> None:
    """One document: features are written in parallel, then the parts are put together as a stream of bytes."""
    from . import files

    spark = df.sparkSession
    parts = f"{path}.parts"
    features(df, precision).select(F.concat(F.lit(","), "value").alias("value")).write.mode("overwrite").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = files._fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(b'{"type":"FeatureCollection","features":[\n')
        first = True
        for x in files.listing(spark, parts):
            if x["size"] and x["path"].rsplit("/", 1)[-1].startswith("part-"):
                own = files._fs(spark, x["path"])
                stream = own[0].open(own[1])
                if first:
                    stream.read()  # the comma before the first feature
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                stream.close()
        out.write(b"]}\n")
    finally:
        out.close()
    files.delete(spark, parts, True)

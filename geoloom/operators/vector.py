"""Vector verbs over layers: DataFrames with fid, attributes, and optionally geom (WKB) and env."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import hilbert
from geoloom.functions.cast import lenient
from geoloom.model import Layer
from geoloom.sql import execute_sql, where

GEOMETRY = ("geom", "env")


def _resolve(df: DataFrame, names: list[str], ignore_missing: bool) -> list[str]:
    known = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in known]
    if missing and not ignore_missing:
        raise ValueError(f"unknown fields {missing}")
    return [known[n.lower()] for n in names if n.lower() in known]


def select(df: DataFrame, fields: list[str], exclude: bool = False, ignore_missing: bool = False) -> DataFrame:
    """Keeps the named fields (in the layer's order, without geometry unless named), or all but them."""
    got = set(_resolve(df, fields, ignore_missing or exclude))
    return df.drop(*got) if exclude else df.select(*[c for c in df.columns if c in got or c == "fid"])


def filter_rows(df: DataFrame, condition: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows for which the condition is true and whose envelope meets bbox (closed; null envelopes fail)."""
    if condition:
        df = where(df, condition)
    if bbox and "env" in df.columns:
        x0, y0, x1, y1 = bbox
        df = df.filter((F.col("env.xmin") <= x1) & (F.col("env.xmax") >= x0) & (F.col("env.ymin") <= y1) & (F.col("env.ymax") >= y0))
    return df


def sql(layers: dict[str, DataFrame] | DataFrame, statement: str) -> DataFrame:
    return execute_sql(layers, statement, "fid" if isinstance(layers, DataFrame) and "fid" in layers.columns else None)


def _merge_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a field that arrives as b where a is known already: it depends on the order."""
    ints = (T.IntegerType, T.ShortType, T.ByteType)
    if a == b:
        return a
    if isinstance(a, (*ints, T.LongType)) and isinstance(b, (*ints, T.LongType)):
        return T.LongType()
    if isinstance(a, T.DoubleType) and isinstance(b, (*ints, T.LongType)):
        return a
    return T.StringType()


def concat(layers: list[tuple[str, DataFrame]], strategy: str = "union", tag: str | None = None) -> DataFrame:
    """All rows of all layers. strategy: union or intersection of the fields; tag: a field for the layer's name."""
    kinds: dict[str, T.DataType] = {}
    for _, df in layers:
        for f in df.schema:
            kinds[f.name] = _merge_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    if strategy == "intersection":
        kinds = {n: t for n, t in kinds.items() if all(n in df.columns for _, df in layers)}
    parts = []
    for name, df in layers:
        own = df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        parts.append(own.withColumn(tag, F.lit(name)) if tag else own)
    return reduce(lambda a, b: a.unionByName(b), parts)


def combine(df: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """One feature per key: its members as an array in order of fid, its envelope, and aggregates. Sorted by the keys as text."""
    env = [F.min("env.xmin").alias("xmin"), F.min("env.ymin").alias("ymin"), F.max("env.xmax").alias("xmax"), F.max("env.ymax").alias("ymax")]
    aggs = [F.count("*").alias("members")]
    if "geom" in df.columns:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.when(F.col("geom").isNotNull(), F.struct("fid", "geom")))), lambda m: m["geom"]).alias("geoms"))
    aggs += [F.struct(*env).alias("env")] if "env" in df.columns else []
    out = df.groupBy(*keys).agg(*aggs, *[c.alias(n) for n, c in (values or {}).items()])
    return out.orderBy(*[F.col(k).cast("string") for k in keys]) if keys else out


def update(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "merge", fields: list[str] | None = None) -> DataFrame:
    """Upserts source into target. Null keys never match; a key that target holds twice matches nothing. Of source rows with
    one key, the first in order of all their fields counts.

    mode: merge (update and append), update_only, append_only. Appended rows take new fids after the target's, in order of
    their keys, unless fid is a key.
    """
    fields = fields or [c for c in target.columns if c not in keys and c != "fid" and c in source.columns]
    row = F.struct(*[F.col(f) for f in fields], *[F.col(c) for c in source.columns if c not in fields])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    once = source.filter(known).groupBy(*keys).agg(F.min(row).alias("__s"))
    held = target.groupBy(*keys).agg(F.count("*").alias("__n"))
    out = target
    if mode != "append_only":
        usable = once.join(held.filter("__n = 1"), keys).select(*keys, "__s")
        joined = target.join(usable, keys, "left")
        hit = F.col("__s").isNotNull()
        out = joined.select(*[F.when(hit, F.col(f"__s.{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in target.columns])
    if mode == "update_only":
        return out
    new = once.join(held, keys, "left_anti")
    new = new.select(*keys, *[F.col(f"__s.{c}").cast(target.schema[c].dataType).alias(c) for c in target.columns if c in fields])
    if "fid" in target.columns and "fid" not in keys:
        top = target.agg(F.coalesce(F.max("fid"), F.lit(0))).first()[0]
        new = renumber(new, *[F.col(k) for k in keys]).withColumn("fid", (F.col("fid") + top).cast(target.schema["fid"].dataType))
    return out.unionByName(new, allowMissingColumns=True).select(*target.columns)


def partition(df: DataFrame, path: str, fields: list[str], scheme: str = "hive", limit: int | None = None, drop_fields: bool = True) -> None:
    """Writes a layer in parts by distinct field values: hive folders, or one flat folder per value."""
    out = df if drop_fields else df.withColumns({f"part_{f}": F.col(f) for f in fields})
    names = fields if drop_fields else [f"part_{f}" for f in fields]
    if scheme == "flat":
        flat = F.concat_ws("_", *[F.url_encode(F.col(f).cast("string")) for f in names])
        out, names = out.withColumn("part", flat), ["part"]
    writer = out.repartition(*names).write.partitionBy(*names)
    (writer.option("maxRecordsPerFile", limit) if limit else writer).mode("overwrite").parquet(path)


def hilbert_key(df: DataFrame) -> DataFrame:
    """Adds hilbert: the curve index of the envelope's centre in the layer's extent (null without an envelope)."""
    extent = df.agg(F.min("env.xmin").alias("x0"), F.min("env.ymin").alias("y0"), F.max("env.xmax").alias("x1"), F.max("env.ymax").alias("y1")).first()
    x0, y0, x1, y1 = (F.lit(v).cast("double") for v in extent)
    cx, cy = (F.col("env.xmin") + F.col("env.xmax")) / 2, (F.col("env.ymin") + F.col("env.ymax")) / 2
    key = hilbert.index(hilbert.cell(cx, x0, x1), hilbert.cell(cy, y0, y1))
    return df.withColumn("hilbert", F.when(F.col("env.xmin").isNotNull(), key))


def sort(df: DataFrame) -> DataFrame:
    """Spatial order; rows without an envelope last, equal keys by fid."""
    return hilbert_key(df).orderBy(F.col("hilbert").asc_nulls_last(), "fid").drop("hilbert")


def extent(df: DataFrame) -> DataFrame:
    """n, xmin, ymin, xmax, ymax of the rows that have an envelope."""
    return df.agg(F.count("*").alias("n"), F.min("env.xmin").alias("xmin"), F.min("env.ymin").alias("ymin"), F.max("env.xmax").alias("xmax"), F.max("env.ymax").alias("ymax"))


def info(layer: Layer) -> dict:
    """Counts, extent and fields of a layer."""
    env = [F.min("env.xmin"), F.min("env.ymin"), F.max("env.xmax"), F.max("env.ymax")] if "env" in layer.df.columns else []
    n, *extent = layer.df.agg(F.count("*"), *env).first()
    return {"name": layer.name, "featureCount": n, "extent": extent or None, "crs": layer.crs, "geometryType": layer.geometry_type, "fields": json.loads(export_schema(layer))["fields"]}


TYPES = {"integer": T.IntegerType(), "integer64": T.LongType(), "real": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
TYPE_NAMES = {"int": "Integer", "smallint": "Integer", "tinyint": "Integer", "bigint": "Integer64", "double": "Real", "float": "Real", "string": "String", "date": "Date", "timestamp": "DateTime", "binary": "Binary", "boolean": "Integer(Boolean)", "array<int>": "IntegerList", "array<bigint>": "Integer64List", "array<double>": "RealList", "array<string>": "StringList"}


def export_schema(layer: Layer) -> str:
    fields = [{"name": f.name, "type": TYPE_NAMES.get(f.dataType.simpleString(), "String(JSON)"), "nullable": f.nullable} for f in layer.df.schema if f.name in layer.attributes]
    return json.dumps({"name": layer.name, "geometryType": layer.geometry_type, "crs": layer.crs, "fields": fields})


def create(spark, name: str, fields: list[str], geometry_type: str = "Unknown", crs: str | None = None) -> Layer:  # noqa: ANN001
    """An empty layer from NAME:TYPE specifications."""
    schema = [T.StructField("fid", T.LongType())]
    for spec in fields:
        field, kind = re.fullmatch(r"([^:]+):(\w+)(?:\(.*\))?", spec).groups()
        schema.append(T.StructField(field, TYPES[kind.lower()]))
    if geometry_type != "None":
        schema.append(T.StructField("geom", T.BinaryType()))
    return Layer(spark.createDataFrame([], T.StructType(schema)), name, geometry_type, crs)


def edit(layer: Layer, crs: str | None = None, geometry_type: str | None = None, metadata: dict[str, str | None] | None = None, unset_fid: bool = False) -> Layer:
    """Overrides of what is said about a layer; metadata values of None are removed."""
    meta = {k: v for k, v in {**layer.metadata, **(metadata or {})}.items() if v is not None}
    df = layer.df.withColumn("fid", F.monotonically_increasing_id()) if unset_fid else layer.df
    return layer.with_df(df, crs=crs or layer.crs, geometry_type=geometry_type or layer.geometry_type, metadata=meta)


def rename_layer(names: list[str], ascii_only: bool = False, lower_case: bool = False, filename_compatible: bool = False, reserved: str = "", replacement: str = "_", max_length: int | None = None) -> list[str]:
    """Sanitised, unique layer names."""
    out: list[str] = []
    for name in names:
        if ascii_only:
            name = "".join(c if c.isascii() else replacement for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        name = name.lower() if lower_case else name
        if filename_compatible:
            name = re.sub(r'[<>:"/\\|?*\x00-\x1f]', replacement, name)
        name = "".join(replacement if c in reserved else c for c in name)[:max_length]
        base, k = name, 1
        while name in out:
            tail = f"_{k}"
            name, k = (base[: max_length - len(tail)] if max_length else base) + tail, k + 1
        out.append(name)
    return out


def set_field_type(df: DataFrame, target: str, field: str | None = None, source: str | None = None) -> DataFrame:
    """Casts one field, or all of a type, leniently."""
    back = {"int": "integer", "smallint": "integer", "bigint": "integer64", "double": "real", "float": "real", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "datetime"}
    chosen = [f for f in df.schema if (f.name.lower() == field.lower() if field else back.get(f.dataType.simpleString()) == source)]
    if not chosen:
        raise ValueError("no such field")
    return df.withColumns({f.name: lenient(F.col(f"`{f.name}`"), back.get(f.dataType.simpleString(), "string"), target) for f in chosen})


def index(layers: list[tuple[str, Layer]]) -> DataFrame:
    """A tile index: one row per layer with its location, extent and CRS."""
    rows = [layer.df.agg(F.min("env.xmin").alias("xmin"), F.min("env.ymin").alias("ymin"), F.max("env.xmax").alias("xmax"), F.max("env.ymax").alias("ymax")).select(F.lit(location).alias("location"), F.lit(layer.crs).alias("crs"), "*") for location, layer in layers]
    return reduce(lambda a, b: a.unionByName(b), rows)


def renumber(df: DataFrame, *order: Column) -> DataFrame:
    """New fids from 1 in the given order, ties by all fields; the numbers of a partition follow those of the ones before it.

    The ordered rows are written once, so that both uses see the same partitions.
    """
    from .components import cut_lineage

    tie = F.xxhash64(*df.columns)
    ordered = cut_lineage(df.orderBy(*order, tie).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row per partition
    return ordered.join(F.broadcast(before), part == F.col("p")).withColumn("fid", F.col("before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("p", "before", "__m")

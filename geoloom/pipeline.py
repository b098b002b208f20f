"""The pipeline language: `read A ! step args ! ... ! write B`, each step a DataFrame transformation.

Steps are looked up in a registry; a saved pipeline is a JSON file with its text. Nothing runs until the result is used.
"""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import components, convert, geometry, raster, stencil, vector, warp
from geoloom.sources import files, geojson, tiff

STEPS: dict[str, Callable] = {}


@dataclass
class Step:
    name: str
    args: list[str] = field(default_factory=list)
    options: dict[str, str | bool] = field(default_factory=dict)


def step(name: str) -> Callable[[Callable], Callable]:
    def register(fn: Callable) -> Callable:
        STEPS[name] = fn
        return fn

    return register


def parse(text: str) -> list[Step]:
    """Steps of a pipeline. Options: --name value, --name=value, or --name alone."""
    out: list[Step] = []
    words: list[str] = []
    for w in [*shlex.split(text), "!"]:
        if w != "!":
            words.append(w)
            continue
        if not words:
            raise ValueError("an empty step")
        s, k = Step(words[0]), 1
        while k < len(words):
            if words[k].startswith("--"):
                name, eq, value = words[k][2:].partition("=")
                if eq:
                    s.options[name] = value
                elif k + 1 < len(words) and not words[k + 1].startswith("--"):
                    k += 1
                    s.options[name] = words[k]
                else:
                    s.options[name] = True
            else:
                s.args.append(words[k])
            k += 1
        out.append(s)
        words = []
    return out


def run(spark: SparkSession, text: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of a pipeline. inputs: named DataFrames that `read` finds before files."""
    df = None
    steps = parse(text)
    for k, s in enumerate(steps):
        if (s.name == "read") != (k == 0):
            raise ValueError("a pipeline begins with read, and reads once")
        if s.name == "write" and k != len(steps) - 1:
            raise ValueError("write ends a pipeline")
        if s.name == "read":
            df = _read(spark, s, inputs or {})
        elif s.name in STEPS:
            df = STEPS[s.name](df, *s.args, **{k.replace("-", "_"): v for k, v in s.options.items()})
        else:
            raise ValueError(f"unknown step {s.name}")
    return df


def save(text: str, path: str, spark: SparkSession | None = None) -> None:
    parse(text)
    files.write_bytes(spark or SparkSession.active(), path, json.dumps({"type": "pipeline", "command_line": text}).encode())


def load(spark: SparkSession, path: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    return run(spark, json.loads(spark.read.text(path, wholetext=True).first()[0])["command_line"], inputs)


def _read(spark: SparkSession, s: Step, inputs: dict[str, DataFrame]) -> DataFrame:
    name = s.args[0]
    if name in inputs:
        return inputs[name]
    if name.endswith((".geojsonl", ".geojsons", ".jsonl")):
        return geojson.read_seq(spark, name).df
    if name.endswith((".json", ".geojson")):
        return geojson.read(spark, name).df
    if name.endswith((".tif", ".tiff")):
        return tiff.read(spark, name).df
    return spark.read.parquet(name)


def _box(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


@step("filter")
def _filter(df, where=None, bbox=None):  # noqa: ANN001, ANN202
    return vector.filter_rows(df, where, _box(bbox) if bbox else None)


@step("select")
def _select(df, fields, exclude=False, ignore_missing_fields=False):  # noqa: ANN001, ANN202
    return vector.select(df, fields.split(","), bool(exclude), bool(ignore_missing_fields))


@step("sql")
def _sql(df, statement):  # noqa: ANN001, ANN202
    return vector.sql(df, statement)


@step("sort")
def _sort(df):  # noqa: ANN001, ANN202
    return vector.sort(df)


@step("limit")
def _limit(df, n):  # noqa: ANN001, ANN202
    return df.limit(int(n))


@step("materialize")
def _materialize(df):  # noqa: ANN001, ANN202
    return components.cut_lineage(df)


@step("tee")
def _tee(df, path):  # noqa: ANN001, ANN202
    df.write.mode("overwrite").parquet(path)
    return df


@step("make-point")
def _make_point(df, x="x", y="y", z=None):  # noqa: ANN001, ANN202
    return geometry.make_point(df, x, y, z)


@step("reproject")
def _reproject(df, src_crs="EPSG:4326", dst_crs="EPSG:3857"):  # noqa: ANN001, ANN202
    x, y = geometry.transform(src_crs, dst_crs)(F.col("x"), F.col("y"))
    return df.withColumns({"x": x, "y": y})


@step("set-field-type")
def _set_field_type(df, field, type):  # noqa: ANN001, ANN202, A002
    return vector.set_field_type(df, type.lower(), field)


@step("combine")
def _combine(df, group_by=""):  # noqa: ANN001, ANN202
    return vector.combine(df, [k for k in group_by.split(",") if k])


@step("write")
def _write(df, path, overwrite=False):  # noqa: ANN001, ANN202
    mode = "overwrite" if overwrite else "error"
    if path == "stream":
        df.write.format("noop").mode("overwrite").save()
    elif path.endswith((".geojsonl", ".geojsons")):
        geojson.write_seq(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)
    return df


for _name, _fn in {
    "swap-xy": geometry.swap_xy, "explode-collections": geometry.explode_collections, "convex-hull": geometry.convex_hull, "check-geometry": geometry.check_geometry,
    "slope": stencil.slope, "aspect": stencil.aspect, "hillshade": stencil.hillshade, "roughness": stencil.roughness, "tpi": stencil.tpi, "tri": stencil.tri,
    "nodata-to-alpha": raster.nodata_to_alpha, "overview": warp.overview,
}.items():
    STEPS[_name] = _fn
STEPS |= {
    "segmentize": lambda df, n: geometry.segmentize(df, float(n)),
    "simplify": lambda df, tolerance: geometry.simplify(df, float(tolerance)),
    "set-geom-type": lambda df, target, skip=False: geometry.set_geom_type(df, target, bool(skip)),
    "clip": lambda df, bbox: geometry.clip(df, _box(bbox)),
    "reclassify": lambda df, mapping: df.withColumn("v", raster.reclassify(F.col("v"), mapping)),
    "scale": lambda df, src_min=None, src_max=None: raster.scale(df, source=None if src_min is None else (float(src_min), float(src_max))),
    "unscale": lambda df, scale=1, offset=0: raster.unscale(df, float(scale), float(offset)),
    "set-type": lambda df, dtype: raster.set_type(df, dtype),
    "select-bands": lambda df, bands: raster.select_bands(df, [int(b) for b in bands.split(",")]),
    "neighbors": lambda df, kernel="equal", method="mean": stencil.neighbors(df, kernel, method),
    "polygonize": lambda df, width: components.polygonize(df, int(width)),
    "footprint": lambda df, width: components.footprint(df, int(width)),
    "contour": lambda df, interval: convert.contour_segments(df, float(interval)),
    "as-features": lambda df: convert.as_features(df),
}

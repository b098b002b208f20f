"""Datasets of any format: open, inform, convert."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geometry import geometry_udf
from geoloom.model import Layer, Raster
from geoloom.operators import raster, vector

from . import files, geojson, shapefile, tiff, vrt


def open_dataset(spark: SparkSession, path: str) -> Layer | Raster:
    """A file by its first bytes; a folder is read as Parquet, or as text sequences by its ending."""
    if path.endswith((".geojsonl", ".geojsons")):
        return geojson.read_seq(spark, path)
    if files.is_folder(spark, path):
        return Layer(spark.read.parquet(path))
    kind = files.format_of(files.head(spark, path))
    if kind == "TopoJSON":
        return next(iter(geojson.read_topojson(spark, path).values()))
    readers = {"TIFF": tiff.read, "VRT": vrt.read, "GeoJSON": geojson.read, "GeoJSONSeq": geojson.read_seq, "ESRIJSON": geojson.read_esri, "Shapefile": shapefile.read}
    if kind == "Parquet":
        return Layer(spark.read.parquet(path))
    if kind not in readers:
        raise ValueError(f"no reader knows {path}")
    return readers[kind](spark, path)


def info(spark: SparkSession, path: str, limit: int = 0) -> dict:
    """What is said about a dataset; of a layer the first `limit` features, too."""
    found = open_dataset(spark, path)
    if isinstance(found, Raster):
        return {"kind": "raster", **raster.info(found)}
    out = {"kind": "vector", **vector.info(found)}
    if limit:
        rows = found.df.orderBy(F.col("fid").asc_nulls_last()) if "fid" in found.df.columns else found.df
        out["features"] = [r.asDict() for r in rows.drop("geom", "env").limit(limit).collect()]
    return out


def convert(spark: SparkSession, source: str, target: str, overviews: int = 0) -> None:
    """source as target, whose ending names the format: rasters .tif; layers .geojson, .geojsonl, points .shp (a folder of
    shapefiles), anything else Parquet."""
    found = open_dataset(spark, source)
    if isinstance(found, Raster):
        if not target.endswith((".tif", ".tiff")):
            found.df.write.parquet(target)
        else:
            tiff.write(found, target, overviews=overviews)
        return
    if target.endswith((".geojsonl", ".geojsons")):
        geojson.write_seq(found.df.drop("env"), target)
    elif target.endswith((".json", ".geojson")):
        geojson.write(found.df.drop("env"), target)
    elif target.endswith(".shp"):
        at = lambda k: geometry_udf(lambda p: float(p[1][k]), "double")("geom")
        kinds = {"int": ("N", 11, 0), "bigint": ("N", 20, 0), "double": ("N", 24, 15)}
        fields = [(f.name[:10], *kinds.get(f.dataType.simpleString(), ("C", 254, 0))) for f in found.df.schema if f.name in found.attributes]
        shapefile.write_points(found.df.select(at(0).alias("x"), at(1).alias("y"), *[F.col(f"`{c}`").alias(c[:10]) for c in found.attributes]), target, fields)
    else:
        found.df.write.parquet(target)


def delete_overviews(spark: SparkSession, path: str, target: str) -> None:
    """A raster without its overviews: the tiles are written anew."""
    tiff.write(tiff.read(spark, path), target)

"""Queries through files: what is written is read again, and must be the table that it came from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geoloom import pipeline
from geoloom.catalog import query
from geoloom.functions.geometry import geometry_udf, point_wkb
from geoloom.model import Layer, Raster
from geoloom.operators import raster, vector
from geoloom.operators.components import shared_path
from geoloom.sources import archives, datasets, files, geojson, shapefile, tiff, vrt

from .views import DEM, PTS, dem, points, table

xy = lambda k: geometry_udf(lambda p: float(p[1][k]), "double")


def _layer(spark, sf_dir):  # noqa: ANN001, ANN202
    """Customers as point features: fid, name, z, geom."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_name").alias("name"))
    pts = points(spark, sf_dir).select("fid", "z", point_wkb(F.col("x"), F.col("y")).alias("geom"))
    return c.join(pts, "fid")


NAMED = f"{PTS} SELECT fid, c_name AS name, z, x, y FROM pts JOIN customer ON c_custkey = fid"


def _shown(df):  # noqa: ANN001, ANN202
    return df.select("fid", "name", "z", xy(0)("geom").alias("x"), xy(1)("geom").alias("y"))


@query("source_geojson", f"WITH {NAMED}")
def source_geojson(spark, sf_dir):  # noqa: ANN001, ANN201
    path = f"{shared_path(spark)}.geojson"
    geojson.write(_layer(spark, sf_dir), path)
    return _shown(geojson.read(spark, path).df)


@query("source_geojsonseq", f"WITH {NAMED}")
def source_geojsonseq(spark, sf_dir):  # noqa: ANN001, ANN201
    """Written in two goes: the second appends."""
    path = f"{shared_path(spark)}.geojsonl"
    df = _layer(spark, sf_dir)
    geojson.write_seq(df.filter("fid % 2 = 0"), path)
    geojson.write_seq(df.filter("fid % 2 = 1"), path, "append")
    return _shown(geojson.read_seq(spark, path).df)


@query("source_esrijson", "SELECT n_nationkey AS key, n_name AS name, CAST(n_nationkey * 2 AS DOUBLE) x, CAST(n_regionkey AS DOUBLE) y FROM nation")
def source_esrijson(spark, sf_dir):  # noqa: ANN001, ANN201
    path = f"{shared_path(spark)}.json"
    rows = table(spark, sf_dir, "nation").collect()  # a fixed table of 25 rows
    import json

    doc = {"geometryType": "esriGeometryPoint", "features": [{"attributes": {"key": r["n_nationkey"], "name": r["n_name"]}, "geometry": {"x": r["n_nationkey"] * 2.0, "y": float(r["n_regionkey"])}} for r in rows]}
    files.write_bytes(spark, path, json.dumps(doc).encode())
    df = geojson.read_esri(spark, path).df
    return df.select("key", "name", xy(0)("geom").alias("x"), xy(1)("geom").alias("y"))


@query("source_topojson", "SELECT n_nationkey AS key, CAST(n_nationkey + 10 AS DOUBLE) x, CAST(n_regionkey * 2 AS DOUBLE) y FROM nation")
def source_topojson(spark, sf_dir):  # noqa: ANN001, ANN201
    import json

    path = f"{shared_path(spark)}.json"
    rows = table(spark, sf_dir, "nation").collect()  # a fixed table of 25 rows
    shapes = [{"type": "Point", "properties": {"key": r["n_nationkey"]}, "coordinates": [r["n_nationkey"], r["n_regionkey"]]} for r in rows]
    doc = {"type": "Topology", "transform": {"scale": [1, 2], "translate": [10, 0]}, "arcs": [], "objects": {"p": {"type": "GeometryCollection", "geometries": shapes}}}
    files.write_bytes(spark, path, json.dumps(doc).encode())
    df = geojson.read_topojson(spark, path)["p"].df
    return df.select("key", xy(0)("geom").alias("x"), xy(1)("geom").alias("y"))


@query("source_shapefile", f"WITH {PTS} SELECT CAST(fid AS INT) id, x, y, 'n' || fid AS name FROM pts")
def source_shapefile(spark, sf_dir):  # noqa: ANN001, ANN201
    path = shared_path(spark)
    shapefile.write_points(points(spark, sf_dir).select("x", "y", F.col("fid").cast("int").alias("id"), F.concat(F.lit("n"), "fid").alias("name")), path, [("id", "N", 9, 0), ("name", "C", 12, 0)])
    df = shapefile.read(spark, f"{path}/*.shp").df
    return df.select("id", xy(0)("geom").alias("x"), xy(1)("geom").alias("y"), "name")


@query("source_tiff", f'WITH {DEM} SELECT 1 band, r "row", c "col", v FROM dem UNION ALL SELECT 2, r, c, CAST(nullif(k, 7) AS DOUBLE) FROM dem')
def source_tiff(spark, sf_dir):  # noqa: ANN001, ANN201
    """Two bands, tiles written in parallel, with overviews; no-data cells come back as nulls."""
    cells = raster.stack([(dem(spark, sf_dir), 1), (dem(spark, sf_dir, "p_size").withColumn("v", F.expr("nullif(v, 7d)")), 1)])
    height = cells.agg(F.max("row")).first()[0] + 1
    path = f"{shared_path(spark)}.tif"
    tiff.write(Raster(cells, 40, height, 2, (100.0, 2.0, 0.0, 500.0, 0.0, -2.0), None, "Float64", -9999.0), path, tile=16, overviews=2)
    return tiff.read(spark, path).df.select("band", "row", "col", "v")


@query("source_tiff_overview", f'WITH {DEM} SELECT r // 2 "row", c // 2 "col", round(avg(v), 6) v FROM dem GROUP BY 1, 2')
def source_tiff_overview(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    height = cells.agg(F.max("row")).first()[0] + 1
    path = f"{shared_path(spark)}.tif"
    tiff.write(Raster(cells, 40, height), path, tile=32, overviews=1, big=True)
    return tiff.read(spark, path, level=1).df.select("row", "col", F.round("v", 6).alias("v"))


@query("source_vrt", f'WITH {DEM} SELECT r "row", c "col", v FROM dem UNION ALL SELECT r, c + 40, v FROM dem')
def source_vrt(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same raster twice, side by side."""
    cells = dem(spark, sf_dir)
    height = cells.agg(F.max("row")).first()[0] + 1
    path = shared_path(spark)
    tiff.write(Raster(cells, 40, height), f"{path}.tif", tile=64)
    whole = (0, 0, 40, height)
    xml = vrt.write(80, height, [(f"{path}.tif", 1, whole, whole), (f"{path}.tif", 1, whole, (40, 0, 40, height))], (0, 1, 0, 0, 0, 1))
    files.write_bytes(spark, f"{path}.vrt", xml.encode())
    return vrt.read(spark, f"{path}.vrt").df.select("row", "col", "v")


@query("source_mdim_vrt", "SELECT CAST(i AS INT) i0, CAST(j AS INT) i1, CAST(i * 3 + j + 1 AS DOUBLE) v FROM range(2) a(i), range(3) b(j)")
def source_mdim_vrt(spark, sf_dir):  # noqa: ANN001, ANN201
    xml = """<VRTDataset><Group name="/"><Dimension name="Y" size="2"/><Dimension name="X" size="3"/>
    <Array name="t"><DataType>Float64</DataType><DimensionRef ref="Y"/><DimensionRef ref="X"/><InlineValues>1 2 3 4 5 6</InlineValues></Array></Group></VRTDataset>"""
    path = f"{shared_path(spark)}.vrt"
    files.write_bytes(spark, path, xml.encode())
    return vrt.read_arrays(spark, path)["t"][0]


@query("source_archive", "SELECT * FROM (VALUES ('a/one.txt', 'first'), ('two.txt', 'second')) t(name, content)")
def source_archive(spark, sf_dir):  # noqa: ANN001, ANN201
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/one.txt", "first")
        z.writestr("two.txt", "second")
    path = f"{shared_path(spark)}.zip"
    files.write_bytes(spark, path, raw.getvalue())
    return archives.members(spark, path).select("name", F.decode("content", "UTF-8").alias("content"))


@query("source_saved_pipeline", f"WITH {PTS} SELECT fid, z FROM pts WHERE z > 100")
def source_saved_pipeline(spark, sf_dir):  # noqa: ANN001, ANN201
    path = f"{shared_path(spark)}.json"
    pipeline.save("read pts ! filter --where 'z > 100' ! select env,x,y --exclude", path, spark)
    return pipeline.load(spark, path, {"pts": points(spark, sf_dir)})


@query("pipeline_materialize", f"WITH {PTS} SELECT fid, x FROM pts WHERE x > 50")
def pipeline_materialize(spark, sf_dir):  # noqa: ANN001, ANN201
    path = shared_path(spark)
    text = f"read pts ! filter --where 'x > 50' ! materialize ! tee {path} ! write stream"
    pipeline.run(spark, text, {"pts": points(spark, sf_dir)})
    return spark.read.parquet(path).select("fid", "x")


@query("vector_convert", f"WITH {PTS} SELECT fid, x, y, z FROM pts")
def vector_convert(spark, sf_dir):  # noqa: ANN001, ANN201
    path = shared_path(spark)
    pipeline.run(spark, f"read pts ! select env --exclude ! write {path}", {"pts": points(spark, sf_dir)})
    return pipeline.run(spark, f"read {path}")


@query("vector_partition_files", "SELECT o_orderstatus part, count(*) n, CAST(sum(o_custkey) AS BIGINT) s FROM orders GROUP BY 1")
def vector_partition_files(spark, sf_dir):  # noqa: ANN001, ANN201
    path = shared_path(spark)
    vector.partition(table(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("o_orderstatus").cast("string").alias("part")).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("convert_vector", f"WITH {NAMED}")
def convert_vector(spark, sf_dir):  # noqa: ANN001, ANN201
    """A GeoJSON document as a text sequence, by the files' endings."""
    path = shared_path(spark)
    geojson.write(_layer(spark, sf_dir), f"{path}.geojson")
    datasets.convert(spark, f"{path}.geojson", f"{path}.geojsonl")
    return _shown(datasets.open_dataset(spark, f"{path}.geojsonl").df)


@query("convert_shapefile", f"WITH {PTS} SELECT x, y, CAST(z AS DOUBLE) z, c_name AS name FROM pts JOIN customer ON c_custkey = fid")
def convert_shapefile(spark, sf_dir):  # noqa: ANN001, ANN201
    path = shared_path(spark)
    geojson.write(_layer(spark, sf_dir), f"{path}.geojson")
    datasets.convert(spark, f"{path}.geojson", f"{path}.shp")
    df = shapefile.read(spark, f"{path}.shp/*.shp").df
    return df.select(xy(0)("geom").alias("x"), xy(1)("geom").alias("y"), "z", "name")


@query("convert_raster", f'WITH {DEM} SELECT 1 AS level, r "row", c "col", v FROM dem UNION ALL SELECT 0, r, c, v FROM dem')
def convert_raster(spark, sf_dir):  # noqa: ANN001, ANN201
    """A TIFF as one with an overview, and as one without: the cells stay, the overviews go."""
    cells = dem(spark, sf_dir)
    path = shared_path(spark)
    tiff.write(Raster(cells, 40, cells.agg(F.max("row")).first()[0] + 1), f"{path}.tif", tile=32)
    datasets.convert(spark, f"{path}.tif", f"{path}-2.tif", overviews=1)
    datasets.delete_overviews(spark, f"{path}-2.tif", f"{path}-3.tif")
    parts = [tiff.read(spark, f"{path}-{k}.tif").df.select(F.lit(tiff.levels(files.head(spark, f"{path}-{k}.tif", 1 << 20))).alias("level"), "row", "col", "v") for k in (2, 3)]
    return parts[0].unionByName(parts[1])


@query("info_dispatch", f"WITH {DEM} SELECT 'raster' kind, 40 n FROM (SELECT 1) UNION ALL SELECT 'vector', CAST(count(*) AS INT) FROM customer")
def info_dispatch(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    path = shared_path(spark)
    tiff.write(Raster(cells, 40, cells.agg(F.max("row")).first()[0] + 1), f"{path}.tif", tile=64)
    geojson.write(_layer(spark, sf_dir), f"{path}.geojson")
    r, v = datasets.info(spark, f"{path}.tif"), datasets.info(spark, f"{path}.geojson")
    return spark.createDataFrame([(r["kind"], r["width"]), (v["kind"], v["featureCount"])], "kind string, n int")


@query("vector_info_limit", "SELECT c_custkey AS fid, c_name AS name FROM customer ORDER BY c_custkey LIMIT 5")
def vector_info_limit(spark, sf_dir):  # noqa: ANN001, ANN201
    path = f"{shared_path(spark)}.geojson"
    geojson.write(_layer(spark, sf_dir), path)
    found = datasets.info(spark, path, limit=5)["features"]
    return spark.createDataFrame([(x["fid"], x["name"]) for x in found], "fid long, name string")


# --- what is said about layers and rasters ---


@query("vector_info", f"WITH {PTS} SELECT count(*) n, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax, 'x,y,z' fields, 'Point' kind FROM pts")
def vector_info(spark, sf_dir):  # noqa: ANN001, ANN201
    got = vector.info(Layer(points(spark, sf_dir), "pts", "Point"))
    row = (got["featureCount"], *got["extent"], ",".join(f["name"] for f in got["fields"]), got["geometryType"])
    return spark.createDataFrame([row], "n long, xmin double, ymin double, xmax double, ymax double, fields string, kind string")


@query("vector_export_schema", "SELECT * FROM (VALUES ('c_custkey', 'Integer64'), ('c_name', 'String'), ('c_nationkey', 'Integer'), ('c_acctbal', 'Real'), ('c_mktsegment', 'String')) t(name, type)")
def vector_export_schema(spark, sf_dir):  # noqa: ANN001, ANN201
    import json

    fields = json.loads(vector.export_schema(Layer(table(spark, sf_dir, "customer"))))["fields"]
    return spark.createDataFrame([(f["name"], f["type"]) for f in fields], "name string, type string")


@query("vector_create", "SELECT * FROM (VALUES ('a', 'int'), ('b', 'double'), ('fid', 'bigint'), ('geom', 'binary')) t(name, type)")
def vector_create(spark, sf_dir):  # noqa: ANN001, ANN201
    layer = vector.create(spark, "new", ["a:Integer", "b:Real(10.2)"], "Point")
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in layer.df.schema], "name string, type string")


@query("vector_edit", "SELECT 'EPSG:4326' crs, 'MultiPoint' kind, 'v' k, (SELECT count(*) FROM customer) n")
def vector_edit(spark, sf_dir):  # noqa: ANN001, ANN201
    layer = vector.edit(Layer(points(spark, sf_dir), metadata={"old": "x"}), crs="EPSG:4326", geometry_type="MultiPoint", metadata={"k": "v", "old": None})
    n = layer.df.count()
    return spark.createDataFrame([(layer.crs, layer.geometry_type, layer.metadata["k"], n)], "crs string, kind string, k string, n long")


@query("vector_rename_layer", "SELECT * FROM (VALUES (1, 'abc'), (2, 'abc_1'), (3, 'd_e'), (4, 'x'), (5, 'x_1')) t(k, name)")
def vector_rename_layer(spark, sf_dir):  # noqa: ANN001, ANN201
    names = vector.rename_layer(["ÄBC", "abc", "d/e", "X", "x"], ascii_only=True, lower_case=True, filename_compatible=True)
    return spark.createDataFrame(list(enumerate(names, 1)), "k int, name string")


@query("raster_info", f"WITH {DEM} SELECT 40 width, CAST(max(r) + 1 AS INT) height, 1 bands, min(v) min, max(v) max, 100.0 xmin, 500 - 2.0 * (max(r) + 1) ymin, 180.0 xmax, 500.0 ymax, 'Float64' dtype FROM dem")
def raster_info(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    r = Raster(cells, 40, cells.agg(F.max("row")).first()[0] + 1, 1, (100.0, 2.0, 0.0, 500.0, 0.0, -2.0))
    got = raster.info(r)
    band = got["statistics"][0]
    row = (got["width"], got["height"], got["bands"], band["min"], band["max"], *got["extent"], got["dtype"])
    return spark.createDataFrame([row], "width int, height int, bands int, min double, max double, xmin double, ymin double, xmax double, ymax double, dtype string")


@query("raster_edit", "SELECT 'EPSG:32631' crs, 'Int16' dtype, -1.0 nodata, CAST(count(*) AS BIGINT) n FROM part")
def raster_edit(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    r = raster.edit(Raster(cells, 40, 5), crs="EPSG:32631", dtype="Int16", nodata=-1.0)
    return spark.createDataFrame([(r.crs, r.dtype, r.nodata, r.df.count())], "crs string, dtype string, nodata double, n long")


# --- files ---


def _tree(spark):  # noqa: ANN001, ANN202
    """A folder with three small files, one of them of no known format."""
    root = shared_path(spark)
    files.write_bytes(spark, f"{root}/a/x.geojson", b'{"type": "FeatureCollection", "features": []}')
    files.write_bytes(spark, f"{root}/a/y.tif", tiff.encode(np.zeros((1, 2, 2), "u1")))
    files.write_bytes(spark, f"{root}/a/y.tfw", b"1")
    return root


def _names(spark, path):  # noqa: ANN001, ANN202
    rows = [(x["path"].rsplit("/", 1)[-1],) for x in files.listing(spark, path, True) if not x["directory"] and not x["path"].endswith(".crc")]
    return spark.createDataFrame(rows, "name string")


def on_files(name: str, want: list[str]):  # noqa: ANN201
    """A query of the names that an operation on a folder leaves."""
    values = ", ".join(f"('{x}')" for x in want)

    def register(fn):  # noqa: ANN001, ANN202
        @query(name, f"SELECT * FROM (VALUES {values}) t(name)")
        def run(spark, sf_dir):  # noqa: ANN001, ANN202
            root = _tree(spark)
            fn(spark, root)
            return _names(spark, f"{root}/a")

        return run

    return register


on_files("vsi_list", ["x.geojson", "y.tfw", "y.tif"])(lambda spark, root: None)
on_files("vsi_copy", ["x.geojson", "y.tfw", "y.tif", "z.geojson"])(lambda spark, root: files.copy(spark, f"{root}/a/x.geojson", f"{root}/a/z.geojson"))
on_files("vsi_move", ["y.tfw", "y.tif", "z.geojson"])(lambda spark, root: files.move(spark, f"{root}/a/x.geojson", f"{root}/a/z.geojson"))
on_files("vsi_delete", ["y.tfw", "y.tif"])(lambda spark, root: files.delete(spark, f"{root}/a/x.geojson"))
on_files("dataset_copy", ["n.tfw", "n.tif", "x.geojson", "y.tfw", "y.tif"])(lambda spark, root: files.copy_dataset(spark, f"{root}/a/y.tif", f"{root}/a/n.tif"))
on_files("dataset_rename", ["n.tfw", "n.tif", "x.geojson"])(lambda spark, root: files.copy_dataset(spark, f"{root}/a/y.tif", f"{root}/a/n.tif", True))
on_files("dataset_delete", ["x.geojson"])(lambda spark, root: files.delete_dataset(spark, f"{root}/a/y.tif"))


@query("vsi_sync", "SELECT * FROM (VALUES (1, 'x.geojson'), (1, 'y.tfw'), (1, 'y.tif'), (2, 'y.tfw')) t(turn, name)")
def vsi_sync(spark, sf_dir):  # noqa: ANN001, ANN201
    """Twice: the second time only what has changed is copied."""
    root = _tree(spark)
    out = [(1, n) for n in files.sync(spark, f"{root}/a", f"{root}/b") if not n.endswith(".crc")]
    files.write_bytes(spark, f"{root}/a/y.tfw", b"12")
    out += [(2, n) for n in files.sync(spark, f"{root}/a", f"{root}/b") if not n.endswith(".crc")]
    return spark.createDataFrame(out, "turn int, name string")


@query("dataset_identify", "SELECT * FROM (VALUES ('x.geojson', 'GeoJSON'), ('y.tif', 'TIFF')) t(name, format)")
def dataset_identify(spark, sf_dir):  # noqa: ANN001, ANN201
    root = _tree(spark)
    return files.identify(spark, f"{root}/a").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "format")


@query("dataset_check", "SELECT * FROM (VALUES ('bad.tif', false), ('x.geojson', true), ('y.tif', true)) t(name, ok)")
def dataset_check(spark, sf_dir):  # noqa: ANN001, ANN201
    """Whether a reader can read all of a file."""
    root = _tree(spark)
    files.write_bytes(spark, f"{root}/a/bad.tif", b"II*\0\x08\0\0\0")
    paths = [x["path"] for x in files.listing(spark, f"{root}/a") if x["path"].endswith((".tif", ".geojson"))]
    rows = [(p.rsplit("/", 1)[-1], files.check(spark, p) is None) for p in paths]
    return spark.createDataFrame(rows, "name string, ok boolean")

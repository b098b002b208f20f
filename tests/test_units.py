"""Codecs, dialect, operators and plans on small inputs with known results."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import pipeline
from geoloom.functions import geometry as g
from geoloom.functions import pixel
from geoloom.model import Layer, Raster
from geoloom.operators import components, distance, geometry, grid, mdim, raster, stencil, vector, warp
from geoloom.sources import archives, files, geojson, shapefile, tiff, vrt
from geoloom.sql import execute_sql
from geoloom.sql.parser import SqlError
from geoloom.streaming import windowed_zonal

SHAPES = [
    (1, [1.5, -2.0]),
    (2, [[0.0, 0.0], [3.0, 4.0]]),
    (3, [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]),
    (4, [[1.0, 2.0], [3.0, 4.0]]),
    (6, [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]),
    (7, [(1, [1.0, 2.0, 3.0]), (2, [[0.0, 0.0, 1.0], [1.0, 1.0, 2.0]])]),
]


def cells(spark, rows):
    return spark.createDataFrame([(1, r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "band int, row int, col int, v double")


def grid_of(df):
    t = df.toPandas()
    out = np.full((t.row.max() + 1, t.col.max() + 1), np.nan)
    out[t.row, t.col] = t.v
    return out


@pytest.mark.parametrize("shape", SHAPES)
def test_wkb_round_trip(shape):
    assert g.from_wkb(g.to_wkb(shape)) == shape


def test_measures():
    assert g.area(SHAPES[2]) == 15.0
    assert g.envelope(SHAPES[1]) == (0.0, 0.0, 3.0, 4.0)
    assert g.to_wkt(SHAPES[0]) == "POINT (1.5 -2)"
    assert g.convex_hull((4, [[0, 0], [2, 0], [1, 1], [2, 2], [0, 2]]))[1][0][0] == [0, 0]
    assert g.simplify_line([[0, 0], [1, 0.01], [2, 0]], 0.1) == [[0, 0], [2, 0]]
    assert g.clip((2, [[-1.0, 0.5], [3.0, 0.5]]), (0, 0, 1, 1)) == (2, [[0.0, 0.5], [1.0, 0.5]])
    assert g.problems((3, [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]])) == "a ring crosses itself"
    assert g.force_to((1, [1, 2]), "MultiPoint") == (4, [[1, 2]])
    assert g.force_to((4, [[1, 2], [3, 4]]), "Point") is None


def test_point_wkb_is_exact(spark):
    xs = [0.0, 1.0, -1.0, 0.1, 1e300, -3.5e-12, 123456789.125, 2.0**52 + 1]
    df = spark.createDataFrame([(x, -x) for x in xs], "x double, y double")
    for r in df.select("x", "y", g.point_wkb(F.col("x"), F.col("y")).alias("w")).collect():
        assert g.from_wkb(bytes(r["w"])) == (1, [r["x"], r["y"]])


def test_dialect_rules(spark):
    df = spark.createDataFrame([(1, "Abc", 5, None), (2, "abC", 0, 2.5)], "fid long, s string, n int, r double")
    assert execute_sql(df, "SELECT COUNT(*) AS n FROM t WHERE s = 'ABC'").first()["n"] == 2
    assert [r["q"] for r in execute_sql(df, "SELECT 7 / n AS q FROM t ORDER BY fid").collect()] == [1, 2147483647]
    assert execute_sql(df, "SELECT fid FROM t WHERE r NOT IN (1, NULL)").count() == 1
    assert execute_sql(df, "SELECT fid FROM t ORDER BY r").first()["fid"] == 1
    for bad in ("SELECT nope FROM t", "SELECT s, COUNT(*) FROM t", "SELECT * FROM t GROUP BY s", "SELECT s FROM a JOIN b", "SELECT fid FROM t WHERE s > 1"):
        with pytest.raises(SqlError):
            execute_sql(df, bad).collect()


def test_letters_fold_in_ascii_only(spark):
    df = spark.createDataFrame([("Éa",), ("éA",), ("éabcde",), ("ÉABCDE",)], "n string")
    found = lambda where: sorted(r["n"] for r in execute_sql(df, f"SELECT n FROM t WHERE {where}").collect())
    assert found("n = 'éa'") == ["éA"] and found("n = 'éabcde'") == ["éabcde"] and found("n = 'éABCDe'") == ["éabcde"]
    assert found("n ILIKE 'ÉABC%'") == ["ÉABCDE"] and found("n IN ('ÉA', 'x')") == ["Éa"]


def test_equality_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("A", 1), ("b", 2)], "s string, n int").write.parquet(str(tmp_path / "t"))
    plan = execute_sql(spark.read.parquet(str(tmp_path / "t")), "SELECT n FROM t WHERE s = 'a'")._jdf.queryExecution().toString()
    assert "In(s, [" in plan and "ReadSchema: struct<s:string,n:int>" in plan


def test_terrain_by_hand(spark):
    flat = cells(spark, [[c for c in range(4)] for _ in range(4)])  # rises by 1 to the east
    assert np.allclose(grid_of(stencil.slope(flat)), 45.0)
    assert np.allclose(grid_of(stencil.aspect(flat)), 270.0)
    assert np.allclose(grid_of(stencil.tpi(flat)), 0.0)
    assert np.allclose(grid_of(stencil.roughness(flat)), 2.0)
    hole = cells(spark, [[1, 1, 1], [1, None, 1], [1, 1, 1]])
    out = grid_of(stencil.slope(hole))
    assert np.isnan(out[1, 1]) and out[0, 0] == 0.0
    for variant in ("regular", "combined", "igor", "multidirectional"):
        v = grid_of(stencil.hillshade(flat, variant=variant))
        assert ((v >= 1) & (v <= 255)).all()


def test_pixel_functions(spark):
    df = spark.createDataFrame([([1.0, None, 4.0],), ([2.0, 2.0, 8.0],)], "v array<double>")
    got = df.select(*[pixel.apply(n, F.col("v")).alias(n) for n in ("sum", "mean", "median", "mode", "min", "max", "geometric_mean")], pixel.apply("sum", F.col("v"), True).alias("all")).collect()
    assert got[0]["sum"] == 5.0 and got[0]["mean"] == 2.5 and got[0]["median"] == 2.5 and got[0]["all"] is None
    assert got[1]["mode"] == 2.0 and got[1]["max"] == 8.0 and got[1]["all"] == 12.0
    two = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],)], "v array<double>").select(pixel.apply("div", F.col("v")).alias("d")).collect()
    assert two[0]["d"] == math.inf and math.isnan(two[1]["d"])


def test_reclassify_refuses_unmapped(spark):
    df = cells(spark, [[1, 2]])
    with pytest.raises(Exception, match="no mapping"):
        df.select(raster.reclassify(F.col("v"), "1=5")).collect()


def test_store_rules(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (300.0,)], "v double")
    assert [r[0] for r in df.select(raster.store(F.col("v"), "Byte")).collect()] == [3.0, 0.0, 255.0]
    assert [r[0] for r in df.select(raster.store(F.col("v"), "Int16")).collect()] == [3.0, -3.0, 300.0]


def test_components_over_tiles(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 2, (13, 17))
    whole = components._label(image.astype(float), np.ones(image.shape, bool), False)
    got = components.components(cells(spark, image.tolist()), 17, tile=4).toPandas()
    want = {(r, c): whole[r, c] for r in range(13) for c in range(17)}
    assert all(want[(r, c)] == label for r, c, label in zip(got.row, got.col, got.label, strict=True))
    eight = components.components(cells(spark, image.tolist()), 17, True, tile=4).toPandas()
    assert eight.label.nunique() <= got.label.nunique()


def test_rings_and_sieve(spark):
    df = cells(spark, [[1, 1, 1, 1], [1, 2, 2, 1], [1, 1, 1, 1]])
    rings = {r["label"]: r["rings"] for r in components.rings(df, 4).collect()}
    assert len(rings[0]) == 2 and len(rings[5]) == 1
    assert set(np.unique(grid_of(components.sieve(df, 4, 3)))) == {1.0}


def test_proximity_is_exact(spark):
    rng = np.random.default_rng(5)
    image = (rng.random((9, 11)) < 0.1).astype(int)
    image[4, 4] = 1
    got = grid_of(distance.proximity(cells(spark, image.tolist())))
    ys, xs = np.nonzero(image)
    want = np.array([[np.hypot(ys - r, xs - c).min() for c in range(11)] for r in range(9)])
    assert np.allclose(got, want)


def test_viewshed_wall(spark):
    got = grid_of(distance.viewshed(cells(spark, [[0, 0, 9, 0, 0]]), [(0, 0)]).withColumnRenamed("n", "v"))
    assert got.tolist() == [[1, 1, 1, 0, 0]]


def test_delaunay_is_linear(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(k, float(x), float(y), float(2 * x + 3 * y + 1)) for k, (x, y) in enumerate(rng.random((60, 2)) * 100)] + [(60 + k, x, y, 2 * x + 3 * y + 1.0) for k, (x, y) in enumerate([(0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (100.0, 100.0)])], "fid long, x double, y double, z double")
    out = grid.linear(grid.nodes(spark, 9, 9, 0, 0, 11, 11), pts, 5.0).toPandas()
    assert np.allclose(out.v, 2 * (out.i + 0.5) * 11 + 3 * (out.j + 0.5) * 11 + 1)


def test_linear_against_all_triangles(spark):
    """The plane through the triangle around a node whose circle holds no other point."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    xy, z = rng.random((22, 2)) * 100, rng.random(22) * 10
    pts = spark.createDataFrame([(k, float(xy[k, 0]), float(xy[k, 1]), float(z[k])) for k in range(22)], "fid long, x double, y double, z double")
    out = {(r["i"], r["j"]): r["v"] for r in grid.linear(grid.nodes(spark, 6, 6, 20, 20, 10, 10), pts, 0.0, nodata=-1.0).collect()}
    found = {}
    for t in combinations(range(22), 3):
        a, b, c = xy[list(t)]
        m = np.array([[*(b - a)], [*(c - a)]])
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        centre = a + np.linalg.solve(2 * m, [(b - a) @ (b - a), (c - a) @ (c - a)])
        if (np.hypot(*(xy - centre).T) < np.hypot(*(a - centre)) - 1e-9).any():
            continue
        for i in range(6):
            for j in range(6):
                w = np.linalg.solve(m.T, np.array([20 + 10 * (i + 0.5), 20 + 10 * (j + 0.5)]) - a)
                if min(*w, 1 - w.sum()) >= 0:
                    found[i, j] = z[t[0]] * (1 - w.sum()) + z[t[1]] * w[0] + z[t[2]] * w[1]
    assert found and all(abs(out[k] - v) < 1e-6 for k, v in found.items())


def test_palette_against_all_colours(spark):
    rng = np.random.default_rng(6)
    rgb = rng.integers(0, 256, (300, 3))
    df = spark.createDataFrame([(k // 20, k % 20, *map(int, c)) for k, c in enumerate(rgb)], "row int, col int, r int, g int, b int")
    out, palette = raster.rgb_to_palette(df, 12)
    got = {(r["row"], r["col"]): r["v"] for r in out.collect()}
    near = ((rgb[:, None, :] - np.array(palette)[None]) ** 2).sum(2).argmin(1)
    assert len(palette) == 12 and all(got[k // 20, k % 20] == near[k] for k in range(300))


def test_tiff_writer(spark, tmp_path):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 200, (2, 45, 70)).astype(float)
    df = spark.createDataFrame([(b + 1, r, c, float(values[b, r, c])) for b in range(2) for r in range(45) for c in range(70) if not (r < 16 and c < 16)], "band int, row int, col int, v double")
    for big in (False, True):
        path = f"file://{tmp_path}/{big}.tif"
        tiff.write(Raster(df, 70, 45, 2, (5.0, 2.0, 0.0, 9.0, 0.0, -2.0), None, "Byte", 255.0), path, tile=16, overviews=2, big=big)
        r = tiff.read(spark, path)
        assert (r.width, r.height, r.bands, r.dtype, r.gt[:2], r.nodata) == (70, 45, 2, "Byte", (5.0, 2.0), 255.0)
        got = tiff.to_array(r.df, 45, 70, 2, "f8", -1.0)
        assert (got[:, :16, :16] == -1).all() and np.array_equal(got[:, 16:], values[:, 16:])  # a tile without cells isn't stored
        assert tiff.read(spark, path, level=2).width == 18
    with pytest.raises(ValueError):
        tiff.read(spark, f"file://{tmp_path}/*.tif")


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubicspline", "lanczos", "average", "nearest"])
def test_resize_keeps_constants(spark, method):
    out = grid_of(warp.resize(cells(spark, [[7.0] * 6 for _ in range(5)]), (5, 6), (9, 4), method))
    assert out.shape == (9, 4) and np.allclose(out, 7.0)


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(9.0, 48.0), (11.5, -33.0)], "x double, y double")
    e, n = geometry.transform("EPSG:4326", "EPSG:32632")(F.col("x"), F.col("y"))
    there = df.select("x", "y", e.alias("e"), n.alias("n"))
    lon, lat = geometry.transform("EPSG:32632", "EPSG:4326")(F.col("e"), F.col("n"))
    for r in there.select("*", lon.alias("lon"), lat.alias("lat")).collect():
        assert abs(r["lon"] - r["x"]) < 1e-7 and abs(r["lat"] - r["y"]) < 1e-7
    assert abs(there.first()["e"] - 500000.0) < 1e-6 and abs(there.first()["n"] - 5316300.0) < 1000


def test_segmentize_both_ways():
    ring = [[0.0, 0.0], [10.0, 3.0]]
    assert geometry._dense(ring, 2.0) == geometry._dense(ring[::-1], 2.0)[::-1]


def test_set_geom_type_and_explode(spark):
    df = spark.createDataFrame([(1, g.to_wkb((4, [[1.0, 2.0], [3.0, 4.0]]))), (2, None)], "fid long, geom binary")
    parts = geometry.explode_collections(df).orderBy("fid", "pos").collect()
    assert [r["pos"] for r in parts] == [0, 1, None]
    multi = geometry.set_geom_type(df.filter("fid = 1"), "GeometryCollection").first()["geom"]
    assert g.from_wkb(bytes(multi))[0] == 7


def test_geojson_round_trip(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": 4, "properties": {"a": 1, "b": "x", "c": [1, 2.5], "d": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"a": 2.5, "d": "2024-01-02"}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    layer = geojson.read(spark, str(tmp_path / "a.geojson"))
    kinds = {f.name: f.dataType.simpleString() for f in layer.df.schema}
    assert kinds["a"] == "double" and kinds["c"] == "array<double>" and kinds["d"] == "date"
    geojson.write_seq(layer.df.drop("d"), str(tmp_path / "out"))
    again = geojson.read_seq(spark, str(tmp_path / "out")).df
    assert again.count() == 2 and again.filter("fid = 4").first()["env"]["xmin"] == 1.0


def test_inference_lattice():
    assert geojson.merge("int", "real") == "real" and geojson.merge("date", "datetime") == "datetime"
    assert geojson.merge("int", "string") == "json" and geojson.merge("ints", "real") == "reals"
    assert geojson.merge("date", "time") == "json" and geojson.merge("bool", "int") == "int"


def test_esri_and_topojson(spark, tmp_path):
    esri = {"geometryType": "esriGeometryPolygon", "fields": [{"name": "t", "type": "esriFieldTypeDate"}], "features": [{"attributes": {"t": 0}, "geometry": {"rings": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}}]}
    (tmp_path / "e.json").write_text(json.dumps(esri))
    row = geojson.read_esri(spark, str(tmp_path / "e.json")).df.first()
    assert g.from_wkb(bytes(row["geom"]))[0] == 3 and str(row["t"]).startswith("1970-01-01")
    topo = {"type": "Topology", "transform": {"scale": [1, 1], "translate": [10, 0]}, "arcs": [[[0, 0], [1, 0], [0, 1]]], "objects": {"l": {"type": "LineString", "arcs": [0]}}}
    (tmp_path / "t.json").write_text(json.dumps(topo))
    assert g.from_wkb(bytes(geojson.read_topojson(spark, str(tmp_path / "t.json"))["l"].df.first()["geom"])) == (2, [[10.0, 0.0], [11.0, 0.0], [11.0, 1.0]])


@pytest.mark.parametrize("compress", [True, False])
def test_tiff_round_trip(spark, tmp_path, compress):
    values = np.arange(2 * 70 * 5, dtype="f4").reshape(2, 70, 5)
    (tmp_path / "a.tif").write_bytes(tiff.encode(values, (100.0, 2.0, 0.0, 50.0, 0.0, -2.0), 3.0, compress))
    r = tiff.read(spark, str(tmp_path / "a.tif"))
    assert (r.width, r.height, r.bands, r.dtype, r.gt[0], r.gt[5]) == (5, 70, 2, "Float32", 100.0, -2.0)
    assert r.df.filter("v is null").count() == 1
    assert np.array_equal(tiff.to_array(r.df, 70, 5, 2, "f4", 3.0), values)


def test_shapefile(spark, tmp_path):
    shp, dbf = shapefile.encode_points([(1.0, 2.0, 7, "ab"), (3.0, 4.0, None, "c")], [("N", "N", 5, 0), ("S", "C", 4, 0)])
    (tmp_path / "p.shp").write_bytes(shp)
    (tmp_path / "p.dbf").write_bytes(dbf)
    rows = shapefile.read(spark, str(tmp_path / "p.shp")).df.orderBy("fid").collect()
    assert [(r["N"], r["S"], r["env"]["xmin"]) for r in rows] == [(7, "ab", 1.0), (None, "c", 3.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "a" / "y.tif").write_bytes(tiff.encode(np.zeros((1, 2, 2), "u1")))
    found = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in files.identify(spark, str(tmp_path / "a")).collect()}
    assert found == {"x.geojson": "GeoJSON", "y.tif": "TIFF"}
    assert files.sync(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b") == ["x.geojson", "y.tif"]
    assert files.sync(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b") == []
    files.move(spark, f"file://{tmp_path}/b/y.tif", f"file://{tmp_path}/b/z.tif")
    files.delete(spark, f"file://{tmp_path}/b/x.geojson")
    assert [x["path"].rsplit("/", 1)[-1] for x in files.listing(spark, f"file://{tmp_path}/b")] == ["z.tif"]


def test_pipeline_language(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 3.0, 4.0, "b")], "fid long, x double, y double, s string")
    text = f"read in ! make-point ! swap-xy ! filter --where \"s = 'B'\" ! write {tmp_path}/out.geojsonl --overwrite"
    assert pipeline.run(spark, text, {"in": df}).first()["env"]["xmin"] == 4.0
    assert geojson.read_seq(spark, f"{tmp_path}/out.geojsonl").df.count() == 1
    pipeline.save("read in ! limit 1", str(tmp_path / "p.json"))
    assert pipeline.load(spark, str(tmp_path / "p.json"), {"in": df}).count() == 1
    for bad in ("filter --where x", "read in ! nope", "read in ! write a ! limit 1"):
        with pytest.raises(ValueError):
            pipeline.run(spark, bad, {"in": df})


def test_layers(spark):
    layer = vector.create(spark, "new", ["a:Integer", "b:Real(10.2)", "c:String"], "Point")
    assert [f["type"] for f in json.loads(vector.export_schema(layer))["fields"]] == ["Integer", "Real", "String"]
    assert vector.info(layer)["featureCount"] == 0
    assert vector.edit(layer, crs="EPSG:4326", metadata={"k": "v"}).metadata == {"k": "v"}
    assert vector.rename_layer(["Äb/c", "ab_c"], ascii_only=True, lower_case=True, filename_compatible=True) == ["ab_c", "ab_c_1"]
    assert isinstance(layer, Layer)


def test_update_ignores_double_keys(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "q")], "k int, v string")
    got = sorted((r["k"] or 0, r["v"]) for r in vector.update(t, s, ["k"], "merge", ["v"]).collect())
    assert got == [(0, "n"), (1, "a"), (1, "b"), (2, "y"), (3, "z")]
    t = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "fid long, k int, v string")
    s = spark.createDataFrame([(2, 30, "x"), (9, 10, "y"), (5, 25, "z"), (5, 25, "w")], "fid long, k int, v string")
    rows = lambda mode: sorted((r["fid"], r["k"], r["v"]) for r in vector.update(t, s, ["k"], mode, ["v"]).collect())
    assert rows("merge") == [(1, 10, "y"), (2, 20, "b"), (3, 25, "w"), (4, 30, "x")]
    assert rows("append_only") == [(1, 10, "a"), (2, 20, "b"), (3, 25, "w"), (4, 30, "x")]
    assert rows("update_only") == [(1, 10, "y"), (2, 20, "b")]


def test_mdim(spark):
    df = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(3) for j in range(4)], "i0 int, i1 int, v double")
    dims = [mdim.Dimension("Y", 3, 30.0, -1.0), mdim.Dimension("X", 4, 10.0, 1.0)]
    one, rest = mdim.subset(df, dims, "Y(29)")
    assert sorted(r["v"] for r in one.collect()) == [10.0, 11.0, 12.0, 13.0] and [d.name for d in rest] == ["X"]
    with pytest.raises(ValueError):
        mdim.mosaic([(df, dims[0]), (df, mdim.Dimension("Y", 3, 0.0, 2.0))])


def test_stream(spark, tmp_path):
    ev = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 9, 3.0), ("2024-01-01 02:00:00", 2, 1.0)], "t string, user_id long, value double").select(F.to_timestamp("t").alias("ts"), "user_id", "value")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = windowed_zonal(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.format("memory").queryName("zonal_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {(r["zone"], r["n"]) for r in spark.table("zonal_stream").collect()} == {(1, 2), (2, 1)}


def test_window_operators_shuffle_twice(spark):
    plan = stencil.slope(cells(spark, [[1, 2], [3, 4]]))._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("Window") == 2


def test_vrt(spark, tmp_path):
    a, b = np.arange(6, dtype="f8").reshape(1, 2, 3), np.full((1, 2, 2), 9.0)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a))
    (tmp_path / "b.tif").write_bytes(tiff.encode(b))
    xml = vrt.write(4, 2, [(f"{tmp_path}/a.tif", 1, (0, 0, 3, 2), (0, 0, 3, 2)), (f"{tmp_path}/b.tif", 1, (0, 0, 2, 2), (2, 0, 2, 2))], (0, 1, 0, 0, 0, 1))
    (tmp_path / "m.vrt").write_text(xml)
    r = vrt.read(spark, str(tmp_path / "m.vrt"))
    assert (r.width, r.height) == (4, 2) and grid_of(r.df).tolist() == [[0, 1, 9, 9], [3, 4, 9, 9]]
    assert raster.index([("m", r)], spark).first()["xmax"] == 4.0 and raster.edit(r, crs="EPSG:4326").crs == "EPSG:4326"


def test_multidimensional_vrt(spark, tmp_path):
    (tmp_path / "md.vrt").write_text("""<VRTDataset><Group name="/"><Dimension name="Y" size="2"/><Dimension name="X" size="3"/>
      <Array name="X"><DataType>Float64</DataType><DimensionRef ref="X"/><RegularlySpacedValues start="10" increment="2"/></Array>
      <Array name="t"><DataType>Float64</DataType><DimensionRef ref="Y"/><DimensionRef ref="X"/><InlineValues>1 2 3 4 5 6</InlineValues></Array></Group></VRTDataset>""")
    df, dims = vrt.read_arrays(spark, str(tmp_path / "md.vrt"))["t"]
    assert [d.name for d in dims] == ["Y", "X"] and dims[1].label(2) == 14.0
    assert df.filter("i0 = 1 and i1 = 2").first()["v"] == 6.0


def test_archives(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "hello")
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"hi"))
    got = {(r["name"], bytes(r["content"])) for r in archives.members(spark, str(tmp_path / "*.*")).collect()}
    assert got == {("a/b.txt", b"hello"), ("g.txt", b"hi")}

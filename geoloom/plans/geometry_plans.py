"""Queries of the geometry verbs, over rectangles of suppliers and lines, points and rings made from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions.geometry import env_of, geometry_udf, line_wkb, multipoint_wkb, polygon_wkb, to_wkt, vertices
from geoloom.operators import geometry, vector
from geoloom.sql import execute_sql

from .overlay_plans import RECTS, _rects
from .views import PTS, points

R6 = lambda c: F.round(c, 6)
wkt = lambda c: geometry_udf(to_wkt, "string")(c)
n_points = lambda c: geometry_udf(lambda x: sum(1 for _ in vertices(x)), "int")(c)


def _shapes(spark, sf_dir):  # noqa: ANN001, ANN202
    """Points with made geometries: rectangles, every fifth one crossing itself."""
    pts = points(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    plain = polygon_wkb([(x, y), (x, y + 3), (x + 2, y + 3), (x + 2, y), (x, y)])
    crossed = polygon_wkb([(x, y), (x + 2, y + 3), (x + 2, y), (x, y + 3), (x, y)])
    return pts.select("fid", "x", "y", F.when(F.col("fid") % 5 == 0, crossed).otherwise(plain).alias("geom"))


@query("vector_clip", f"WITH {RECTS} SELECT fid, round((least(x0 + w, 25.5) - greatest(x0, 10.5)) * (least(y0 + w, 30.5) - greatest(y0, 8.5)), 6) area, greatest(x0, 10.5) xmin, least(y0 + w, 30.5) ymax FROM z WHERE x0 < 25.5 AND x0 + w > 10.5 AND y0 < 30.5 AND y0 + w > 8.5")
def vector_clip(spark, sf_dir):  # noqa: ANN001, ANN201
    out = geometry.clip(_rects(spark, sf_dir), (10.5, 8.5, 25.5, 30.5))
    return out.select("fid", R6(geometry.area(F.col("geom"))).alias("area"), "env.xmin", "env.ymax")


@query("vector_clip_lines", f"WITH {PTS} SELECT fid, greatest(x - 4, 20.5) x0, least(x + 4, 60.5) x1, y FROM pts WHERE x + 4 > 20.5 AND x - 4 < 60.5 AND y BETWEEN 10.5 AND 70.5")
def vector_clip_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir)
    lines = pts.select("fid", line_wkb([(F.col("x") - 4, F.col("y")), (F.col("x") + 4, F.col("y"))]).alias("geom"))
    out = geometry.clip(lines.withColumn("env", env_of(F.col("geom"))), (20.5, 10.5, 60.5, 70.5))
    return out.select("fid", F.col("env.xmin").alias("x0"), F.col("env.xmax").alias("x1"), F.col("env.ymin").alias("y"))


@query("vector_simplify", f"WITH {PTS} SELECT fid, CAST(CASE WHEN fid % 3 = 2 THEN 3 ELSE 2 END AS INT) n FROM pts")
def vector_simplify(spark, sf_dir):  # noqa: ANN001, ANN201
    x, y = F.col("x"), F.col("y")
    bend = line_wkb([(x, y), (x + 1, y + F.col("fid") % 3 * 0.1), (x + 2, y)])
    return geometry.simplify(points(spark, sf_dir).select("fid", bend.alias("geom")), 0.15).select("fid", n_points("geom").alias("n"))


@query("vector_convex_hull", f"WITH {PTS} SELECT fid, 6.0::DOUBLE area, 5 n FROM pts")
def vector_convex_hull(spark, sf_dir):  # noqa: ANN001, ANN201
    x, y = F.col("x"), F.col("y")
    cloud = multipoint_wkb([(x, y), (x + 1, y + 1), (x + 2, y + 3), (x, y + 3), (x + 2, y), (x + 0.5, y + 2)])
    out = geometry.convex_hull(points(spark, sf_dir).select("fid", cloud.alias("geom")))
    return out.select("fid", R6(geometry.area(F.col("geom"))).alias("area"), n_points("geom").alias("n"))


@query("vector_check_geometry", f"WITH {PTS} SELECT fid, 'a ring crosses itself' problem FROM pts WHERE fid % 5 = 0")
def vector_check_geometry(spark, sf_dir):  # noqa: ANN001, ANN201
    return geometry.check_geometry(_shapes(spark, sf_dir))


@query("vector_set_geom_type", f"WITH {PTS} SELECT fid, 'MULTIPOLYGON' kind FROM pts WHERE fid % 2 = 0")
def vector_set_geom_type(spark, sf_dir):  # noqa: ANN001, ANN201
    x, y = F.col("x"), F.col("y")
    mixed = points(spark, sf_dir).select("fid", F.when(F.col("fid") % 2 == 0, polygon_wkb([(x, y), (x, y + 1), (x + 1, y), (x, y)])).otherwise(line_wkb([(x, y), (x + 1, y)])).alias("geom"))
    out = geometry.set_geom_type(mixed, "MultiPolygon", skip=True)
    return out.select("fid", F.regexp_extract(wkt("geom"), r"^(\w+)", 1).alias("kind"))


@query("vector_set_geom_type_lines", f"WITH {PTS} SELECT fid, 'LINESTRING' kind, 5 n FROM pts")
def vector_set_geom_type_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    out = geometry.set_geom_type(_shapes(spark, sf_dir), "LineString")
    return out.select("fid", F.regexp_extract(wkt("geom"), r"^(\w+)", 1).alias("kind"), n_points("geom").alias("n"))


@query("vector_buffer", f"WITH {PTS} SELECT fid, round(16 * 9 * sin(2 * pi() / 32), 6) area, x - 3 xmin, y + 3 ymax FROM pts")
def vector_buffer(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.functions.geometry import point_wkb

    out = geometry.buffer_point(points(spark, sf_dir).select("fid", point_wkb(F.col("x"), F.col("y")).alias("geom")), 3.0)
    e = env_of(F.col("geom"))
    return out.select("fid", R6(geometry.area(F.col("geom"))).alias("area"), e.alias("e")).select("fid", "area", R6("e.xmin").alias("xmin"), R6("e.ymax").alias("ymax"))


@query("vector_swap_polygons", f"WITH {RECTS} SELECT fid, y0 xmin, x0 ymin, y0 + w xmax, x0 + w ymax, w * w area FROM z")
def vector_swap_polygons(spark, sf_dir):  # noqa: ANN001, ANN201
    out = geometry.swap_xy(_rects(spark, sf_dir))
    return out.select("fid", "env.*", geometry.area(F.col("geom")).alias("area"))


@query("vector_vertices", f"WITH {RECTS} SELECT fid, CAST(k AS INT) seq, x0 + [0, 0, w, w, 0][k + 1] x, y0 + [0, w, w, 0, 0][k + 1] y FROM z, range(5) t(k)")
def vector_vertices(spark, sf_dir):  # noqa: ANN001, ANN201
    return geometry.vertices(_rects(spark, sf_dir))


@query("vector_reproject_utm", f"WITH {PTS} SELECT fid, round(x / 40, 7) lon, round(y / 40 + 40, 7) lat FROM pts")
def vector_reproject_utm(spark, sf_dir):  # noqa: ANN001, ANN201
    """There and back again, through the zone of 0 to 6 degrees east."""
    there = geometry.transform("EPSG:4326", "EPSG:32631")
    back = geometry.transform("EPSG:32631", "EPSG:4326")
    east, north = there(F.col("x") / 40, F.col("y") / 40 + 40)
    moved = points(spark, sf_dir).select("fid", east.alias("e"), north.alias("n"))
    lon, lat = back(F.col("e"), F.col("n"))
    return moved.select("fid", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("vector_combine_geoms", f"WITH {PTS} SELECT CAST(x AS BIGINT) % 7 g, count(*) n, sum(x + 2 * y) s FROM pts GROUP BY 1")
def vector_combine_geoms(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.functions.geometry import point_wkb

    pts = points(spark, sf_dir).withColumn("g", F.col("x").cast("bigint") % 7).withColumn("geom", point_wkb(F.col("x"), F.col("y")))
    place = geometry_udf(lambda p: p[1][0] + 2 * p[1][1], "double")
    each = vector.combine(pts, ["g"]).select("g", F.explode("geoms").alias("geom"))
    return each.groupBy("g").agg(F.count("*").alias("n"), F.sum(place("geom")).alias("s"))


@query("sql_special_fields", f"WITH {PTS} SELECT fid, 'POLYGON' AS kind, CASE WHEN fid % 5 = 0 THEN 0.0 ELSE 6.0 END area, 'POLYGON ((' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ',' head, NULL AS style FROM pts WHERE fid % 5 <> 0 OR x > 10")
def sql_special_fields(spark, sf_dir):  # noqa: ANN001, ANN201
    shapes = _shapes(spark, sf_dir)
    text = "SELECT FID AS fid, GEOMETRY AS kind, GEOM_AREA AS area, GEOM_WKT AS wkt, STYLE AS style FROM shapes WHERE GEOM_AREA > 1 OR x > 10"
    out = execute_sql(shapes, text, "fid")
    return out.select("fid", "kind", R6("area").alias("area"), F.regexp_replace(F.regexp_extract("wkt", r"^([^,]*,)", 1), r"POLYGON \(\(", "POLYGON ((").alias("head"), "style")


@query("sql_secondary_source", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def sql_secondary_source(spark, sf_dir):  # noqa: ANN001, ANN201
    return execute_sql({"region": spark.read.parquet(f"{sf_dir}/region.parquet")}, f"SELECT n_nationkey, n_name FROM '{sf_dir}/nation.parquet'.nation WHERE n_regionkey = 1", opener=spark.read.parquet)


@query("sql_where_extent", f"WITH {PTS} SELECT count(*) n, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax FROM pts WHERE z > 500")
def sql_where_extent(spark, sf_dir):  # noqa: ANN001, ANN201
    """The extent of what a condition leaves."""
    kept = execute_sql(points(spark, sf_dir), "SELECT * FROM pts WHERE z > 500", "fid")
    return vector.extent(kept)

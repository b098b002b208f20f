"""Queries of the vector verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions.cast import lenient
from geoloom.functions.geometry import env_of, geometry_udf, map_vertices, point_wkb, to_wkt
from geoloom.operators import geometry, vector

from .views import PTS, points, table


@query("vector_select_exclude", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def vector_select_exclude(spark, sf_dir):  # noqa: ANN001, ANN201
    return vector.select(table(spark, sf_dir, "customer"), ["C_AcctBal", "c_nationkey", "nope"], exclude=True)


@query("vector_filter_bbox", f"WITH {PTS} SELECT fid, x, y, z FROM pts WHERE z > 0 AND x BETWEEN 20 AND 40 AND y BETWEEN 30 AND 60")
def vector_filter_bbox(spark, sf_dir):  # noqa: ANN001, ANN201
    return vector.filter_rows(points(spark, sf_dir), "z > 0", (20, 30, 40, 60)).drop("env")


@query("vector_concat_union", "SELECT r_regionkey AS key, r_name AS name, CAST(NULL AS INT) AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def vector_concat_union(spark, sf_dir):  # noqa: ANN001, ANN201
    r = table(spark, sf_dir, "region").toDF("key", "name")
    return vector.concat([("region", r), ("nation", table(spark, sf_dir, "nation").toDF("key", "name", "region"))])


@query("vector_concat_tag", "SELECT r_regionkey AS key, r_name AS name, 'region' AS src FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def vector_concat_tag(spark, sf_dir):  # noqa: ANN001, ANN201
    r, n = table(spark, sf_dir, "region").toDF("key", "name"), table(spark, sf_dir, "nation").toDF("key", "name", "region")
    return vector.concat([("region", r), ("nation", n)], strategy="intersection", tag="src")


@query("vector_combine_group", f"WITH {PTS} SELECT CAST(x AS BIGINT) % 7 g, count(*) members, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax, round(sum(z), 6) zsum FROM pts GROUP BY 1")
def vector_combine_group(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir).withColumn("g", F.col("x").cast("bigint") % 7)
    return vector.combine(pts, ["g"], {"zsum": F.round(F.sum("z"), 6)}).select("g", "members", "env.*", "zsum")


#: Target: every customer whose key isn't a multiple of three; source: those whose key isn't a multiple of four.
UPDATED = f"{PTS}, t AS (SELECT fid, x, z FROM pts WHERE fid % 3 <> 0), s AS (SELECT fid, x, z + 1 z FROM pts WHERE fid % 4 <> 0)"


def _update(spark, sf_dir, mode):  # noqa: ANN001, ANN202
    pts = points(spark, sf_dir).select("fid", "x", "z")
    return vector.update(pts.filter("fid % 3 <> 0"), pts.filter("fid % 4 <> 0").withColumn("z", F.col("z") + 1), ["fid"], mode, ["x", "z"])


@query("vector_update_merge", f"WITH {UPDATED} SELECT coalesce(t.fid, s.fid) fid, coalesce(s.x, t.x) x, coalesce(s.z, t.z) z FROM t FULL JOIN s ON t.fid = s.fid")
def vector_update_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    return _update(spark, sf_dir, "merge")


@query("vector_update_only", f"WITH {UPDATED} SELECT t.fid, coalesce(s.x, t.x) x, coalesce(s.z, t.z) z FROM t LEFT JOIN s ON t.fid = s.fid")
def vector_update_only(spark, sf_dir):  # noqa: ANN001, ANN201
    return _update(spark, sf_dir, "update_only")


@query("vector_append_only", f"WITH {UPDATED} SELECT fid, x, z FROM t UNION ALL SELECT fid, x, z FROM s WHERE fid NOT IN (SELECT fid FROM t)")
def vector_append_only(spark, sf_dir):  # noqa: ANN001, ANN201
    return _update(spark, sf_dir, "append_only")


#: Keyed by name: target has twice those whose key is 10 more than a multiple of 30, source two rows of those that end in 1.
BY_NAME = """t AS (SELECT c_custkey + 100 fid, c_name AS name, c_acctbal z FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, 0 FROM customer WHERE c_custkey % 30 = 10),
s AS (SELECT name, min(z) z FROM (SELECT c_name AS name, c_acctbal + 1 z, c_custkey k FROM customer UNION ALL SELECT c_name, c_acctbal - 1, c_custkey FROM customer WHERE c_custkey % 10 = 1) WHERE k % 4 <> 0 GROUP BY 1),
once AS (SELECT name FROM t GROUP BY 1 HAVING count(*) = 1),
new AS (SELECT name, z FROM s WHERE name NOT IN (SELECT name FROM t))"""


@query(
    "vector_update_by_name",
    f"WITH {BY_NAME} SELECT t.fid, t.name, coalesce(s.z, t.z) z FROM t LEFT JOIN once ON once.name = t.name LEFT JOIN s ON s.name = once.name UNION ALL SELECT (SELECT max(fid) FROM t) + row_number() OVER (ORDER BY name), name, z FROM new",
)
def vector_update_by_name(spark, sf_dir):  # noqa: ANN001, ANN201
    """Appended rows take fids after the target's."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("z"))
    target = c.filter("k % 3 <> 0").select((F.col("k") + 100).alias("fid"), "name", "z").unionByName(c.filter("k % 30 = 10").select((F.col("k") + 10_000_000).alias("fid"), "name", F.lit(0.0).alias("z")))
    source = c.withColumn("z", F.col("z") + 1).unionByName(c.filter("k % 10 = 1").withColumn("z", F.col("z") - 1)).filter("k % 4 <> 0")
    return vector.update(target, source.select("name", "z"), ["name"], "merge", ["z"])


HILBERT = f"""
WITH RECURSIVE {PTS}, e AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pts),
h(fid, k, x, y, d) AS (
  SELECT fid, 15, CAST(floor((x - x0) / (x1 - x0) * 65534 + 0.5) AS BIGINT), CAST(floor((y - y0) / (y1 - y0) * 65534 + 0.5) AS BIGINT), CAST(0 AS BIGINT) FROM pts, e
  UNION ALL
  SELECT fid, k - 1,
    CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 65535 - y ELSE y END ELSE x END,
    CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 65535 - x ELSE x END ELSE y END,
    d + (CAST(1 AS BIGINT) << CAST(2 * k AS INT)) * xor(3 * rx, ry)
  FROM (SELECT *, CASE WHEN x & (CAST(1 AS BIGINT) << k) > 0 THEN 1 ELSE 0 END rx, CASE WHEN y & (CAST(1 AS BIGINT) << k) > 0 THEN 1 ELSE 0 END ry FROM h WHERE k >= 0))
SELECT fid, d hilbert FROM h WHERE k = -1
"""


@query("vector_hilbert_key", HILBERT)
def vector_hilbert_key(spark, sf_dir):  # noqa: ANN001, ANN201
    return vector.hilbert_key(points(spark, sf_dir)).select("fid", "hilbert")


@query("vector_sort", HILBERT.replace("SELECT fid, d hilbert FROM h WHERE k = -1", "SELECT fid, row_number() OVER (ORDER BY d, fid) place FROM h WHERE k = -1"))
def vector_sort(spark, sf_dir):  # noqa: ANN001, ANN201
    key = vector.hilbert_key(points(spark, sf_dir)).select("fid", "hilbert")
    return vector.renumber(key.withColumnRenamed("fid", "id"), F.col("hilbert").asc_nulls_last(), F.col("id")).select(F.col("id").alias("fid"), F.col("fid").alias("place"))


@query(
    "vector_set_field_type",
    "SELECT event_id, CAST(coalesce(try_cast(regexp_extract(props, '(\\d+)', 1) AS BIGINT), 0) AS BIGINT) k, CAST(CASE WHEN value >= 0 THEN floor(value + 0.5) ELSE ceil(value - 0.5) END AS INT) value FROM events",
)
def vector_set_field_type(spark, sf_dir):  # noqa: ANN001, ANN201
    ev = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r"(\d+.*)", 1).alias("k"), "value")
    return vector.set_field_type(vector.set_field_type(ev, "integer64", field="K"), "integer", source="real")


@query("vector_partition_key", "SELECT replace(o_orderstatus || '_' || o_orderpriority, ' ', '+') part, count(*) n FROM orders GROUP BY 1")
def vector_partition_key(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws("_", *[F.url_encode(F.col(f)) for f in ("o_orderstatus", "o_orderpriority")])
    return o.groupBy(key.alias("part")).agg(F.count("*").alias("n"))


@query("vector_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def vector_json_fields(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("vector_make_point", f"WITH {PTS} SELECT fid, x xmin, y ymin, 'POINT Z (' || CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) || ' ' || CAST(fid AS BIGINT) || ')' wkt FROM pts")
def vector_make_point(spark, sf_dir):  # noqa: ANN001, ANN201
    made = geometry.make_point(points(spark, sf_dir).drop("env"), "x", "y", "fid")
    return made.select("fid", "env.xmin", "env.ymin", geometry_udf(to_wkt, "string")("geom").alias("wkt"))


@query("vector_swap_xy", f"WITH {PTS} SELECT fid, y xmin, x ymin FROM pts")
def vector_swap_xy(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir)
    made = pts.withColumn("geom", point_wkb(F.col("x"), F.col("y")))
    swapped = geometry_udf(lambda g: map_vertices(g, lambda p: [p[1], p[0], *p[2:]]), "binary")
    return made.select("fid", env_of(swapped("geom")).alias("e")).select("fid", "e.xmin", "e.ymin")


LINES = f"""{PTS}, seg AS (SELECT fid, x, y, lead(x) OVER (ORDER BY fid) x2, lead(y) OVER (ORDER BY fid) y2 FROM pts),
cnt AS (SELECT *, CAST(greatest(floor(sqrt(((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) / 100.0) - 0.01), 0) AS INT) n FROM seg WHERE x2 IS NOT NULL)"""


@query("vector_segmentize", f"WITH {LINES} SELECT fid, CAST(k AS INT) k, round(x + (x2 - x) * k / (n + 1), 6) x, round(y + (y2 - y) * k / (n + 1), 6) y FROM (SELECT *, unnest(range(n + 1)) k FROM cnt)")
def vector_segmentize(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir)
    after = pts.select((F.col("fid") - 1).alias("fid"), F.col("x").alias("x2"), F.col("y").alias("y2"))  # fids are dense
    out = geometry.segmentize_segments(pts.select("fid", "x", "y").join(after, "fid"), 10.0)
    return out.select("fid", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("vector_explode_collections", f"WITH {PTS} SELECT CAST(x AS BIGINT) % 7 g, row_number() OVER (PARTITION BY CAST(x AS BIGINT) % 7 ORDER BY fid) - 1 pos, fid FROM pts")
def vector_explode_collections(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir).withColumn("g", F.col("x").cast("bigint") % 7).withColumn("geom", point_wkb(F.col("x"), F.col("y"), F.col("fid").cast("double")))
    whole = vector.combine(pts, ["g"])
    z = geometry_udf(lambda g: g[1][2], "double")
    return whole.select("g", F.posexplode("geoms").alias("pos", "geom")).select("g", F.col("pos").cast("bigint").alias("pos"), z("geom").cast("bigint").alias("fid"))


@query("vector_geometry_area", f"WITH {PTS} SELECT fid, 6.0 area FROM pts")
def vector_geometry_area(spark, sf_dir):  # noqa: ANN001, ANN201
    made = geometry.make_rectangle(points(spark, sf_dir), F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 3)
    return made.select("fid", geometry.area(F.col("geom")).alias("area"))


@query("vector_reproject_webmercator", f"WITH {PTS} SELECT fid, round((x - 50) * 6378137.0 * pi() / 180, 4) mx, round(6378137.0 * ln(tan(pi() / 4 + (y - 48) * pi() / 360)), 4) my FROM pts")
def vector_reproject_webmercator(spark, sf_dir):  # noqa: ANN001, ANN201
    x, y = geometry.transform("EPSG:4326", "EPSG:3857")(F.col("x") - 50, F.col("y") - 48)
    return points(spark, sf_dir).select("fid", F.round(x, 4).alias("mx"), F.round(y, 4).alias("my"))


@query("vector_lenient_cast", "SELECT o_orderkey, CAST(coalesce(try_cast(regexp_extract(o_orderpriority, '^\\s*([-+]?\\d+)', 1) AS INT), 0) AS INT) p FROM orders")
def vector_lenient_cast(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "orders").select("o_orderkey", lenient(F.col("o_orderpriority"), "string", "integer").alias("p"))


@query("vector_index", f"WITH {PTS} SELECT 'a' AS location, min(x) xmin, min(y) ymin, max(x) xmax, max(y) ymax FROM pts WHERE z > 0 UNION ALL SELECT 'b', min(x), min(y), max(x), max(y) FROM pts WHERE z <= 0")
def vector_index(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.model import Layer

    pts = points(spark, sf_dir)
    return vector.index([("a", Layer(pts.filter("z > 0"))), ("b", Layer(pts.filter("z <= 0")))]).drop("crs")

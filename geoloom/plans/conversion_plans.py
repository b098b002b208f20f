"""Queries between rasters, vectors and arrays, of interpolation and of resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.operators import components, convert, distance, grid, mdim, warp

from .views import DEM, MD, NODES, PTS, dem, dem_bands, md, points, table

R6 = lambda c: F.round(c, 6)


@query("zonal_core", f"WITH {DEM} SELECT CAST(k % 8 AS INT) zone, count(v) count, round(sum(v), 6) sum, round(avg(v), 6) mean, min(v) min, max(v) max, round(var_pop(v), 6) variance, round(stddev_pop(v), 6) stdev FROM dem GROUP BY 1")
def zonal_core(spark, sf_dir):  # noqa: ANN001, ANN201
    out = convert.zonal(dem_bands(spark, sf_dir).withColumn("zone", (F.col("k") % 8).cast("int")))
    return out.select("zone", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("sum", "mean", "variance", "stdev")])


@query("zonal_mode_minority", f"WITH {DEM}, n AS (SELECT CAST(k % 8 AS INT) zone, floor(v) x, count(*) n FROM dem GROUP BY 1, 2) SELECT zone, arg_max(x, (n, x)) mode, arg_min(x, (n, x)) minority, CAST(count(*) AS BIGINT) variety FROM n GROUP BY zone")
def zonal_mode_minority(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).select("row", "col", (F.col("k") % 8).cast("int").alias("zone"), F.floor("v").cast("double").alias("v"))
    return convert.zonal(cells, stats=["mode", "minority", "variety"])


@query("zonal_weighted", f"WITH {DEM} SELECT CAST(k % 8 AS INT) zone, round(sum(v * k) / sum(k), 6) weighted_mean, round(sum(v * k), 4) weighted_sum FROM dem GROUP BY 1")
def zonal_weighted(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumn("zone", (F.col("k") % 8).cast("int"))
    out = convert.zonal(cells, weight="k", stats=["weighted_mean", "weighted_sum"])
    return out.select("zone", R6("weighted_mean").alias("weighted_mean"), F.round("weighted_sum", 4).alias("weighted_sum"))


@query("zonal_extremes", f"WITH {DEM} SELECT CAST(k % 8 AS INT) zone, arg_min(c + 0.5::DOUBLE, (v, r * 40 + c)) min_center_x, arg_max(r + 0.5::DOUBLE, (v, -(r * 40 + c))) max_center_y, round(median(v), 6) median FROM dem GROUP BY 1")
def zonal_extremes(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumn("zone", (F.col("k") % 8).cast("int"))
    out = convert.zonal(cells, stats=["min_center_x", "max_center_y", "median"], width=40)
    return out.select("zone", "min_center_x", "max_center_y", R6("median").alias("median"))


ZONES = "zones AS (SELECT s_suppkey zone, CAST(s_suppkey * 7 % 30 AS DOUBLE) x0, CAST(s_suppkey * 11 % 40 AS DOUBLE) y0, CAST(3 + s_suppkey % 5 AS DOUBLE) w FROM supplier)"


def _zones(spark, sf_dir):  # noqa: ANN001, ANN202
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    x0, y0, w = (k * 7 % 30).cast("double"), (k * 11 % 40).cast("double"), (3 + k % 5).cast("double")
    return s.select(k.alias("zone"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + w).alias("y1"), F.struct(x0.alias("xmin"), y0.alias("ymin"), (x0 + w).alias("xmax"), (y0 + w).alias("ymax")).alias("env"))


INSIDE = "c + 0.5 >= x0 AND c + 0.5 < x0 + w AND r + 0.5 >= y0 AND r + 0.5 < y0 + w"


@query("zonal_polygon", f"WITH {DEM}, {ZONES} SELECT zone, count(*) count, round(sum(v), 6) sum FROM zones JOIN dem ON {INSIDE} GROUP BY zone")
def zonal_polygon(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = convert.zone_cells(_zones(spark, sf_dir)).join(dem(spark, sf_dir), ["row", "col"])
    return convert.zonal(cells, stats=["count", "sum"]).select("zone", "count", R6("sum").alias("sum"))


@query("zonal_polygon_scanline", f"WITH {DEM}, {ZONES} SELECT zone, count(*) count, round(avg(v), 6) mean FROM zones JOIN dem ON {INSIDE} GROUP BY zone")
def zonal_polygon_scanline(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.operators.geometry import make_rectangle

    z = _zones(spark, sf_dir).drop("env")
    shapes = make_rectangle(z, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    cells = convert.polygon_cells(shapes).join(dem(spark, sf_dir), ["row", "col"])
    return convert.zonal(cells, stats=["count", "mean"]).select("zone", "count", R6("mean").alias("mean"))


@query("raster_pixel_info", f"WITH {DEM}, {PTS} SELECT fid, v FROM pts LEFT JOIN dem ON r = floor(y / 2) AND c = floor(x / 3)")
def raster_pixel_info(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir).select("fid", (F.col("x") / 3).alias("x"), (F.col("y") / 2).alias("y"))
    return convert.pixel_info(pts, dem(spark, sf_dir)).select("fid", "v")


@query(
    "raster_pixel_info_bilinear",
    f"WITH {DEM}, {PTS}, q AS (SELECT fid, x / 3 - 0.5 fx, y / 2 - 0.5 fy FROM pts), t AS (SELECT fid, floor(fy) + i rr, floor(fx) + j cc, (CASE WHEN i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) w FROM q, range(2) a(i), range(2) b(j)), s AS (SELECT fid, sum(v * w) / sum(w) v FROM t JOIN dem ON r = rr AND c = cc WHERE w > 0 GROUP BY fid) SELECT pts.fid, round(v, 6) v FROM pts LEFT JOIN s USING (fid)",
)
def raster_pixel_info_bilinear(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir).select("fid", (F.col("x") / 3).alias("x"), (F.col("y") / 2).alias("y"))
    return convert.pixel_info(pts, dem(spark, sf_dir), "bilinear").select("fid", R6("v").alias("v"))


@query("raster_as_features", f'WITH {DEM} SELECT 100 + (c + 0.5) * 2::DOUBLE "CENTER_X", 500 - (r + 0.5) * 2::DOUBLE "CENTER_Y", r "ROW", c "COL", v "BAND_1" FROM dem')
def raster_as_features(spark, sf_dir):  # noqa: ANN001, ANN201
    return convert.as_features(dem(spark, sf_dir), gt=(100.0, 2.0, 0.0, 500.0, 0.0, -2.0))


@query("rasterize_points_last", f'WITH {PTS} SELECT CAST(floor(y / 4) AS INT) "row", CAST(floor(x / 4) AS INT) "col", arg_max(z, fid) v FROM pts GROUP BY 1, 2')
def rasterize_points_last(spark, sf_dir):  # noqa: ANN001, ANN201
    return convert.rasterize_points(points(spark, sf_dir), F.col("z"), (0.0, 4.0, 0.0, 0.0, 0.0, 4.0))


@query("rasterize_points_add", f'WITH {PTS} SELECT CAST(floor(y / 4) AS INT) "row", CAST(floor(x / 4) AS INT) "col", CAST(count(*) AS BIGINT) v FROM pts GROUP BY 1, 2')
def rasterize_points_add(spark, sf_dir):  # noqa: ANN001, ANN201
    out = convert.rasterize_points(points(spark, sf_dir), F.lit(1), (0.0, 4.0, 0.0, 0.0, 0.0, 4.0), add=True)
    return out.withColumn("v", F.col("v").cast("bigint"))


@query("rasterize_polygons", f'WITH {DEM}, {ZONES} SELECT r "row", c "col", max(zone) v FROM zones JOIN (SELECT CAST(i AS INT) r, CAST(j AS INT) c FROM range(60) a(i), range(60) b(j)) ON {INSIDE} GROUP BY 1, 2')
def rasterize_polygons(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.operators.geometry import make_rectangle

    z = _zones(spark, sf_dir).drop("env").withColumn("burn", F.col("zone"))
    return convert.rasterize_polygons(make_rectangle(z, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


@query(
    "rasterize_lines",
    f"""WITH {PTS}, l AS (SELECT a.fid, a.x, a.y, a.z, b.x x2, b.y y2, CAST(greatest(abs(floor(b.x) - floor(a.x)), abs(floor(b.y) - floor(a.y))) AS INT) n FROM pts a JOIN pts b ON b.fid = a.fid + 1),
    s AS (SELECT *, CASE WHEN n > 0 THEN k / n ELSE 0 END part FROM (SELECT *, unnest(range(n + 1)) k FROM l))
    SELECT CAST(floor(y + (y2 - y) * part) AS INT) "row", CAST(floor(x + (x2 - x) * part) AS INT) "col", arg_max(z, fid) v FROM s GROUP BY 1, 2""",
)
def rasterize_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = points(spark, sf_dir)
    after = pts.select((F.col("fid") - 1).alias("fid"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return convert.rasterize_lines(pts.select("fid", "x", "y", "z").join(after, "fid"), F.col("z"))


@query("rasterize_all_touched", f'WITH {DEM}, {ZONES} SELECT r "row", c "col", max(zone) v FROM (SELECT zone, x0 + 0.25 x0, y0 + 0.25 y0, w FROM zones) JOIN (SELECT CAST(i AS INT) r, CAST(j AS INT) c FROM range(60) a(i), range(60) b(j)) ON c + 1 > x0 AND c < x0 + w AND r + 1 > y0 AND r < y0 + w GROUP BY 1, 2')
def rasterize_all_touched(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.operators.geometry import make_rectangle

    z = _zones(spark, sf_dir).drop("env").withColumn("burn", F.col("zone"))
    moved = [F.col(c) + 0.25 for c in ("x0", "y0", "x1", "y1")]
    return convert.rasterize_polygons(make_rectangle(z, *moved), all_touched=True)


@query("rasterize_invert", f'WITH {ZONES} SELECT CAST(i AS INT) "row", CAST(j AS INT) "col", 9.0::DOUBLE v FROM range(70) a(i), range(60) b(j) WHERE NOT EXISTS (SELECT 1 FROM zones WHERE j + 0.5 >= x0 AND j + 0.5 < x0 + w AND i + 0.5 >= y0 AND i + 0.5 < y0 + w)')
def rasterize_invert(spark, sf_dir):  # noqa: ANN001, ANN201
    from geoloom.operators.geometry import make_rectangle

    z = _zones(spark, sf_dir).drop("env")
    return convert.rasterize_inverse(make_rectangle(z, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), (70, 60), 9.0)


@query("zonal_all_touched", f"WITH {DEM}, {ZONES} SELECT zone, count(*) count, round(sum(v), 6) sum FROM (SELECT zone, x0 + 0.25 x0, y0 + 0.25 y0, w FROM zones) JOIN dem ON c + 1 > x0 AND c < x0 + w AND r + 1 > y0 AND r < y0 + w GROUP BY zone")
def zonal_all_touched(spark, sf_dir):  # noqa: ANN001, ANN201
    z = _zones(spark, sf_dir)
    e = F.struct(*[(F.col(c) + 0.25).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("xmin", "ymin", "xmax", "ymax"), strict=True)])
    cells = convert.zone_cells(z.withColumn("env", e), all_touched=True).join(dem(spark, sf_dir), ["row", "col"])
    return convert.zonal(cells, stats=["count", "sum"]).select("zone", "count", R6("sum").alias("sum"))


@query("zonal_values", f"WITH {DEM} SELECT CAST(k % 8 AS INT) zone, count(*) n, round(sum(v), 6) total, round(sum((c + 0.5) * v), 4) x, round(sum((r + 0.5) * v), 4) y, sum(k)::DOUBLE weights, arg_min(v, r * 40 + c) first FROM dem GROUP BY 1")
def zonal_values(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumn("zone", (F.col("k") % 8).cast("int"))
    out = convert.zonal(cells, weight="k", stats=["values", "center_x", "center_y", "weights"], width=40)
    total = lambda *c: F.aggregate(F.zip_with(*c, lambda a, b: a * b) if len(c) == 2 else F.col(c[0]), F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        "zone", F.size("values").cast("long").alias("n"), R6(total("values")).alias("total"), F.round(total("center_x", "values"), 4).alias("x"), F.round(total("center_y", "values"), 4).alias("y"),
        total("weights").alias("weights"), F.get("values", F.lit(0)).alias("first"),
    )


@query("zonal_weighted_variance", f"WITH {DEM}, m AS (SELECT CAST(k % 8 AS INT) zone, sum((v + 1e6) * k) / sum(k) mean FROM dem GROUP BY 1) SELECT zone, round(sum(k * (v + 1e6 - mean) * (v + 1e6 - mean)) / sum(k), 4) weighted_variance, round(sqrt(sum(k * (v + 1e6 - mean) * (v + 1e6 - mean)) / sum(k)), 5) weighted_stdev FROM dem JOIN m ON zone = k % 8 GROUP BY 1")
def zonal_weighted_variance(spark, sf_dir):  # noqa: ANN001, ANN201
    """Far from zero, where a difference of large sums would say nothing."""
    cells = dem_bands(spark, sf_dir).withColumns({"zone": (F.col("k") % 8).cast("int"), "v": F.col("v") + 1e6})
    out = convert.zonal(cells, weight="k", stats=["weighted_variance", "weighted_stdev"])
    return out.select("zone", F.round("weighted_variance", 4).alias("weighted_variance"), F.round("weighted_stdev", 5).alias("weighted_stdev"))


@query("zonal_frac", f"WITH {DEM}, n AS (SELECT CAST(k % 8 AS INT) zone, floor(v) x, count(*) n FROM dem GROUP BY 1, 2) SELECT zone, count(*) variety, CAST(sum(n) AS BIGINT) cells, sum(x * n) weighted FROM n GROUP BY 1")
def zonal_frac(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).select("row", "col", (F.col("k") % 8).cast("int").alias("zone"), F.floor("v").cast("double").alias("v"))
    out = convert.zonal(cells, stats=["unique", "frac"])
    both = F.aggregate(F.zip_with("unique", "frac", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return out.select("zone", F.size("unique").cast("long").alias("variety"), F.aggregate("frac", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("cells"), both.alias("weighted"))


@query("zonal_max_center", f"WITH {DEM} SELECT CAST(k % 8 AS INT) zone, arg_min(r + 0.5::DOUBLE, (v, r * 40 + c)) min_center_y, arg_max(c + 0.5::DOUBLE, (v, -(r * 40 + c))) max_center_x FROM dem GROUP BY 1")
def zonal_max_center(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumn("zone", (F.col("k") % 8).cast("int"))
    return convert.zonal(cells, stats=["min_center_y", "max_center_x"], width=40)


# --- components ---

CLASSES = f"""{DEM}, cls AS (SELECT r, c, CASE WHEN k > 25 THEN 1 ELSE 0 END v FROM dem),
lab(r, c, v, label) AS (
  SELECT r, c, v, r * 40 + c FROM cls
  UNION
  SELECT n.r, n.c, n.v, l.label FROM lab l JOIN cls n ON n.v = l.v AND ((n.r = l.r AND abs(n.c - l.c) = 1) OR (n.c = l.c AND abs(n.r - l.r) = 1)) WHERE l.label < n.r * 40 + n.c),
comp AS (SELECT r, c, v, CAST(min(label) AS BIGINT) label FROM lab GROUP BY r, c, v)"""


def _classes(spark, sf_dir):  # noqa: ANN001, ANN202
    return dem(spark, sf_dir, "p_size").withColumn("v", F.when(F.col("v") > 25, 1.0).otherwise(0.0))


@query("raster_polygonize", f"WITH RECURSIVE {CLASSES} SELECT label, CAST(max(v) AS DOUBLE) v, count(*) cells, min(c) xmin, min(r) ymin, max(c) + 1 xmax, max(r) + 1 ymax FROM comp GROUP BY label")
def raster_polygonize(spark, sf_dir):  # noqa: ANN001, ANN201
    return components.polygonize(_classes(spark, sf_dir), 40).drop("perimeter")


@query("raster_polygonize_rings", f"WITH RECURSIVE {CLASSES} SELECT label, CAST(count(*) AS DOUBLE) area FROM comp GROUP BY label")
def raster_polygonize_rings(spark, sf_dir):  # noqa: ANN001, ANN201
    out = components.rings(_classes(spark, sf_dir), 40)
    cross = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), F.lit(0.0), lambda acc, k: acc + r[k][0] * r[k + 1][1] - r[k + 1][0] * r[k][1])
    return out.select("label", F.abs(F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + cross(r)) / 2).alias("area"))


#: Sieve: a component of less than four cells goes to its largest neighbour (the least label among equals), along chains.
SIEVED = f"""{CLASSES},
size AS (SELECT label, count(*) n, max(v) v FROM comp GROUP BY label),
near AS (SELECT DISTINCT a.label a, b.label b FROM comp a JOIN comp b ON a.label <> b.label AND ((a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))),
best AS (SELECT a label, arg_max(b, (n, -b)) best FROM near JOIN size ON size.label = b GROUP BY a),
goes AS (SELECT s.label, CASE WHEN n < 4 THEN coalesce(best, s.label) ELSE s.label END best FROM size s LEFT JOIN best USING (label)),
chain(label, place, step) AS (
  SELECT label, best, 0 FROM goes UNION ALL
  SELECT c.label, g.best, c.step + 1 FROM chain c JOIN goes g ON g.label = c.place WHERE g.best <> c.place AND c.step < 40),
last AS (SELECT label, arg_max(place, step) place FROM chain GROUP BY label)"""


@query("raster_sieve", f'WITH RECURSIVE {SIEVED} SELECT r "row", c "col", CAST(size.v AS DOUBLE) v FROM comp JOIN last USING (label) JOIN size ON size.label = last.place')
def raster_sieve(spark, sf_dir):  # noqa: ANN001, ANN201
    return components.sieve(_classes(spark, sf_dir), 40, 4)


@query("raster_footprint", f"WITH RECURSIVE {CLASSES.replace('CASE WHEN k > 25 THEN 1 ELSE 0 END v FROM dem', '1 v FROM dem WHERE k > 25')} SELECT label, count(*) cells, min(c) xmin, min(r) ymin, max(c) + 1 xmax, max(r) + 1 ymax FROM comp GROUP BY label")
def raster_footprint(spark, sf_dir):  # noqa: ANN001, ANN201
    masked = dem(spark, sf_dir, "p_size").withColumn("v", F.when(F.col("v") > 25, F.col("v")))
    return components.footprint(masked, 40).drop("perimeter")


@query(
    "raster_clean_collar",
    f"WITH RECURSIVE {CLASSES.replace('CASE WHEN k > 25 THEN 1 ELSE 0 END v FROM dem', '1 v FROM dem WHERE k <= 25')}, hw AS (SELECT max(r) h, max(c) w FROM dem), edge AS (SELECT DISTINCT label FROM comp, hw WHERE r IN (0, h) OR c IN (0, w)) SELECT d.r \"row\", d.c \"col\", e.label IS NOT NULL collar FROM dem d LEFT JOIN comp ON d.r = comp.r AND d.c = comp.c LEFT JOIN edge e ON e.label = comp.label",
)
def raster_clean_collar(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir, "p_size")
    height = cells.agg(F.max("row")).first()[0] + 1
    return components.clean_collar(cells, 40, height, 0.0, 25.0).select("row", "col", "collar")


@query("raster_proximity", f'WITH {DEM}, t AS (SELECT r, c FROM dem WHERE k = 7) SELECT d.r "row", d.c "col", round(min(sqrt((d.r - t.r) * (d.r - t.r) + (d.c - t.c) * (d.c - t.c))), 6) v FROM dem d, t GROUP BY 1, 2')
def raster_proximity(spark, sf_dir):  # noqa: ANN001, ANN201
    return distance.proximity(dem(spark, sf_dir, "p_size"), [7.0]).select("row", "col", R6("v").alias("v"))


FILL = f"""{DEM}, g AS (SELECT r, c, CASE WHEN k % 3 <> 0 THEN v END v FROM dem),
t AS (SELECT r, c, v,
  last_value(CASE WHEN v IS NOT NULL THEN c END IGNORE NULLS) OVER lw lc, last_value(v IGNORE NULLS) OVER lw lv,
  first_value(CASE WHEN v IS NOT NULL THEN c END IGNORE NULLS) OVER rw rc, first_value(v IGNORE NULLS) OVER rw rv,
  last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER uw ur, last_value(v IGNORE NULLS) OVER uw uv,
  first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER dw dr, first_value(v IGNORE NULLS) OVER dw dv
  FROM g WINDOW lw AS (PARTITION BY r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rw AS (PARTITION BY r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  uw AS (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), dw AS (PARTITION BY c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(
    "raster_fill_nodata",
    f'WITH {FILL} SELECT r "row", c "col", round(coalesce(v, (coalesce(lv / (c - lc), 0) + coalesce(rv / (rc - c), 0) + coalesce(uv / (r - ur), 0) + coalesce(dv / (dr - r), 0)) / (coalesce(1.0 / (c - lc), 0) + coalesce(1.0 / (rc - c), 0) + coalesce(1.0 / (r - ur), 0) + coalesce(1.0 / (dr - r), 0))), 6) v FROM t',
)
def raster_fill_nodata(spark, sf_dir):  # noqa: ANN001, ANN201
    both = dem_bands(spark, sf_dir).select(F.lit(1).alias("band"), "row", "col", F.when(F.col("k") % 3 != 0, F.col("v")).alias("v"))
    return distance.fill_nodata(both).select("row", "col", R6("v").alias("v"))


def squares(levels: str) -> str:
    """The contour segments of all squares as SQL: sides n, e, s, w are crossed where one end is below the level."""
    side = lambda n, p, q, x, y: f"CASE WHEN (({p} < level) <> ({q} < level)) THEN {{'x': {x.replace('t', f'((level - {p}) / ({q} - {p}))')}, 'y': {y.replace('t', f'((level - {p}) / ({q} - {p}))')}}} END {n}"
    sides = ", ".join([side("n", "a", "b", "x + 0.5 + t", "y + 0.5"), side("e", "b", "c", "x + 1.5", "y + 0.5 + t"), side("s", "d", "c", "x + 0.5 + t", "y + 1.5"), side("w", "a", "d", "x + 0.5", "y + 0.5 + t")])
    return f"""{DEM}, sq AS (SELECT m.c x, m.r y, m.v a, e.v b, s.v d, se.v c FROM dem m JOIN dem e ON e.r = m.r AND e.c = m.c + 1 JOIN dem s ON s.r = m.r + 1 AND s.c = m.c JOIN dem se ON se.r = m.r + 1 AND se.c = m.c + 1),
    lv AS (SELECT *, unnest({levels}) AS level FROM sq),
    p AS (SELECT *, {sides} FROM lv),
    g AS (SELECT level, unnest(CASE WHEN n IS NOT NULL AND e IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL
      THEN CASE WHEN (a >= level) = ((a + b + c + d) / 4 >= level) THEN [[n, e], [s, w]] ELSE [[n, w], [s, e]] END
      ELSE [list_filter([n, e, s, w], lambda z: z IS NOT NULL)] END) seg FROM p WHERE n IS NOT NULL OR e IS NOT NULL OR s IS NOT NULL OR w IS NOT NULL),
    segs AS (SELECT level, round(seg[1].x, 6) x1, round(seg[1].y, 6) y1, round(seg[2].x, 6) x2, round(seg[2].y, 6) y2 FROM g)"""


#: Levels every 10, which cross the rows of the raster.
STEP = 10.0
EVERY = f"range(CAST(floor(least(a, b, c, d) / {STEP}) + 1 AS BIGINT), CAST(floor(greatest(a, b, c, d) / {STEP}) + 1 AS BIGINT)).list_transform(lambda z: z * {STEP}::DOUBLE)"


def rounded(segments):  # noqa: ANN001, ANN201
    return segments.select("level", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("raster_contour_segments", f"WITH {squares(EVERY)} SELECT * FROM segs")
def raster_contour_segments(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(convert.contour_segments(dem(spark, sf_dir), STEP))


LIST = "[904.05, 921.5, 950.0, 975.25, 2000.0]"


@query("raster_contour_fixed", f"WITH {squares(f'list_filter({LIST}::DOUBLE[], lambda z: z > least(a, b, c, d) AND z <= greatest(a, b, c, d))')} SELECT * FROM segs")
def raster_contour_fixed(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(convert.contour_segments(dem(spark, sf_dir), levels=[904.05, 921.5, 950.0, 975.25, 2000.0]))


@query("raster_contour_exponential", f"WITH {squares('list_filter([pow(1.5::DOUBLE, 16), pow(1.5::DOUBLE, 17)], lambda z: z > least(a, b, c, d) AND z <= greatest(a, b, c, d))').replace('p_retailprice v', 'p_retailprice - 245 v')} SELECT * FROM segs")
def raster_contour_exponential(spark, sf_dir):  # noqa: ANN001, ANN201
    """Powers of 1.5: one of them lies among the values."""
    cells = dem(spark, sf_dir).withColumn("v", F.col("v") - 245)
    return rounded(convert.contour_segments(cells, exp_base=1.5))


SQUARES = f"{DEM}, sq AS (SELECT m.v a, e.v b, s.v d, se.v c FROM dem m JOIN dem e ON e.r = m.r AND e.c = m.c + 1 JOIN dem s ON s.r = m.r + 1 AND s.c = m.c JOIN dem se ON se.r = m.r + 1 AND se.c = m.c + 1), lv AS (SELECT *, unnest(range(CAST(floor(least(a, b, c, d) / 10) + 1 AS BIGINT), CAST(floor(greatest(a, b, c, d) / 10) + 1 AS BIGINT))) * 10.0::DOUBLE AS level FROM sq)"


@query("raster_contour_counts", f"WITH {SQUARES} SELECT level, CAST(sum(((a < level) <> (b < level))::INT + ((b < level) <> (c < level))::INT + ((d < level) <> (c < level))::INT + ((a < level) <> (d < level))::INT) / 2 AS BIGINT) n FROM lv GROUP BY level HAVING n > 0")
def raster_contour_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return convert.contour_segments(dem(spark, sf_dir), STEP).groupBy("level").agg(F.count("*").alias("n"))


#: Segments that share an end are one line; a line has a point more than it has segments.
JOINED = f"""{squares(EVERY)},
s AS (SELECT row_number() OVER (ORDER BY level, x1, y1, x2, y2) k, * FROM segs),
ends AS (SELECT k, level, x1 x, y1 y FROM s UNION SELECT k, level, x2, y2 FROM s),
links AS (SELECT DISTINCT p.k a, q.k b FROM ends p JOIN ends q ON p.level = q.level AND p.x = q.x AND p.y = q.y AND p.k <> q.k),
lab(k, label) AS (SELECT k, k FROM s UNION SELECT l.b, lab.label FROM lab JOIN links l ON l.a = lab.k WHERE lab.label < l.b),
line AS (SELECT k, min(label) label FROM lab GROUP BY k)"""


@query("raster_contour_lines", f"WITH RECURSIVE {JOINED} SELECT level, CAST(count(*) + 1 AS INT) points, min(least(y1, y2)) ymin, max(greatest(x1, x2)) xmax FROM line JOIN s USING (k) GROUP BY level, label")
def raster_contour_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    out = convert.contour_lines(dem(spark, sf_dir), STEP)
    return out.select("level", F.size("line").alias("points"), F.round(F.array_min(F.transform("line", lambda p: p[1])), 6).alias("ymin"), F.round(F.array_max(F.transform("line", lambda p: p[0])), 6).alias("xmax"))


@query(
    "raster_viewshed_row",
    f"WITH {DEM}, o AS (SELECT r, v + 2 eye FROM dem WHERE c = 20), g AS (SELECT d.r, d.c, abs(d.c - 20) dist, sign(d.c - 20) side, (v - eye) / nullif(abs(d.c - 20), 0) slope FROM dem d JOIN o ON o.r = d.r), w AS (SELECT r, c, dist, slope, max(slope) OVER (PARTITION BY r, side ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM g) SELECT r \"row\", c \"col\", CAST(CASE WHEN dist <= 1 OR before IS NULL OR slope >= before THEN 255 ELSE 0 END AS INT) v FROM w",
)
def raster_viewshed_row(spark, sf_dir):  # noqa: ANN001, ANN201
    return distance.row_viewshed(dem(spark, sf_dir), 20)


#: Lines from each observer to the cells of the border; a cell is seen if no cell before it on a line is steeper.
SIGHT = f"""{DEM}, hw AS (SELECT max(r) h, max(c) w FROM dem), who AS (SELECT * FROM (VALUES (2, 5), (3, 30)) t(orow, ocol)),
border AS (SELECT r, c FROM dem, hw WHERE r IN (0, h) OR c IN (0, w)),
line AS (SELECT orow, ocol, b.r br, b.c bc, greatest(abs(b.r - orow), abs(b.c - ocol)) n FROM who, border b),
steps AS (SELECT orow, ocol, br, bc, k, CAST(round_even(orow + (br - orow) * k / n, 0) AS INT) r, CAST(round_even(ocol + (bc - ocol) * k / n, 0) AS INT) c FROM (SELECT *, unnest(range(1, n + 1)) k FROM line WHERE n > 0)),
slope AS (SELECT a.orow, a.ocol, br, bc, a.k, a.r, a.c, (d.v - (o.v + 2)) / sqrt((a.r - a.orow) * (a.r - a.orow) + (a.c - a.ocol) * (a.c - a.ocol)) s FROM steps a JOIN dem d ON d.r = a.r AND d.c = a.c JOIN dem o ON o.r = a.orow AND o.c = a.ocol),
seen AS (SELECT orow, ocol, r, c, s, max(s) OVER (PARTITION BY orow, ocol, br, bc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before FROM slope),
hits AS (SELECT DISTINCT orow, ocol, r, c FROM seen WHERE before IS NULL OR s >= before UNION SELECT orow, ocol, orow, ocol FROM who)"""


@query("raster_viewshed_cumulative", f'WITH {SIGHT} SELECT d.r "row", d.c "col", count(hits.orow) n FROM dem d LEFT JOIN hits ON hits.r = d.r AND hits.c = d.c GROUP BY 1, 2')
def raster_viewshed_cumulative(spark, sf_dir):  # noqa: ANN001, ANN201
    return distance.viewshed(dem(spark, sf_dir), [(2, 5), (3, 30)])


@query("raster_pixel_info_lines", f"WITH {DEM}, {PTS}, l AS (SELECT DISTINCT CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT) AS value, CAST(floor(y / 2) AS INT) \"row\", CAST(floor(x / 3) AS INT) \"col\" FROM pts) SELECT value, \"row\", \"col\", v FROM l LEFT JOIN dem ON r = \"row\" AND c = \"col\"")
def raster_pixel_info_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    lines = points(spark, sf_dir).select(F.concat_ws(" ", F.col("x").cast("bigint"), F.col("y").cast("bigint")).alias("value")).distinct()
    return convert.pixel_info_lines(lines, dem(spark, sf_dir), (0.0, 3.0, 0.0, 0.0, 0.0, 2.0))


HALF = "(pi() * 6378137.0)"


@query("raster_tile_mercator", f'WITH {DEM}, p AS (SELECT CAST(floor((1000000 + (c + 0.5) * 700 + {HALF}) / (2 * {HALF} / 32768)) AS BIGINT) px, CAST(floor(({HALF} - (6000000 - (r + 0.5) * 900)) / (2 * {HALF} / 32768)) AS BIGINT) py, v FROM dem) SELECT 7 z, CAST(px // 256 AS INT) tx, CAST(py // 256 AS INT) ty, CAST(py % 256 AS INT) "row", CAST(px % 256 AS INT) "col", round(avg(v), 6) v FROM p GROUP BY px, py')
def raster_tile_mercator(spark, sf_dir):  # noqa: ANN001, ANN201
    out = warp.mercator_tiles(dem(spark, sf_dir), (1_000_000.0, 700.0, 0.0, 6_000_000.0, 0.0, -900.0), 7)
    return out.select("z", "tx", "ty", "row", "col", R6("v").alias("v"))


# --- interpolation ---

NEAR = f"{PTS}, {NODES}, near AS (SELECT i, j, fid, x, y, z, x - cx dx, y - cy dy, (x - cx) * (x - cx) + (y - cy) * (y - cy) d2 FROM nodes, pts WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 144)"


def interpolation(name: str, algorithm: str, sql: str, empty: float = 0.0, source: str = "near", **args: object) -> None:
    @query(f"grid_{name}", f"WITH {NEAR}, a AS (SELECT i, j, {sql} v FROM {source} GROUP BY i, j) SELECT nodes.i, nodes.j, round(coalesce(v, {empty}), 6) v FROM nodes LEFT JOIN a ON a.i = nodes.i AND a.j = nodes.j")
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        nodes = grid.nodes(spark, 20, 20, 0.0, 0.0, 5.0, 5.0)
        return grid.grid(nodes, points(spark, sf_dir), algorithm, 12.0, nodata=empty, **args).select("i", "j", R6("v").alias("v"))


interpolation("invdist", "invdist", "sum(z / d2) / sum(1 / d2)")
interpolation("invdist_smooth", "invdist", "sum(z * pow(d2 + 4, -1.5)) / sum(pow(d2 + 4, -1.5))", power=3.0, smoothing=2.0)
interpolation("invdistnn", "invdistnn", "sum(z / d2) / sum(1 / d2)", source="(SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY d2, fid) <= 12)")
interpolation("average", "average", "avg(z)", empty=-1.0)
interpolation("nearest", "nearest", "arg_max(z, (-d2, fid))")
interpolation("minimum", "minimum", "min(z)")
interpolation("maximum", "maximum", "max(z)")
interpolation("range", "range", "max(z) - min(z)")
interpolation("count", "count", "CAST(count(*) AS DOUBLE)")
interpolation("average_distance", "average_distance", "avg(sqrt(d2))")
interpolation("average_distance_points", "average_distance_points", "avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))", source="(SELECT a.i, a.j, a, b FROM near a JOIN near b ON a.i = b.i AND a.j = b.j AND a.fid < b.fid)")
interpolation("quadrant_capped", "average", "avg(z)", source="(SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY i, j, dx >= 0, dy >= 0 ORDER BY d2, fid) <= 2)", per_quadrant=2)


@query("grid_linear")
def grid_linear(spark, sf_dir):  # noqa: ANN001, ANN201
    return grid.linear(grid.nodes(spark, 20, 20, 0.0, 0.0, 5.0, 5.0), points(spark, sf_dir), 12.0)


# --- resampling ---


@query("warp_overview_average", f'WITH {DEM} SELECT r // 2 "row", c // 2 "col", round(avg(v), 6) v FROM dem GROUP BY 1, 2')
def warp_overview_average(spark, sf_dir):  # noqa: ANN001, ANN201
    return warp.overview(dem(spark, sf_dir)).select("row", "col", R6("v").alias("v"))


@query("warp_overview_mode", f'WITH {DEM}, n AS (SELECT r // 4 r, c // 4 c, k, count(*) n FROM dem GROUP BY 1, 2, 3) SELECT r "row", c "col", CAST(arg_max(k, (n, k)) AS DOUBLE) v FROM n GROUP BY 1, 2')
def warp_overview_mode(spark, sf_dir):  # noqa: ANN001, ANN201
    return warp.overview(dem(spark, sf_dir, "p_size"), 4, "mode").select("row", "col", "v")


@query("warp_overview_refresh", f'WITH {DEM} SELECT r // 2 "row", c // 2 "col", round(avg(v), 6) v FROM dem GROUP BY 1, 2')
def warp_overview_refresh(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    stale = warp.overview(cells).withColumn("v", F.when((F.col("row") < 3) & (F.col("col") < 4), 0.0).otherwise(F.col("v")))
    return warp.refresh(stale, cells, 2, (0, 0, 6, 8)).select("row", "col", R6("v").alias("v"))


HEIGHT = f"{DEM}, hw AS (SELECT max(r) + 1 h FROM dem)"


def _resized(spark, sf_dir, rows, columns, method):  # noqa: ANN001, ANN202
    """The whole raster at another size: its height times a part, and so many columns."""
    cells = dem(spark, sf_dir)
    height = cells.agg(F.max("row")).first()[0] + 1
    return warp.resize(cells, (height, 40), (int(height * rows), columns), method).select("row", "col", R6("v").alias("v"))


#: Target rows i and columns j near each cell: ih and jw are the target's size.
NEARBY = lambda rows, columns, reach: f"{HEIGHT}, size AS (SELECT h, CAST(floor(h * {rows}) AS INT) ih, {columns} jw FROM hw), near AS (SELECT r, c, v, h, ih, jw, i, j FROM (SELECT *, unnest(range(greatest(0, CAST(floor((r - {reach}) * ih / h) AS BIGINT) - 1), least(ih, CAST(ceil((r + 1 + {reach}) * ih / h) AS BIGINT) + 1))) i FROM dem, size), (SELECT unnest(range({columns})) j) WHERE j BETWEEN (c - {reach}) * jw / 40.0 - 1 AND (c + 1 + {reach}) * jw / 40.0 + 1)"


@query("warp_resize_nearest", f'WITH {NEARBY(1.5, 25, 1)} SELECT CAST(i AS INT) "row", CAST(j AS INT) "col", v FROM near WHERE r = floor((i + 0.5) * h / ih + 1e-10) AND c = floor((j + 0.5) * 40 / jw + 1e-10)')
def warp_resize_nearest(spark, sf_dir):  # noqa: ANN001, ANN201
    return _resized(spark, sf_dir, 1.5, 25, "nearest")


#: Kernels by the distance t; in SQL and by name.
KERNELS = {
    "bilinear": (1, "greatest(0, 1 - abs({t}))"),
    "cubic": (2, "CASE WHEN abs({t}) <= 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * abs({t}) ** 2 + 1 WHEN abs({t}) < 2 THEN -0.5 * abs({t}) ** 3 + 2.5 * abs({t}) ** 2 - 4 * abs({t}) + 2 ELSE 0 END"),
    "cubicspline": (2, "CASE WHEN abs({t}) <= 1 THEN 2.0 / 3 - abs({t}) ** 2 + abs({t}) ** 3 / 2 WHEN abs({t}) < 2 THEN (2 - abs({t})) ** 3 / 6 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN {t} = 0 THEN 1 WHEN abs({t}) < 3 THEN 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} * pi() * {t}) ELSE 0 END"),
}


def resized(method: str, rows: float, columns: int) -> None:
    reach, kernel = KERNELS[method]
    down, across = f"greatest(1.0, h / ih::DOUBLE)", f"greatest(1.0, 40 / {columns}.0)"
    ty, tx = f"((r + 0.5 - (i + 0.5) * h / ih) / {down})", f"((c + 0.5 - (j + 0.5) * 40 / jw) / {across})"
    weight = f"({kernel.format(t=ty)}) * ({kernel.format(t=tx)})"
    wide = reach * max(1.0, 1 / rows, 40 / columns)

    @query(f"warp_resize_{method}", f'WITH {NEARBY(rows, columns, wide)}, t AS (SELECT i, j, v, {weight} w FROM near) SELECT CAST(i AS INT) "row", CAST(j AS INT) "col", round(sum(v * w) / sum(w), 6) v FROM t WHERE w <> 0 GROUP BY 1, 2')
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return _resized(spark, sf_dir, rows, columns, method)


resized("bilinear", 2, 80)
resized("cubic", 1.5, 60)
resized("cubicspline", 2, 50)
resized("lanczos", 0.5, 20)

OVERLAP = "(least((i + 1) * h / ih::DOUBLE, r + 1) - greatest(i * h / ih::DOUBLE, r)) * (least((j + 1) * 40 / jw::DOUBLE, c + 1) - greatest(j * 40 / jw::DOUBLE, c))"
TOUCHES = "r < (i + 1) * h / ih::DOUBLE AND r + 1 > i * h / ih::DOUBLE AND c < (j + 1) * 40 / jw::DOUBLE AND c + 1 > j * 40 / jw::DOUBLE"


def by_area(method: str, sql: str) -> None:
    @query(f"warp_resize_{method}", f'WITH {NEARBY(0.4, 16, 1)}, t AS (SELECT i, j, v, {OVERLAP} w FROM near WHERE {TOUCHES}) SELECT CAST(i AS INT) "row", CAST(j AS INT) "col", round({sql}, 6) v FROM t GROUP BY 1, 2')
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return _resized(spark, sf_dir, 0.4, 16, method)


by_area("average", "sum(v * w) / sum(w)")
by_area("sum", "sum(v * w)")
by_area("rms", "sqrt(sum(v * v * w) / sum(w))")
by_area("min", "min(v)")
by_area("max", "max(v)")


def by_centre(method: str, sql: str) -> None:
    @query(f"warp_resize_{method}", f'WITH {HEIGHT} SELECT CAST(floor((r + 0.5) * floor(h * 0.4) / h) AS INT) "row", CAST(floor((c + 0.5) * 16 / 40) AS INT) "col", round({sql}, 6) v FROM dem, hw GROUP BY 1, 2')
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return _resized(spark, sf_dir, 0.4, 16, method)


by_centre("med", "quantile_cont(v, 0.5)")
by_centre("q1", "quantile_cont(v, 0.25)")
by_centre("q3", "quantile_cont(v, 0.75)")


def overviews(method: str, sql: str) -> None:
    @query(f"warp_overview_{method}", f'WITH {DEM} SELECT r // 3 "row", c // 3 "col", round({sql}, 6) v FROM dem GROUP BY 1, 2')
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return warp.overview(dem(spark, sf_dir), 3, method).select("row", "col", R6("v").alias("v"))


overviews("min", "min(v)")
overviews("max", "max(v)")
overviews("sum", "sum(v)")
overviews("rms", "sqrt(avg(v * v))")
overviews("nearest", "max(CASE WHEN r % 3 = 1 AND c % 3 = 1 THEN v END)")


@query("raster_tile", f"WITH {DEM}, t AS (SELECT 1 z, r, c, v FROM dem UNION ALL SELECT 0, r // 2, c // 2, avg(v) FROM dem GROUP BY 2, 3) SELECT z, c // 16 tx, r // 16 ty, count(*) n, round(sum(v * (1 + r % 16) * (1 + c % 16)), 4) placed FROM t GROUP BY 1, 2, 3")
def raster_tile(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tiles of 16 cells at full resolution and one level above, with all their cells."""
    each = warp.tiles(dem(spark, sf_dir), 16, 1, 0).select("z", "tx", "ty", F.explode("cells").alias("x"))
    return each.groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x.v") * (1 + F.col("x.row")) * (1 + F.col("x.col"))), 4).alias("placed"))


@query("warp_reproject_bilinear", f'WITH {DEM}, p AS (SELECT CAST(i AS INT) i, CAST(j AS INT) j, (i + 0.5) / 2 + 0.25 - 0.5 y, (j + 0.5) / 2 + 0.75 - 0.5 x FROM range(30) a(i), range(60) b(j)), t AS (SELECT i, j, v, greatest(0, 1 - abs(r - y)) * greatest(0, 1 - abs(c - x)) w FROM p JOIN dem ON r BETWEEN floor(y) AND floor(y) + 1 AND c BETWEEN floor(x) AND floor(x) + 1) SELECT i "row", j "col", round(sum(v * w) / sum(w), 6) v FROM t WHERE w > 0 GROUP BY 1, 2')
def warp_reproject_bilinear(spark, sf_dir):  # noqa: ANN001, ANN201
    target = grid.nodes(spark, 60, 30, 0.0, 0.0, 1.0, 1.0).select(F.col("j").alias("row"), F.col("i").alias("col"))
    unit = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    return warp.reproject(dem(spark, sf_dir), target, lambda x, y: (x / 2 + 0.75, y / 2 + 0.25), unit, unit, "bilinear").select("row", "col", R6("v").alias("v"))


@query("warp_reproject_nearest", f'WITH {DEM} SELECT CAST(i AS INT) "row", CAST(j AS INT) "col", v FROM range(30) a(i), range(60) b(j) JOIN dem ON r = floor((i + 0.5) / 2 + 0.25 + 1e-10) AND c = floor((j + 0.5) / 2 + 0.75 + 1e-10)')
def warp_reproject_nearest(spark, sf_dir):  # noqa: ANN001, ANN201
    target = grid.nodes(spark, 60, 30, 0.0, 0.0, 1.0, 1.0).select(F.col("j").alias("row"), F.col("i").alias("col"))
    unit = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    return warp.reproject(dem(spark, sf_dir), target, lambda x, y: (x / 2 + 0.75, y / 2 + 0.25), unit, unit).select("row", "col", "v")


@query("warp_update", f'WITH {DEM} SELECT a.r "row", a.c "col", coalesce(b.v + 1000, a.v) v FROM dem a LEFT JOIN dem b ON b.r = a.r - 2 AND b.c = a.c - 3')
def warp_update(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    return warp.update(cells, cells.withColumn("v", F.col("v") + 1000), 2, 3).select("row", "col", "v")


@query("raster_tile_index", f"WITH {DEM} SELECT 2 z, c // 16 tx, r // 16 ty, CAST(count(*) AS INT) n FROM dem GROUP BY 2, 3 UNION ALL SELECT 1, c // 16, r // 16, CAST(count(*) AS INT) FROM (SELECT DISTINCT r // 2 r, c // 2 c FROM dem) GROUP BY 2, 3")
def raster_tile_index(spark, sf_dir):  # noqa: ANN001, ANN201
    return warp.tiles(dem(spark, sf_dir), 16, 2, 1).select("z", "tx", "ty", F.size("cells").alias("n"))


# --- arrays ---


def _dims(df):  # noqa: ANN001, ANN202
    return [mdim.Dimension("X", df.agg(F.max("i0")).first()[0] + 1), mdim.Dimension("Y", 64, 100.0, 2.0)]


@query("mdim_slice", f"WITH {MD} SELECT a i0, CAST(b - 5 AS INT) i1, round(CAST(v AS DOUBLE), 6) v FROM md WHERE b BETWEEN 5 AND 10")
def mdim_slice(spark, sf_dir):  # noqa: ANN001, ANN201
    df = md(spark, sf_dir)
    return mdim.subset(df, _dims(df), "Y(110,120)")[0].select("i0", "i1", R6("v").alias("v"))


@query("mdim_stats", f"WITH {MD} SELECT round(min(CAST(v AS DOUBLE)), 6) min, round(max(CAST(v AS DOUBLE)), 6) max, round(avg(CAST(v AS DOUBLE)), 6) mean, round(stddev_pop(CAST(v AS DOUBLE)), 6) stddev, count(v) valid_count FROM md")
def mdim_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return mdim.stats(md(spark, sf_dir)).select("valid_count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "stddev")])


@query("mdim_mosaic", f"WITH {MD} SELECT a i0, CAST(b AS INT) i1, round(CAST(v AS DOUBLE), 6) v FROM md")
def mdim_mosaic(spark, sf_dir):  # noqa: ANN001, ANN201
    df = md(spark, sf_dir)
    dims = _dims(df)
    (low, dl), (high, dh) = mdim.subset(df, dims, "Y(100,170)"), mdim.subset(df, dims, "Y(160,226)")
    return mdim.mosaic([(low, dl[1]), (high, dh[1])], 1)[0].select("i0", "i1", R6("v").alias("v"))


@query("mdim_transpose", f"WITH {MD} SELECT CAST(b // 4 AS BIGINT) i0, a i1, round(CAST(v AS DOUBLE), 6) v FROM md WHERE b % 4 = 0")
def mdim_transpose(spark, sf_dir):  # noqa: ANN001, ANN201
    df = md(spark, sf_dir)
    return mdim.transpose(mdim.decimate(df, _dims(df), "Y", 4)[0], [1, 0]).select(F.col("i0").cast("bigint").alias("i0"), "i1", R6("v").alias("v"))

"""Queries of overlays and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.operators import overlay, raster
from geoloom.operators.geometry import area, make_rectangle

from .views import DEM, dem_bands, table

RECTS = "z AS (SELECT s_suppkey fid, CAST(s_suppkey * 7 % 30 AS DOUBLE) x0, CAST(s_suppkey * 11 % 40 AS DOUBLE) y0, CAST(3 + s_suppkey % 5 AS DOUBLE) w FROM supplier)"
MEET = "a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.w AND b.y0 < a.y0 + a.w"


def _rects(spark, sf_dir, spread=1):  # noqa: ANN001, ANN202
    k = F.col("s_suppkey")
    x, y, w = (k * 7 % 30 * spread).cast("double"), (k * 11 % 40 * spread).cast("double"), (3 + k % 5).cast("double")
    return make_rectangle(table(spark, sf_dir, "supplier").withColumn("fid", k), x, y, x + w, y + w).select("fid", "geom", "env")


@query("overlay_intersection", f"WITH {RECTS} SELECT a.fid fid_a, b.fid fid_b, round((least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.w, b.y0 + b.w) - greatest(a.y0, b.y0)), 6) area FROM z a JOIN z b ON {MEET}")
def overlay_intersection(spark, sf_dir):  # noqa: ANN001, ANN201
    z = _rects(spark, sf_dir)
    return overlay.intersection(z, z, 8.0, {"area": F.round(area(F.col("geom")), 6)}).select("fid_a", "fid_b", "area")


@query("overlay_disjoint", f"WITH {RECTS} SELECT b.fid FROM (SELECT fid, x0 * 3 x0, y0 * 3 y0, w FROM z) b WHERE NOT EXISTS (SELECT 1 FROM z a WHERE {MEET})")
def overlay_disjoint(spark, sf_dir):  # noqa: ANN001, ANN201
    """All rectangles, moved away from the origin, that none of those in place meets."""
    return overlay.disjoint(_rects(spark, sf_dir, 3), _rects(spark, sf_dir), 8.0).select("fid")


@query("calc_expression", f'WITH {DEM} SELECT r "row", c "col", round(CASE WHEN v > 1000 AND k < 30 THEN (v - k) / (v + k) ELSE sqrt(v) + pow(k, 2) END, 6) v FROM dem')
def calc_expression(spark, sf_dir):  # noqa: ANN001, ANN201
    out = raster.calc_expression(dem_bands(spark, sf_dir), "if(v > 1000 && k < 30, (v - k) / (v + k), sqrt(v) + k^2)", ["v", "k"])
    return out.select("row", "col", F.round("v", 6).alias("v"))

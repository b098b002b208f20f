"""Queries of the neighbourhood operators, over interior and edge cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.operators import stencil

from .views import DEM, dem

#: The nine taps with mirrored edges: sides first, then above and below.
TAPS = f"""{DEM},
g AS (SELECT r, c, v, lag(v) OVER w l, lead(v) OVER w q FROM dem WINDOW w AS (PARTITION BY r ORDER BY c)),
x AS (SELECT r, c, coalesce(l, 2 * v - q) l, v m, coalesce(q, 2 * v - l) q FROM g),
y AS (SELECT *, lag(l) OVER w ul, lag(m) OVER w um, lag(q) OVER w uq, lead(l) OVER w dl, lead(m) OVER w dm, lead(q) OVER w dq FROM x WINDOW w AS (PARTITION BY c ORDER BY r)),
t AS (SELECT r, c, coalesce(ul, 2 * l - dl) nw, coalesce(um, 2 * m - dm) n, coalesce(uq, 2 * q - dq) ne, l w, m c0, q e, coalesce(dl, 2 * l - ul) sw, coalesce(dm, 2 * m - um) s, coalesce(dq, 2 * q - uq) se FROM y),
gr AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) gx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) gy FROM t)"""


def terrain(name: str, fn, sql: str, digits: int = 6) -> None:  # noqa: ANN001
    @query(name, f'WITH {TAPS} SELECT r "row", c "col", round({sql}, {digits}) v FROM gr')
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return fn(dem(spark, sf_dir)).select("row", "col", F.round("v", digits).alias("v"))


terrain("dem_slope", lambda d: stencil.slope(d, 10.0, 10.0), "degrees(atan(sqrt((gx / 80) * (gx / 80) + (gy / 80) * (gy / 80))))")
terrain("dem_slope_percent", lambda d: stencil.slope(d, 10.0, 10.0, percent=True, algorithm="zt"), "100 * sqrt(((e - w) / 20) * ((e - w) / 20) + ((s - n) / 20) * ((s - n) / 20))")
terrain("dem_aspect", stencil.aspect, "CASE WHEN gx = 0 AND gy = 0 THEN -9999 ELSE (CASE WHEN degrees(atan2(gy, -gx)) > 90 THEN 450 - degrees(atan2(gy, -gx)) ELSE 90 - degrees(atan2(gy, -gx)) END) END")
terrain(
    "dem_hillshade", lambda d: stencil.hillshade(d, 10.0, 10.0, z=2.0),
    "floor(1 + 254 * greatest(0, least(1, (sin(radians(45)) + cos(radians(45)) * (sin(radians(315)) * (-gx / 40) + cos(radians(315)) * (gy / 40))) / sqrt(1 + (gx / 40) * (gx / 40) + (gy / 40) * (gy / 40)))) + 0.5)", 0,
)
TRIG = "degrees(atan2(gy, -gx))"
terrain("dem_aspect_trigonometric", lambda d: stencil.aspect(d, trigonometric=True, zero_for_flat=True), f"CASE WHEN gx = 0 AND gy = 0 THEN 0 WHEN {TRIG} < 0 THEN {TRIG} + 360 ELSE {TRIG} END")
STEEP = "((gx / 80) * (gx / 80) + (gy / 80) * (gy / 80))"
LIT = lambda az: f"((sin(radians(45)) + cos(radians(45)) * (sin(radians({az})) * (-gx / 80) + cos(radians({az})) * (gy / 80))) / sqrt(1 + {STEEP}))"
BYTE = lambda x: f"floor(1 + 254 * greatest(0, least(1, {x})) + 0.5)"
terrain("dem_hillshade_combined", lambda d: stencil.hillshade(d, 10.0, 10.0, variant="combined"), BYTE(f"1 - acos(greatest(-1, least(1, {LIT(315)}))) * atan(sqrt({STEEP})) / (pi() * pi() / 4)"), 0)
TURN = "abs(atan2(-gx / 80, gy / 80) - radians(315))"
terrain("dem_hillshade_igor", lambda d: stencil.hillshade(d, 10.0, 10.0, variant="igor"), BYTE(f"1 - atan(sqrt({STEEP})) / (pi() / 2) * ((CASE WHEN {TURN} % (2 * pi()) > pi() THEN 2 * pi() - {TURN} % (2 * pi()) ELSE {TURN} % (2 * pi()) END) / pi())"), 0)
MULTI = " + ".join(f"greatest(0, {LIT(az)}) * ({g} / 80) * ({g} / 80)" for az, g in ((225, "gx"), (270, "gx"), (315, "gy"), (360, "gy")))
terrain("dem_hillshade_multidirectional", lambda d: stencil.hillshade(d, 10.0, 10.0, variant="multidirectional"), BYTE(f"CASE WHEN {STEEP} > 0 THEN ({MULTI}) / (2 * {STEEP}) ELSE sin(radians(45)) END"), 0)
terrain("dem_roughness", stencil.roughness, "greatest(nw, n, ne, w, c0, e, sw, s, se) - least(nw, n, ne, w, c0, e, sw, s, se)")
terrain("dem_tpi", stencil.tpi, "c0 - (nw + n + ne + w + e + sw + s + se) / 8")
terrain("dem_tri_riley", stencil.tri, "sqrt(pow(nw - c0, 2) + pow(n - c0, 2) + pow(ne - c0, 2) + pow(w - c0, 2) + pow(e - c0, 2) + pow(sw - c0, 2) + pow(s - c0, 2) + pow(se - c0, 2))")
terrain("dem_tri_wilson", lambda d: stencil.tri(d, "wilson"), "(abs(nw - c0) + abs(n - c0) + abs(ne - c0) + abs(w - c0) + abs(e - c0) + abs(sw - c0) + abs(s - c0) + abs(se - c0)) / 8")

CLAMPED = f"{DEM}, hw AS (SELECT max(r) h, max(c) w FROM dem), o AS (SELECT CAST(i AS INT) dr, CAST(j AS INT) dc, CAST([1, 2, 1][i + 2] * [1, 2, 1][j + 2] AS DOUBLE) wt FROM range(-1, 2) a(i), range(-1, 2) b(j)), f AS (SELECT m.r, m.c, q.v, o.wt FROM dem m, o, hw JOIN dem q ON q.r = greatest(0, least(h, m.r + o.dr)) AND q.c = greatest(0, least(w, m.c + o.dc)))"


@query("raster_neighbors_gauss", f'WITH {CLAMPED} SELECT r "row", c "col", round(sum(v * wt) / sum(wt), 6) v FROM f GROUP BY r, c')
def raster_neighbors_gauss(spark, sf_dir):  # noqa: ANN001, ANN201
    return stencil.neighbors(dem(spark, sf_dir), "gaussian").select("row", "col", F.round("v", 6).alias("v"))


@query("raster_neighbors_median", f'WITH {CLAMPED} SELECT r "row", c "col", round(median(v), 6) v FROM f GROUP BY r, c')
def raster_neighbors_median(spark, sf_dir):  # noqa: ANN001, ANN201
    return stencil.neighbors(dem(spark, sf_dir), "equal", "median").select("row", "col", F.round("v", 6).alias("v"))


@query("raster_neighbors_max", f'WITH {CLAMPED} SELECT r "row", c "col", max(v) v FROM f GROUP BY r, c')
def raster_neighbors_max(spark, sf_dir):  # noqa: ANN001, ANN201
    return stencil.neighbors(dem(spark, sf_dir), "equal", "max").select("row", "col", "v")


@query("raster_neighbors_edge", f'WITH {CLAMPED.replace("[1, 2, 1][i + 2] * [1, 2, 1][j + 2]", "CASE WHEN i = 0 AND j = 0 THEN 8 ELSE -1 END")} SELECT r "row", c "col", round(sum(v * wt), 6) v FROM f GROUP BY r, c')
def raster_neighbors_edge(spark, sf_dir):  # noqa: ANN001, ANN201
    return stencil.neighbors(dem(spark, sf_dir), "edge2", "sum").select("row", "col", F.round("v", 6).alias("v"))

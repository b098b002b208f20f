"""Queries of raster algebra and management."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import pixel
from geoloom.operators import raster

from .views import DEM, dem, dem_bands

R6 = lambda c: F.round(c, 6)


@query("raster_band_stats", f"WITH {DEM} SELECT min(v) min, max(v) max, round(avg(v), 6) mean, round(stddev_pop(v), 6) stddev, 100.0::DOUBLE valid_percent FROM dem")
def raster_band_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.stats(dem(spark, sf_dir)).select("min", "max", R6("mean").alias("mean"), R6("stddev").alias("stddev"), F.col("valid_percent").cast("double").alias("valid_percent"))


@query("raster_histogram", f"WITH {DEM} SELECT CAST(greatest(0, least(31, floor((v - 900) * 32 / 200.0))) AS INT) bucket, count(*) n FROM dem GROUP BY 1")
def raster_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.histogram(dem(spark, sf_dir), 900.0, 1100.0, 32)


@query("raster_checksum", f"WITH {DEM} SELECT CAST(CAST(sum(CAST(floor(v + 0.5) AS BIGINT) % [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43][1 + (r * 40 + c) % 11]) AS BIGINT) & 65535 AS BIGINT) checksum FROM dem")
def raster_checksum(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.checksum(dem(spark, sf_dir), 40)


@query("raster_approx_stats", f"WITH {DEM} SELECT min(v) min, max(v) max, round(avg(v), 6) mean FROM dem WHERE (r // 5) % 3 = 0")
def raster_approx_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.approx_stats(dem(spark, sf_dir), 5, 3).select("min", "max", R6("mean").alias("mean"))


def calc(name: str, function: str, sql: str, columns: tuple[str, ...] = ("v", "k"), **args: float) -> None:
    @query(name, f"WITH {DEM} SELECT r \"row\", c \"col\", round({sql}, 6) v FROM dem")
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return raster.calc_bands(dem_bands(spark, sf_dir), list(columns), function, **args).select("row", "col", R6("v").alias("v"))


calc("calc_sum", "sum", "v + k + 3", k=3.0)
calc("calc_mul", "mul", "v * k")
calc("calc_mean", "mean", "(v + k) / 2")
calc("calc_diff", "diff", "v - k")
calc("calc_div", "div", "v / k")
calc("calc_norm_diff", "norm_diff", "(v - k) / (v + k)")
calc("calc_median", "median", "v + k + c - greatest(v, k, c) - least(v, k, c)", ("v", "k", "col"))
calc("calc_min", "min", "least(v, k, 30)", k=30.0)
calc("calc_max", "max", "greatest(v, k, 950)", k=950.0)
calc("calc_mode", "mode", "CASE WHEN k = c THEN k ELSE v END", ("v", "k", "col"))
calc("calc_round", "round", "round(v * 1.0, 1)", ("v",), digits=1)
calc("calc_scale", "scale", "v * 0.5 + 7", ("v",), scale=0.5, offset=7.0)
calc("calc_sqrt", "sqrt", "sqrt(v)", ("v",))
calc("calc_log10", "log10", "log10(abs(v))", ("v",))
calc("calc_exp", "exp", "exp(k / 10.0)", ("k",), fact=0.1)
calc("calc_inv", "inv", "2.0 / k", ("k",), k=2.0)
calc("calc_db2amp", "dB2amp", "pow(10, k / 20.0)", ("k",))
calc("calc_db2pow", "dB2pow", "pow(10, k / 10.0)", ("k",))
calc("calc_interpolate_exp", "interpolate_exp", "v * pow(k / v, 0.3)", t0=0.0, dt=10.0, t=3.0)
calc("calc_quantile", "quantile", "least(v, k) + (greatest(v, k) - least(v, k)) * 0.25", q=0.25)
calc("calc_harmonic_mean", "harmonic_mean", "2 / (1 / v + 1.0 / k)")
calc("calc_geometric_mean", "geometric_mean", "pow(v * k, 0.5)")
calc("calc_db", "dB", "20 * log10(abs(v))", ("v",))
calc("calc_pow", "pow", "pow(k, 1.5)", ("k",), power=1.5)
calc("calc_interpolate", "interpolate_linear", "v + (k - v) * 0.3", t0=0.0, dt=10.0, t=3.0)


@query("calc_replace_nodata", f"WITH {DEM} SELECT r \"row\", c \"col\", CAST(CASE WHEN k = 7 THEN -1 ELSE k END AS DOUBLE) v FROM dem")
def calc_replace_nodata(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumn("k", F.expr("nullif(k, 7)"))
    return raster.calc_bands(cells, ["k"], "replace_nodata", to=-1.0).select("row", "col", "v")


@query("calc_skips_nodata", f"WITH {DEM} SELECT r \"row\", c \"col\", round(CASE WHEN k = 7 THEN v ELSE (v + k) / 2 END, 6) v, CASE WHEN k <> 7 THEN round((v + k) / 2, 6) END every FROM dem")
def calc_skips_nodata(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem_bands(spark, sf_dir).withColumns({"k": F.expr("nullif(k, 7)"), "value": F.col("v")})
    every = raster.calc_bands(cells, ["value", "k"], "mean", propagate=True).withColumnRenamed("v", "every")
    return raster.calc_bands(every, ["value", "k"], "mean").select("row", "col", R6("v").alias("v"), R6("every").alias("every"))


@query("calc_complex", f"WITH {DEM} SELECT r \"row\", c \"col\", round(sqrt(v * v + k * k), 6) mod, round(atan2(k, v), 6) phase, round(v * c + k * 2.0, 6) re, round(k * c - v * 2.0, 6) im, v * v + k * k AS intensity, -k AS conj FROM dem")
def calc_complex(spark, sf_dir):  # noqa: ANN001, ANN201
    z, w = pixel.complex_of(F.col("v"), F.col("k")), pixel.complex_of(F.col("col"), F.lit(2.0))
    product = pixel.cmul(z, w)
    return dem_bands(spark, sf_dir).select(
        "row", "col", R6(pixel.modulus(z)).alias("mod"), R6(pixel.phase(z)).alias("phase"), R6(product["re"]).alias("re"), R6(product["im"]).alias("im"),
        pixel.intensity(z).alias("intensity"), pixel.conj(z)["im"].alias("conj"),
    )


@query("calc_polar", f"WITH {DEM} SELECT r \"row\", c \"col\", round(v * cos(k / 10.0), 6) re, round(v * sin(k / 10.0), 6) im FROM dem")
def calc_polar(spark, sf_dir):  # noqa: ANN001, ANN201
    z = pixel.polar(F.col("v"), F.col("k") / 10.0)
    return dem_bands(spark, sf_dir).select("row", "col", R6(z["re"]).alias("re"), R6(z["im"]).alias("im"))


@query("raster_calc_join", f"WITH {DEM} SELECT r \"row\", c \"col\", round(v - k, 6) v FROM dem")
def raster_calc_join(spark, sf_dir):  # noqa: ANN001, ANN201
    out = raster.calc([dem(spark, sf_dir), dem(spark, sf_dir, "p_size")], "diff")
    return out.select("row", "col", R6("v").alias("v"))


@query("raster_reclassify", f"WITH {DEM} SELECT r \"row\", c \"col\", CASE WHEN k = 7 THEN NULL WHEN k <= 10 THEN 1.0 WHEN k > 10 AND k < 20 THEN 2.0 WHEN k = 33 THEN CAST(k AS DOUBLE) ELSE 9.0 END v FROM dem")
def raster_reclassify(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir, "p_size")
    return cells.select("row", "col", raster.reclassify(F.col("v"), "7=NO_DATA; [-inf,10]=1 # small\n (10,20)=2; 33=PASS_THROUGH; DEFAULT=9").alias("v"))


@query("raster_scale", f"WITH {DEM}, e AS (SELECT min(v) lo, max(v) hi FROM dem) SELECT r \"row\", c \"col\", round(255 * (v - lo) / (hi - lo), 6) v FROM dem, e")
def raster_scale(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.scale(dem(spark, sf_dir)).select("row", "col", R6("v").alias("v"))


@query("raster_unscale", f"WITH {DEM} SELECT r \"row\", c \"col\", k * 0.5 + 3 v FROM dem")
def raster_unscale(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.unscale(dem(spark, sf_dir, "p_size"), 0.5, 3.0).select("row", "col", "v")


@query("raster_set_type", f"WITH {DEM} SELECT r \"row\", c \"col\", least(255.0, greatest(0.0, (CASE WHEN v >= 950 THEN floor((v - 950) * 6 + 0.5) ELSE ceil((v - 950) * 6 - 0.5) END))) v FROM dem")
def raster_set_type(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir).withColumn("v", (F.col("v") - 950) * 6)
    return raster.set_type(cells, "Byte").select("row", "col", "v")


MOVED = f"{DEM}, u AS (SELECT r, c, v, 0 seq FROM dem UNION ALL SELECT r + 3, c + 5, v * 2, 1 FROM dem)"


def _two(spark, sf_dir):  # noqa: ANN001, ANN202
    cells = dem(spark, sf_dir)
    return [cells, cells.withColumn("v", F.col("v") * 2)], [(0, 0), (3, 5)]


@query("raster_mosaic_last", f"WITH {MOVED} SELECT r \"row\", c \"col\", arg_max(v, seq) v FROM u GROUP BY r, c")
def raster_mosaic_last(spark, sf_dir):  # noqa: ANN001, ANN201
    inputs, offsets = _two(spark, sf_dir)
    return raster.mosaic(inputs, offsets=offsets).select("row", "col", "v")


@query("raster_mosaic_mean", f"WITH {MOVED} SELECT r \"row\", c \"col\", round(avg(v), 6) v FROM u GROUP BY r, c")
def raster_mosaic_mean(spark, sf_dir):  # noqa: ANN001, ANN201
    inputs, offsets = _two(spark, sf_dir)
    return raster.mosaic(inputs, "mean", offsets).select("row", "col", R6("v").alias("v"))


@query("raster_stack", f"WITH {DEM} SELECT 1 band, r \"row\", c \"col\", v FROM dem UNION ALL SELECT 2, r, c, CAST(k AS DOUBLE) FROM dem")
def raster_stack(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.stack([(dem(spark, sf_dir), 1), (dem(spark, sf_dir, "p_size"), 1)])


@query("raster_compare", f"WITH {DEM} SELECT r \"row\", c \"col\", v a, CASE WHEN k > 45 THEN v + 1 ELSE NULL END b FROM dem WHERE k > 45 OR k < 3")
def raster_compare(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir)
    size = dem(spark, sf_dir, "p_size").withColumnRenamed("v", "k")
    other = cells.join(size, raster.CELL).select(*raster.CELL, F.when(F.col("k") > 45, F.col("v") + 1).when(F.col("k") >= 3, F.col("v")).alias("v"))
    return raster.compare(cells, other).select("row", "col", "a", "b")


@query("raster_select_bands", f"WITH {DEM} SELECT 1 band, r \"row\", c \"col\", CAST(k AS DOUBLE) v FROM dem UNION ALL SELECT 2, r, c, v FROM dem UNION ALL SELECT 3, r, c, CAST(k AS DOUBLE) FROM dem")
def raster_select_bands(spark, sf_dir):  # noqa: ANN001, ANN201
    both = raster.stack([(dem(spark, sf_dir), 1), (dem(spark, sf_dir, "p_size"), 1)])
    return raster.select_bands(both, [2, 1, 2]).select("band", "row", "col", "v")


@query("raster_nodata_alpha", f"WITH {DEM} SELECT 1 band, r \"row\", c \"col\", CAST(nullif(k, 7) AS DOUBLE) v FROM dem UNION ALL SELECT 2, r, c, CASE WHEN k = 7 THEN 0.0 ELSE 255.0 END FROM dem")
def raster_nodata_alpha(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = dem(spark, sf_dir, "p_size").withColumn("v", F.expr("nullif(v, 7d)"))
    return raster.nodata_to_alpha(cells)


@query("raster_clip", f"WITH {DEM} SELECT r - 2 \"row\", c - 10 \"col\", v FROM dem WHERE r BETWEEN 2 AND 11 AND c BETWEEN 10 AND 29")
def raster_clip(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.clip(dem(spark, sf_dir), 2, 10, 10, 20).select("row", "col", "v")


@query("raster_create", "SELECT CAST(b + 1 AS INT) band, CAST(i AS INT) \"row\", CAST(j AS INT) \"col\", 5.0::DOUBLE v FROM range(2) x(b), range(7) y(i), range(9) z(j)")
def raster_create(spark, sf_dir):  # noqa: ANN001, ANN201
    return raster.create(spark, 9, 7, 2, 5.0)


@query("raster_color_map", f"WITH {DEM} SELECT r \"row\", c \"col\", CAST(CASE WHEN k <= 10 THEN 0 WHEN k <= 30 THEN floor(0 + 200 * (k - 10) / 20.0 + 0.5) WHEN k <= 50 THEN floor(200 + 55 * (k - 30) / 20.0 + 0.5) ELSE 255 END AS INT) red FROM dem")
def raster_color_map(spark, sf_dir):  # noqa: ANN001, ANN201
    colors = raster.color_map(F.col("v"), [(10.0, (0, 0)), (30.0, (200, 1)), (50.0, (255, 2))])
    return dem(spark, sf_dir, "p_size").select("row", "col", F.get(colors, F.lit(0)).alias("red"))


@query("raster_blend_multiply", f"WITH {DEM}, b AS (SELECT r, c, CAST(floor(v) AS BIGINT) % 256 a, k * 5 b FROM dem) SELECT r \"row\", c \"col\", CAST((a * 127 + ((a * b + 127) // 255) * 128 + 127) // 255 AS DOUBLE) v FROM b")
def raster_blend_multiply(spark, sf_dir):  # noqa: ANN001, ANN201
    base = dem(spark, sf_dir).withColumn("v", F.floor("v") % 256)
    over = dem(spark, sf_dir, "p_size").withColumn("v", F.col("v") * 5)
    return raster.blend(base, over, "multiply", 128).select("row", "col", "v")


BLENDED = {
    "screen": "a + b - (a * b + 127) // 255", "darken": "least(a, b)", "lighten": "greatest(a, b)", "add": "least(255, a + b)", "src_over": "b",
    "overlay": "CASE WHEN a < 128 THEN (2 * a * b + 127) // 255 ELSE 255 - (2 * (255 - a) * (255 - b) + 127) // 255 END",
    "hard_light": "CASE WHEN b < 128 THEN (2 * a * b + 127) // 255 ELSE 255 - (2 * (255 - a) * (255 - b) + 127) // 255 END",
    "color_dodge": "CASE WHEN b >= 255 THEN CASE WHEN a = 0 THEN 0 ELSE 255 END ELSE least(255, a * 255 // greatest(1, 255 - b)) END",
    "color_burn": "CASE WHEN b = 0 THEN CASE WHEN a = 255 THEN 255 ELSE 0 END ELSE 255 - least(255, (255 - a) * 255 // greatest(1, b)) END",
}


def blended(operator: str, sql: str) -> None:
    @query(f"raster_blend_{operator}", f"WITH {DEM}, b AS (SELECT r, c, CAST(floor(v) AS BIGINT) % 256 a, CAST(k * 5 AS BIGINT) b FROM dem) SELECT r \"row\", c \"col\", CAST({sql} AS DOUBLE) v FROM b")
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        base = dem(spark, sf_dir).withColumn("v", F.floor("v") % 256)
        return raster.blend(base, dem(spark, sf_dir, "p_size").withColumn("v", F.col("v") * 5), operator).select("row", "col", "v")


for _operator, _sql in BLENDED.items():
    blended(_operator, _sql)


@query("raster_color_map_exact", f"WITH {DEM} SELECT r \"row\", c \"col\", CASE WHEN k = 10 THEN 1 WHEN k = 30 THEN 2 END red, CASE WHEN k <= 20 THEN 1 ELSE 2 END near FROM dem")
def raster_color_map_exact(spark, sf_dir):  # noqa: ANN001, ANN201
    stops = [(10.0, (1,)), (30.0, (2,))]
    exact, near = (raster.color_map(F.col("v"), stops, mode) for mode in ("exact", "nearest"))
    return dem(spark, sf_dir, "p_size").select("row", "col", F.get(exact, F.lit(0)).alias("red"), F.get(near, F.lit(0)).alias("near"))


@query("raster_pansharpen", f"WITH {DEM}, p AS (SELECT r, c, v, k FROM dem), s AS (SELECT r, c, CAST(k AS DOUBLE) k FROM dem) SELECT p.r \"row\", p.c \"col\", b + 1 AS band, round((s.k + b) * p.v / (0.5 * s.k + 0.5 * (s.k + 1)), 6) v FROM p JOIN s ON s.r = p.r // 2 AND s.c = p.c // 2, (SELECT CAST(i AS INT) b FROM range(2) t(i))")
def raster_pansharpen(spark, sf_dir):  # noqa: ANN001, ANN201
    size = dem(spark, sf_dir, "p_size")
    out = raster.pansharpen(dem(spark, sf_dir), [size, size.withColumn("v", F.col("v") + 1)], [0.5, 0.5], 2)
    return out.select("band", "row", "col", R6("v").alias("v"))


@query("raster_palette_hist", f"WITH {DEM} SELECT CAST((CAST(floor(v) AS BIGINT) % 256) // 8 AS INT) r, CAST((k * 5) // 8 AS INT) g, CAST((p.c * 6) // 8 AS INT) b, count(*) n FROM dem p GROUP BY 1, 2, 3")
def raster_palette_hist(spark, sf_dir):  # noqa: ANN001, ANN201
    both = dem_bands(spark, sf_dir)
    rgb = both.select("row", "col", (F.floor("v") % 256).alias("r"), (F.col("k") * 5).alias("g"), (F.col("col") * 6).alias("b"))
    return raster.color_histogram(rgb)


@query("raster_rgb_to_palette")
def raster_rgb_to_palette(spark, sf_dir):  # noqa: ANN001, ANN201
    both = dem_bands(spark, sf_dir)
    rgb = both.select("row", "col", (F.floor("v") % 256).cast("int").alias("r"), (F.col("k") * 5).cast("int").alias("g"), (F.col("col") * 6).cast("int").alias("b"))
    return raster.rgb_to_palette(rgb, 16)[0]

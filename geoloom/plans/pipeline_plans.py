"""Queries through the pipeline language, and of the streaming aggregate in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import pipeline
from geoloom.catalog import query
from geoloom.streaming import windowed_zonal

from .views import DEM, PTS, dem, points, table


@query("pipeline_vector", f"WITH {PTS} SELECT fid, x, z FROM pts WHERE z > 100 AND x BETWEEN 10 AND 50")
def pipeline_vector(spark, sf_dir):  # noqa: ANN001, ANN201
    text = "read pts ! filter --where 'z > 100' ! filter --bbox 10,-1,50,1000 ! select env,y --exclude"
    return pipeline.run(spark, text, {"pts": points(spark, sf_dir)})


@query("pipeline_raster", f'WITH {DEM} SELECT r // 2 "row", c // 2 "col", round(avg(CASE WHEN k <= 25 THEN 0.0::DOUBLE ELSE 1.0 END) * 10 + 1, 6) v FROM dem GROUP BY 1, 2')
def pipeline_raster(spark, sf_dir):  # noqa: ANN001, ANN201
    text = "read dem ! reclassify '[-inf,25]=0;DEFAULT=1' ! overview ! unscale --scale 10 --offset 1"
    return pipeline.run(spark, text, {"dem": dem(spark, sf_dir, "p_size")}).select("row", "col", F.round("v", 6).alias("v"))


@query("stream_windowed_zonal", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CAST(user_id % 8 AS INT) zone, count(*) n, round(sum(value), 4) total, min(value) low, max(value) high FROM events GROUP BY 1, 2")
def stream_windowed_zonal(spark, sf_dir):  # noqa: ANN001, ANN201
    return windowed_zonal(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))

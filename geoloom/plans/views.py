"""The spatial views over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 40

DEM = "dem AS (SELECT CAST(p_partkey // 40 AS INT) r, CAST(p_partkey % 40 AS INT) c, p_retailprice v, p_size k FROM part)"
PTS = "pts AS (SELECT c_custkey fid, CAST(c_custkey * 37 % 101 AS DOUBLE) x, CAST(c_custkey * 53 % 97 AS DOUBLE) y, c_acctbal z FROM customer)"
NODES = "nodes AS (SELECT CAST(i AS INT) i, CAST(j AS INT) j, i * 5 + 2.5 cx, j * 5 + 2.5 cy FROM range(20) a(i), range(20) b(j))"
MD = "md AS (SELECT vec_id a, unnest(range(64)) b, unnest(embedding) v FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str, value: str = "p_retailprice") -> DataFrame:
    """Prices of parts as a raster of 40 columns."""
    part = table(spark, sf_dir, "part")
    return part.select(F.lit(1).alias("band"), F.expr("cast(p_partkey div 40 as int)").alias("row"), F.expr("cast(p_partkey % 40 as int)").alias("col"), F.col(value).cast("double").alias("v"))


def dem_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v (price), k (size)."""
    part = table(spark, sf_dir, "part")
    return part.select(F.expr("cast(p_partkey div 40 as int)").alias("row"), F.expr("cast(p_partkey % 40 as int)").alias("col"), F.col("p_retailprice").alias("v"), F.col("p_size").alias("k"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points: fid, x, y, z, env."""
    c = table(spark, sf_dir, "customer")
    x, y = (F.col("c_custkey") * 37 % 101).cast("double"), (F.col("c_custkey") * 53 % 97).cast("double")
    return c.select(F.col("c_custkey").alias("fid"), x.alias("x"), y.alias("y"), F.col("c_acctbal").alias("z"), F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")).alias("env"))


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a two-dimensional array: i0, i1, v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).withColumn("v", F.col("v").cast("double"))

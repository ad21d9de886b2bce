"""How the test tables stand in for cells, points and pixels; the same arithmetic in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cells(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(
        F.col("event_id").alias("cell_id"),
        (F.col("user_id") % 4).cast("int").alias("label"),
        F.dayofmonth("ts").alias("time"),
        ((F.col("user_id") * 37 + F.col("event_id") * 17) % 6500).cast("double").alias("x"),
        ((F.col("user_id") * 53 + F.col("event_id") * 29) % 6500).cast("double").alias("y"),
        F.col("value").alias("intden"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("area"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = [F.col("embedding")[i].cast("double") for i in range(3)]
    return e.select(F.col("vec_id").alias("id"), "label", v[0].alias("x"), v[1].alias("y"), v[2].alias("v"))


def pixels(spark: SparkSession, d: str, size: int = 128) -> DataFrame:
    g = spark.range(size * size).select((F.col("id") / size).cast("int").alias("r"), (F.col("id") % size).cast("int").alias("c"))
    return g.withColumn("v", ((F.col("r") * 37 + F.col("c") * 91 + F.col("r") * F.col("c")) % 256).cast("double"))


CELLS_SQL = """cells AS (SELECT event_id AS cell_id, CAST(user_id % 4 AS INTEGER) AS label, CAST(day(ts) AS INTEGER) AS time,
 CAST((user_id*37+event_id*17) % 6500 AS DOUBLE) AS x, CAST((user_id*53+event_id*29) % 6500 AS DOUBLE) AS y, value AS intden,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS area FROM events)"""
POINTS_SQL = """points AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
 CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"""
PIXELS_SQL = """pixels AS (SELECT r, c, CAST((r*37 + c*91 + r*c) % 256 AS DOUBLE) AS v FROM (SELECT CAST(i // 128 AS INTEGER) AS r,
 CAST(i % 128 AS INTEGER) AS c FROM range(16384) t(i)))"""

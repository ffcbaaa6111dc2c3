"""The supplied tables in the shape of sensor data, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, y, fidx, feature, value)``: 64 features, about 5 % nulls, the last one null throughout."""
    cells = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("y"), F.posexplode("embedding").alias("fidx", "value"))
    gone = ((F.col("row_id") * 7 + F.col("fidx") * 13) % 97 < 5) | (F.col("fidx") == 63)
    return cells.select("row_id", "y", "fidx", F.format_string("F%03d", F.col("fidx") + 1).alias("feature"), F.when(~gone, F.col("value").cast("double")).alias("value"))


SENSOR = """
sensor AS (
  SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y, i::INTEGER AS fidx, printf('F%03d', i + 1) AS feature,
    CASE WHEN (vec_id * 7 + i * 13) % 97 < 5 OR i = 63 THEN NULL ELSE embedding[i + 1]::DOUBLE END AS value
  FROM embeddings, range(64) t(i))"""


def sensor_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sensor_long`` with a feature that separates the classes and a constant one."""
    long = sensor_long(spark, sf_dir)
    more = sensor_rows(spark, sf_dir).select("row_id", "y", F.inline(F.array(*[F.struct(F.lit(i).alias("fidx"), F.lit(n).alias("feature"), v.cast("double").alias("value")) for i, n, v in ((64, "F065", F.col("y") * 3 + 0.1), (65, "F066", F.lit(7.3)))])))
    return long.unionByName(more)


EXTREMES = """
extremes AS (
  SELECT * FROM sensor UNION ALL
  SELECT vec_id, CAST(label = 0 AS INTEGER), 64, 'F065', CAST(label = 0 AS INTEGER) * 3 + 0.1::DOUBLE FROM embeddings UNION ALL
  SELECT vec_id, CAST(label = 0 AS INTEGER), 65, 'F066', 7.3::DOUBLE FROM embeddings)"""


def sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("y"))


SENSOR_ROWS = "sensor_rows AS (SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings)"


def order_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cells = F.array(*[F.struct(F.lit(i).alias("fidx"), F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)])
    return _read(spark, sf_dir, "lineitem").select(key.alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.inline(cells))


ORDERS = """
order_long AS (
  SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS y, fidx, feature, value FROM lineitem,
  LATERAL (VALUES (0, 'l_quantity', l_quantity::DOUBLE), (1, 'l_extendedprice', l_extendedprice::DOUBLE),
    (2, 'l_discount', l_discount::DOUBLE), (3, 'l_tax', l_tax::DOUBLE)) v(fidx, feature, value))"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), (F.col("user_id") % 15 == 0).cast("int").alias("y"), "value", "ts")


EVENTS = "event_rows AS (SELECT event_id AS row_id, CAST(user_id % 15 = 0 AS INTEGER) AS y, value, ts FROM events)"


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score of two decimals (so ties occur) and a prediction."""
    scored = event_rows(spark, sf_dir).withColumn("score", F.floor(F.col("value")) / 100.0)
    return scored.select("row_id", "y", "score", expr.predicted(F.col("score"), 0.9).alias("pred"))


SCORES = EVENTS + """,
scored AS (SELECT row_id, y, floor(value)::DOUBLE / 100.0::DOUBLE AS score FROM event_rows),
score_rows AS (SELECT row_id, y, score, CAST(score > 0.9::DOUBLE AS INTEGER) AS pred FROM scored)"""


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.format_string("F%03d", (F.col("id") + 1).cast("int")).alias("feature"), ((F.col("id") % 5 - 2) * 0.25 + 0.1).alias("beta"))


COEF = "coef AS (SELECT printf('F%03d', i + 1) AS feature, (i % 5 - 2) * 0.25::DOUBLE + 0.1::DOUBLE AS beta FROM range(64) t(i))"

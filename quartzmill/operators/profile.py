"""Null profile and class balance of long sensor data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_profile(long: DataFrame) -> DataFrame:
    """``(feature, fidx, n_rows, n_null, null_rate)``."""
    out = long.groupBy("feature", "fidx").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"))
    return out.withColumn("null_rate", F.col("n_null") / F.col("n_rows"))


def null_summary(long: DataFrame) -> DataFrame:
    """One row: features, features with nulls, features of nulls only, overall null rate."""
    p = null_profile(long)
    return p.agg(
        F.count("*").alias("n_features"),
        F.count_if(F.col("n_null") > 0).alias("n_with_null"),
        F.count_if(F.col("n_null") == F.col("n_rows")).alias("n_all_null"),
        (F.sum("n_null") / F.sum("n_rows")).alias("null_rate"),
    )


def all_null_features(long: DataFrame, drop_missing_threshold: float = 1.0) -> DataFrame:
    """Features to drop: of nulls only, or with a null rate at or above the threshold."""
    return null_profile(long).where(F.col("null_rate") >= drop_missing_threshold).select("feature", "fidx")


def drop_features(long: DataFrame, dropped: DataFrame) -> DataFrame:
    return long.join(F.broadcast(dropped.select("feature")), "feature", "left_anti")  # a row a feature


def class_balance(rows: DataFrame) -> DataFrame:
    """``(y, n, share)``."""
    counts = rows.where("y is not null").groupBy("y").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def class_weights(rows: DataFrame) -> DataFrame:
    """``(y, n, weight)``: n / (classes * n of the class)."""
    counts = rows.where("y is not null").groupBy("y").agg(F.count("*").alias("n"))
    all_rows = Window.partitionBy(F.lit(1))  # as many rows as classes
    return counts.withColumn("weight", F.sum("n").over(all_rows) / (F.count("*").over(all_rows) * F.col("n")))


def with_class_weight(rows: DataFrame, strategy: str = "class_weight") -> DataFrame:
    """``rows`` with ``weight``; any strategy but class_weight weighs all rows alike."""
    if strategy != "class_weight":
        return rows.withColumn("weight", F.lit(1.0))
    return rows.join(F.broadcast(class_weights(rows).select("y", "weight")), "y", "left")

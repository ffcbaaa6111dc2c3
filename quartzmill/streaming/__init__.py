"""Incremental ingest: the batch sources' cleaning over a stream of arriving feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.sensor_files import clean_features, raw_schema


def stream_features(spark: SparkSession, folder: str, n_features: int, **options: str) -> DataFrame:
    """Cleaned feature rows of files that arrive in ``folder``; rows carry no position, as a stream has none."""
    raw = spark.readStream.schema(raw_schema(n_features)).options(sep=" ", **options).csv(folder)
    return clean_features(raw)

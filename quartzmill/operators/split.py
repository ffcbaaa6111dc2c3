"""Exact, deterministic stratified sampling in the order of a hash.

A row's rank within its class is the number of rows in smaller hash buckets, from
a table of at most ``BUCKETS`` counts a class, plus its place within its own bucket, so
no window holds a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr

BUCKET_DIGITS = 4
BUCKETS = 16**BUCKET_DIGITS


def ranked(rows: DataFrame, seed: int, by: str | None = "y") -> DataFrame:
    """``rows`` with ``nth``: the place, from 1, within the class in hash order (ties by row_id)."""
    group = F.col(by) if by else F.lit(0)
    marked = rows.withColumn("__g", group).withColumn("__h", expr.hash_order(seed, F.col("row_id"))).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    counts = marked.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__g").alias("__og"), F.col("__b").alias("__ob"), F.coalesce(before, F.lit(0)).alias("__o"))
    joined = marked.join(offsets, F.col("__g").eqNullSafe(F.col("__og")) & (F.col("__b") == F.col("__ob")))
    own = F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__h", "row_id"))
    return joined.withColumn("nth", F.col("__o") + own).drop("__g", "__h", "__b", "__og", "__ob", "__o")


def quotas(rows: DataFrame, size: Column, by: str = "y") -> DataFrame:
    """``(y, n, quota)``: ``size`` of all rows dealt to the classes by largest remainder; ``size`` may use ``total``."""
    every = Window.partitionBy(F.lit(1))  # as many rows as classes
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(every))
    share = counts.withColumn("size", size).withColumn("whole", F.floor(F.col("size") * F.col("n") / F.col("total")))
    rest = share.withColumn("rest", F.pmod(F.col("size") * F.col("n"), F.col("total")))
    place = F.row_number().over(every.orderBy(F.desc("rest"), F.col(by).asc_nulls_first()))
    more = rest.withColumn("more", (place <= F.col("size") - F.sum("whole").over(every)).cast("long"))
    return more.select(by, "n", (F.col("whole") + F.col("more")).alias("quota"))


def stratified_split(rows: DataFrame, test_size: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """``rows`` with ``part`` train or test; test has ceil(test_size * n) rows."""
    train = F.col("total") - F.ceil(F.lit(test_size) * F.col("total"))
    if not stratify:
        one = quotas(rows.select(F.lit(0).alias("y")), train).select(F.col("quota").alias("__q"))
        return ranked(rows, seed, None).crossJoin(F.broadcast(one)).withColumn("part", F.when(F.col("nth") <= F.col("__q"), "train").otherwise("test")).drop("nth", "__q")
    q = quotas(rows, train).select(F.col("y").alias("__y"), F.col("quota").alias("__q"))
    joined = ranked(rows, seed).join(F.broadcast(q), F.col("y").eqNullSafe(F.col("__y")))
    return joined.withColumn("part", F.when(F.col("nth") <= F.col("__q"), "train").otherwise("test")).drop("nth", "__y", "__q")


def stratified_sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows with the classes' shares; all rows if there are no more."""
    q = quotas(rows, F.least(F.lit(size).cast("long"), F.col("total"))).select(F.col("y").alias("__y"), F.col("quota").alias("__q"))
    joined = ranked(rows, seed).join(F.broadcast(q), F.col("y").eqNullSafe(F.col("__y")))
    return joined.where("nth <= __q").drop("nth", "__y", "__q")


def background_sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The ``size`` first rows in hash order: a bounded top-k."""
    if size <= 0:
        raise ValueError("the background needs at least one row")
    return rows.orderBy(expr.hash_order(seed, F.col("row_id")), "row_id").limit(size)


def stratified_folds(rows: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold`` from 0."""
    return ranked(rows, seed).withColumn("fold", F.pmod(F.col("nth") - 1, F.lit(k)).cast("int")).drop("nth")

"""Ranks of features and their fusion; windows here hold one row a feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _all():
    """One window over all rows."""
    return Window.partitionBy(F.lit(1))


def rank_descending(scores: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(feature, fidx, keep..., rank)``: 1 for the largest score, ties by fidx; a missing score gets the worst rank."""
    value = F.when(~F.isnan("score"), F.col("score"))
    place = F.row_number().over(_all().orderBy(value.desc_nulls_last(), "fidx"))
    return scores.select("feature", "fidx", *keep, F.when(value.isNull(), F.count("*").over(_all())).otherwise(place).cast("double").alias("rank"))


def fuse(ranks: dict[str, DataFrame]) -> DataFrame:
    """``(feature, fidx, rank_<method>..., mean_rank, overall_rank)``; absent ranks are left out of the mean."""
    if not ranks:
        raise ValueError("no ranking method is left")
    tables = [r.select("feature", "fidx", F.col("rank").alias(f"rank_{m}")) for m, r in ranks.items()]
    joined = reduce(lambda a, b: a.join(b, ["feature", "fidx"], "full"), tables)
    cols = [F.col(f"rank_{m}") for m in ranks]
    known = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    mean = joined.withColumn("mean_rank", F.try_divide(total, known.cast("double")))
    ties = F.count("*").over(Window.partitionBy("mean_rank"))
    return mean.withColumn("overall_rank", F.rank().over(_all().orderBy(F.col("mean_rank").asc_nulls_last())) + (ties - 1) / 2)


def select_top(fused: DataFrame, n: int) -> DataFrame:
    """``(pos, feature, fidx)``: the ``n`` best by mean rank, ties by fidx."""
    best = fused.orderBy(F.col("mean_rank").asc_nulls_last(), "fidx").limit(n)
    return best.select(F.row_number().over(_all().orderBy(F.col("mean_rank").asc_nulls_last(), "fidx")).alias("pos"), "feature", "fidx")


def keep_features(long: DataFrame, chosen: DataFrame) -> DataFrame:
    return long.join(F.broadcast(chosen.select("feature")), "feature", "left_semi")


def agreement(ranks: dict[str, DataFrame], top: int) -> DataFrame:
    """``(a, b, spearman, jaccard)`` of every two methods: rank correlation, and overlap of the ``top`` best."""
    long = reduce(DataFrame.unionByName, [r.select("feature", "rank", F.lit(m).alias("method")) for m, r in ranks.items()])
    pairs = long.alias("x").join(long.alias("y"), (F.col("x.feature") == F.col("y.feature")) & (F.col("x.method") < F.col("y.method")))
    both = F.count_if((F.col("x.rank") <= top) & (F.col("y.rank") <= top))
    either = F.count_if((F.col("x.rank") <= top) | (F.col("y.rank") <= top))
    return pairs.groupBy(F.col("x.method").alias("a"), F.col("y.method").alias("b")).agg(F.corr("x.rank", "y.rank").alias("spearman"), (both / either).alias("jaccard"))

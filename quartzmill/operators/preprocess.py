"""Imputation and standardisation of long sensor data, fitted on all rows or on training rows only."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.storage import stored
from .ranges import ACCURACY

LOG = logging.getLogger(__name__)

#: Shares between which the median's first bracket lies, far wider than the error of the approximate quantiles (1 / ACCURACY of the rows).
BRACKET = (0.49, 0.51)
#: Different values that one task may sort, and the cells by which a bracket that holds more is narrowed.
SORTED, CELLS = 1 << 16, 64


def _bracket() -> list[Column]:
    """Aggregates ``c``, ``lo`` and ``hi``: the number of values and a bracket of their median."""
    ends = F.percentile_approx("value", list(BRACKET), ACCURACY)
    return [F.count("value").alias("c"), F.get(ends, 0).alias("lo"), F.get(ends, 1).alias("hi")]


def narrowed(long: DataFrame, brackets: DataFrame, most: int = SORTED) -> DataFrame:
    """``brackets(feature, c, lo, hi)`` with at most about ``most`` different values of the column within each.

    A first bracket holds less than a thirtieth of a column, so shorter columns need no pass. Each pass takes quantiles of
    what lies within, of all features at once, and keeps the cells around the middle pair: about a
    twentieth is left. A bracket of equal ends, or whose values do not part any more, is done.
    """
    share, passes = 1 / 30, 0
    now = brackets.select("feature", "c", "lo", "hi", (F.col("c") * share).alias("held"))
    while not (open_ := now.where((F.col("held") > most) & (F.col("lo") < F.col("hi")))).isEmpty():
        rows = long.where("value is not null").join(F.broadcast(open_), "feature")  # a row a feature
        inside = F.when(F.col("value").between(F.col("lo"), F.col("hi")), F.col("value"))
        cells = F.percentile_approx(inside, [i / CELLS for i in range(CELLS + 1)], ACCURACY)
        found = rows.groupBy("feature", "c", "lo", "hi").agg(F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count(inside).alias("n"), F.approx_count_distinct(inside).alias("d"), cells.alias("q"))
        place = lambda i: (F.floor((F.col("c") + i) / 2) - F.col("below")) / F.col("n") * CELLS
        low = F.element_at("q", F.greatest(F.floor(place(1)) - 1, F.lit(0)).cast("int") + 1)
        high = F.element_at("q", F.least(F.ceil(place(2)) + 1, F.lit(CELLS)).cast("int") + 1)
        same = (low == F.col("lo")) & (high == F.col("hi"))
        fits = F.col("d") <= most
        next_ = found.select("feature", "c", F.when(fits, F.col("lo")).otherwise(low).alias("lo"), F.when(fits, F.col("hi")).otherwise(high).alias("hi"), F.when(fits | same, 0.0).otherwise(F.col("d")).alias("held"))
        done = now.where((F.col("held") <= most) | (F.col("lo") >= F.col("hi")))
        now, passes = stored(done.unionByName(next_), "brackets"), passes + 1
        LOG.debug("median brackets: pass %d", passes)
    return now.drop("held")


def _medians(long: DataFrame, brackets: DataFrame, most: int = SORTED) -> DataFrame:
    """``(feature, statistic)``: the exact median from ``brackets(feature, c, lo, hi)``, by counting the values below the bracket
    and ordering the different ones within it, about ``most`` of a feature in one task's sort."""
    joined = long.where("value is not null").join(F.broadcast(narrowed(long, brackets, most)), "feature")  # a row a feature
    within = F.when(F.col("value") >= F.col("lo"), F.col("value"))
    counts = joined.where("value <= hi").groupBy("feature", "c", within.alias("v")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("feature").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(order))
    place = lambda i: F.min(F.when(F.col("upto") >= F.floor((F.col("c") + i) / 2), F.col("v")))
    return upto.groupBy("feature").agg(((place(1) + place(2)) / 2).alias("statistic"))


def impute_statistics(long: DataFrame, strategy: str = "median", most: int = SORTED) -> DataFrame:
    """``(feature, statistic)`` of features with a value: the exact median (the middle pair's mean) or the mean."""
    if strategy not in ("median", "mean"):
        raise ValueError(f"strategy {strategy!r} is neither median nor mean")
    if strategy == "mean":
        return long.groupBy("feature").agg(F.avg("value").alias("statistic")).where("statistic is not null")
    return _medians(long, stored(long.groupBy("feature").agg(*_bracket()), "brackets"), most)


def impute(long: DataFrame, statistics: DataFrame) -> DataFrame:
    """Nulls replaced; a feature without a statistic becomes 0. The statistics have a row a feature."""
    return long.join(F.broadcast(statistics), "feature", "left").withColumn("value", expr.imputed(F.col("value"), F.col("statistic"))).drop("statistic")


def scale_statistics(long: DataFrame) -> DataFrame:
    """``(feature, mean, std)`` with the population standard deviation."""
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def standardise(long: DataFrame, statistics: DataFrame) -> DataFrame:
    scaled = long.join(F.broadcast(statistics), "feature", "left")
    return scaled.withColumn("value", expr.standardised(F.col("value"), F.col("mean"), F.col("std"))).drop("mean", "std")


def fitted(long: DataFrame, strategy: str = "median") -> DataFrame:
    """``(feature, statistic, mean, std)`` of features with a value, in one aggregate and, for the median, one pass over its bracket.

    Mean and deviation are those after imputation, from the counts and moments before it.
    """
    if strategy not in ("median", "mean"):
        raise ValueError(f"strategy {strategy!r} is neither median nor mean")
    value = F.col("value")
    moments = [F.count("*").alias("n"), F.avg(value).alias("a"), F.var_pop(value).alias("v"), (F.min(value) == F.max(value)).alias("constant")]
    if strategy == "mean":
        plain = long.groupBy("feature").agg(*moments, F.count(value).alias("c")).where("c > 0").withColumn("statistic", F.col("a"))
    else:
        plain = stored(long.groupBy("feature").agg(*moments, *_bracket()).where("c > 0"), "moments")
        plain = plain.join(F.broadcast(_medians(long, plain)), "feature")  # a row a feature
    n, c, s = F.col("n"), F.col("c"), F.col("statistic")
    moved = plain.withColumn("mean", F.when(F.col("constant"), s).otherwise((c * F.col("a") + (n - c) * s) / n))
    off = lambda x: (x - F.col("mean")) * (x - F.col("mean"))
    std = F.sqrt((c * (F.col("v") + off(F.col("a"))) + (n - c) * off(s)) / n)
    return moved.select("feature", "statistic", "mean", F.when(F.col("constant"), 0.0).otherwise(std).alias("std"))


def preprocess(long: DataFrame, fit_on: DataFrame | None = None, strategy: str = "median") -> DataFrame:
    """Drop features without a value, impute, standardise; ``fit_on`` gives the rows that fit (default: all)."""
    statistics = fitted(long if fit_on is None else fit_on, strategy)
    joined = long.join(F.broadcast(statistics), "feature")  # a row a feature
    value = expr.standardised(expr.imputed(F.col("value"), F.col("statistic")), F.col("mean"), F.col("std"))
    return joined.withColumn("value", value).drop("statistic", "mean", "std")

"""Ranges of about equal numbers of rows, so that no window or sort holds a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A power of two; the cut points of a group are one fewer.
RANGES = 256
ACCURACY = 1_000


def cut_points(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by..., cuts)``: approximate quantiles of ``value``, a row a group; any cuts give right results, these give even ones."""
    return rows.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("cuts"))


def range_of(cuts: Column, value: Column) -> Column:
    """The number of cuts below ``value``, by bisection; equal values share a range."""
    steps = [RANGES >> i for i in range(1, RANGES.bit_length())]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.element_at(cuts, at + s) < value, s).otherwise(0))


def with_range(rows: DataFrame, cuts: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``range_of`` as a column, a column a step: unlike the expression, those are compiled, which pays where rows are many."""
    out = rows.withColumn(name, F.lit(0))
    for i in range(1, RANGES.bit_length()):
        s = RANGES >> i
        out = out.withColumn(name, F.col(name) + F.when(F.element_at(cuts, F.col(name) + s) < F.col(value), s).otherwise(0))
    return out

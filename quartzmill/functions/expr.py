"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing number.
MISSING_TOKENS = ("NaN", "nan", "NA")
#: Tolerances of the self-consistency check.
TOLERANCE = {"linear": 1e-6, "tree": 1e-6, "kernel": 1e-2}
#: Case captions and the default description.
CASES = {"TP": "true positive", "FN": "false negative", "FP": "false positive", "TN": "true negative"}
UNDESCRIBED = "unknown(匿名)"


def feature_name(i: Column) -> Column:
    return F.format_string("F%03d", i.cast("int"))


def token_to_double(raw: Column) -> Column:
    """A missing token, an empty or a malformed field gives null; so does any NaN."""
    value = F.when(~F.trim(raw).isin(*MISSING_TOKENS), F.trim(raw)).try_cast("double")
    return F.when(~F.isnan(value), value)


def label_to_class(raw: Column) -> Column:
    """1 (fail) -> 1, -1 (pass) -> 0, anything else null."""
    return F.when(raw == 1, 1).when(raw == -1, 0)


def parse_time(raw: Column, form: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    return F.try_to_timestamp(raw, F.lit(form))


def hash_order(seed: int, row_id: Column) -> Column:
    """A pseudo-random order that any engine with MD5 gives again."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def imputed(value: Column, statistic: Column) -> Column:
    return F.coalesce(value, statistic, F.lit(0.0))


def standardised(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def predicted(score: Column, threshold: float) -> Column:
    return (score > threshold).cast("int")


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance


def consistent(deviation: Column, output: Column, method: str) -> Column:
    return F.abs(deviation) <= TOLERANCE[method] * F.greatest(F.lit(1.0), F.abs(output))


def case_caption(case: Column) -> Column:
    out = None
    for k, v in CASES.items():
        out = F.when(case == k, v) if out is None else out.when(case == k, v)
    return out


def described(feature: Column, meaning: Column) -> Column:
    return F.coalesce(meaning, F.lit(UNDESCRIBED))


def positive_class(values: Column) -> Column:
    """Of per-class values, the last (positive) one."""
    return F.element_at(values, -1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)

"""Metrics for imbalanced classification from ``(y, pred, score)`` rows, for any grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.storage import stored
from . import ranges


def _confusion_aggregates() -> list[Column]:
    y, p = F.col("y"), F.col("pred")
    cells = (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    return [F.count_if((y == a) & (p == b)).alias(name) for name, a, b in cells]


def confusion(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(by..., tn, fp, fn, tp)``."""
    return rows.groupBy(*by).agg(*_confusion_aggregates())


def balanced_error_rate() -> Column:
    """(FPR + FNR) / 2 of a confusion row; 1 if only one class occurs in labels and predictions together."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    single = ((tn + fp + fn) == 0) | ((tp + fp + fn) == 0)
    return F.when(single, 1.0).otherwise((expr.ratio(fp, fp + tn) + expr.ratio(fn, fn + tp)) / 2)


def rates(conf: DataFrame) -> DataFrame:
    """A confusion table with ber, accuracy, precision, recall and f1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.withColumns({
        "ber": balanced_error_rate(),
        "accuracy": expr.ratio(tp + tn, tp + tn + fp + fn),
        "precision": expr.ratio(tp, tp + fp),
        "recall": expr.ratio(tp, tp + fn),
        "f1": expr.ratio(2 * tp, 2 * tp + fp + fn),
    })


def score_points(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(by..., score, tn, fp, fn, tp, p, n)``: the counts of each score, written once; all metrics follow from these. Without predictions, p and n only."""
    counts = [*(_confusion_aggregates() if "pred" in rows.columns else ()), F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")]
    return stored(rows.groupBy(*by, "score").agg(*counts), "points")


def auc(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(by..., auc)``: the share of (positive, negative) pairs in order, ties one half; null for one class."""
    return _area(score_points(rows, by), list(by))


def _area(points: DataFrame, by: list[str]) -> DataFrame:
    """AUC from the counts of each score: running counts over ranges of about as many
    scores each, then within a range, so no window holds all scores."""
    points = points.where("score is not null and p + n > 0").select(*by, "score", "p", "n")
    cuts = F.broadcast(ranges.cut_points(points, by, "score"))  # a row a group
    joined = points.join(cuts, by) if by else points.crossJoin(cuts)
    placed = joined.withColumn("__b", ranges.range_of(F.col("cuts"), F.col("score"))).drop("cuts")
    counts = placed.groupBy(*by, "__b").agg(F.sum("n").alias("__m"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    own = Window.partitionBy(*by, "__b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__o") + F.coalesce(F.sum("n").over(own), F.lit(0))
    swept = placed.join(offsets, [*by, "__b"]).withColumn("__w", F.col("p") * (below + F.col("n") / 2))
    area = F.try_divide(F.sum("__w"), (F.sum("p") * F.sum("n")).cast("double"))
    return swept.groupBy(*by).agg(area.alias("auc"))


def evaluate(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``(by..., tn, fp, fn, tp, ber, accuracy, precision, recall, f1, auc)``, from one pass over ``rows``."""
    by = list(by)
    points = score_points(rows, by)
    cells = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tn", "fp", "fn", "tp")]
    table, area = rates(points.groupBy(*by).agg(*cells)), _area(points, by)
    return table.join(area, by, "left") if by else table.crossJoin(area)


def train_test_record(rows: DataFrame) -> DataFrame:
    """``rows(model, part, y, pred, score)`` -> ``(model, metric, value)``: train BER and six test metrics."""
    wide = evaluate(rows, ["model", "part"])
    cell = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"))
    test = F.array(cell("test_ber", "ber"), *(cell(c, c) for c in ("accuracy", "precision", "recall", "f1", "auc")))
    cells = F.when(F.col("part") == "test", test).when(F.col("part") == "train", F.array(cell("train_ber", "ber")))
    return wide.select("model", F.inline(cells))


def cross_validated(rows: DataFrame) -> DataFrame:
    """``rows(fold, y, pred)`` -> one row ``(mean_ber, std_ber)`` with the population deviation."""
    folds = rates(confusion(rows, ["fold"]))
    return folds.agg(F.avg("ber").alias("mean_ber"), F.stddev_pop("ber").alias("std_ber"))


def pick_cases(rows: DataFrame) -> DataFrame:
    """``(case, row_id, score)``: the hit (TP) and the miss (FN) with the highest score, first row on ties; absent cases are null."""
    case = F.when(F.col("pred") == 1, "TP").otherwise("FN")
    key = F.struct(F.col("score").alias("s"), (-F.col("row_id")).alias("r"))
    best = rows.where("y = 1").groupBy(case.alias("case")).agg(F.max_by(F.struct("row_id", "score"), key).alias("b")).select("case", "b.row_id", "b.score")
    both = rows.sparkSession.range(2).select(F.when(F.col("id") == 0, "TP").otherwise("FN").alias("case"))
    return F.broadcast(both).join(best, "case", "left")


def best_model(records: DataFrame, order: list[str], metric: str = "test_ber") -> DataFrame:
    """``(model, value)`` with the least metric; the first of ``order`` on ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rows = records.where((F.col("metric") == metric) & F.col("value").isNotNull())
    return rows.agg(F.min_by(F.struct("model", "value"), F.struct("value", place)).alias("b")).select("b.*")


def compare_baseline(current: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(model, metric, expected, actual, diff, ok)``: a missing value fails, a null baseline is skipped."""
    want = baseline.where("value is not null").withColumnRenamed("value", "expected")
    joined = want.join(current.withColumnRenamed("value", "actual"), ["model", "metric"], "left")
    diff = F.abs(F.col("actual") - F.col("expected"))
    return joined.select("model", "metric", "expected", "actual", diff.alias("diff"), F.coalesce(diff < tolerance, F.lit(False)).alias("ok"))


def all_pass(compared: DataFrame) -> DataFrame:
    return compared.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))

"""Classifiers on ``pyspark.ml``, and forests of ``forests``, with balanced class weights; data columns ``features``, ``y``, ``weight``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegression, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .forests import Forest, ForestClassifier
from .profile import with_class_weight

#: Display names and metric names of the metrics file.
DISPLAY_NAMES = {"logistic": "逻辑回归", "random_forest": "随机森林", "ridge": "岭分类器"}
METRIC_NAMES = {"train_ber": "训练集BER", "test_ber": "测试集BER", "accuracy": "准确率", "precision": "精确率", "recall": "召回率", "f1": "F1分数", "auc": "AUC"}


def logistic(total_weight: float, features_col: str = "features", c: float = 1.0) -> LogisticRegression:
    """Minimises C * sum of weighted losses + |b|^2 / 2: Spark averages the losses, so the penalty is 1 / (C * total weight)."""
    return LogisticRegression(
        featuresCol=features_col, labelCol="y", weightCol="weight", maxIter=1000, tol=1e-10, standardization=False,
        regParam=1.0 / (c * max(total_weight, 1e-300)), elasticNetParam=0.0,
    )


def forest(seed: int, trees: int = 100, depth: int = 30, bins: int = 128, drawn: bool = True) -> ForestClassifier:
    """The splits come from histograms of ``bins`` values. Unless ``drawn``, each tree takes all rows and all features."""
    return ForestClassifier(seed, trees, depth, bins, drawn)


def ridge(total_weight: float, alpha: float = 1.0) -> LinearRegression:
    """Weighted least squares on targets of -1 and 1 with penalty alpha * |b|^2."""
    return LinearRegression(
        featuresCol="features", labelCol="target", weightCol="weight", solver="normal", standardization=False,
        regParam=alpha / max(total_weight, 1e-300), elasticNetParam=0.0,
    )


def _fit_logistic(rows: DataFrame, total: float, seed: int):
    return logistic(total).fit(rows)


def _fit_forest(rows: DataFrame, total: float, seed: int):
    return forest(seed).fit(rows)


def _fit_ridge(rows: DataFrame, total: float, seed: int):
    return ridge(total).fit(rows.withColumn("target", 2.0 * F.col("y") - 1.0))


#: Extension point: name -> fit(rows, total weight, seed).
REGISTRY: dict[str, Callable] = {"logistic": _fit_logistic, "random_forest": _fit_forest, "ridge": _fit_ridge}


def fit_function(name: str) -> Callable:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def active_models(active: str) -> list[str]:
    """All registered models in order, or the one named."""
    if active == "all":
        return list(REGISTRY)
    fit_function(active)
    return [active]


def fit(name: str, rows: DataFrame, strategy: str = "class_weight", seed: int = 42):
    """``rows(features, y)`` -> fitted model."""
    how = fit_function(name)
    weighted = with_class_weight(rows, strategy)
    total = weighted.agg(F.sum("weight")).first()[0]
    return how(weighted, float(total or 0.0), seed)


def kind(model) -> str:
    """``tree``, ``linear`` or ``kernel``: how the model is explained."""
    if isinstance(model, (Forest, RandomForestClassificationModel, DecisionTreeClassificationModel)):
        return "tree"
    return "linear" if hasattr(model, "coefficients") else "kernel"


def has_probability(model) -> bool:
    return model.hasParam("probabilityCol")


def is_classifier(model) -> bool:
    return model.hasParam("rawPredictionCol")


def output_space(model) -> str:
    if kind(model) == "linear":
        return "log-odds (decision margin)" if has_probability(model) else "decision margin"
    return "positive-class probability" if has_probability(model) else "predicted class (0/1)"


#: What the displayed score is.
SCORE_LABELS = {"probability": "失效概率", "margin": "决策分数(>0 判失效)", "class": "预测类别"}


def score_label(model) -> str:
    """Meaning of ``score``: a probability, a decision margin or a predicted class; none passes for another."""
    return SCORE_LABELS["probability" if has_probability(model) else "margin" if kind(model) == "linear" else "class"]


def score(model, rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """``rows`` with ``score`` (probability, else margin), ``margin`` (explained output) and ``pred``."""
    out = model.transform(rows)
    if has_probability(model):
        p = F.element_at(vector_to_array("probability"), 2)
        m = F.element_at(vector_to_array("rawPrediction"), 2) if kind(model) == "linear" else p
        limit = 0.5 if threshold is None else threshold
    else:
        linear = kind(model) == "linear"
        p = m = F.element_at(vector_to_array("rawPrediction"), 2) if linear and is_classifier(model) else F.col("prediction")
        limit = (0.0 if linear else 0.5) if threshold is None else threshold
    scored = out.withColumns({"score": p, "margin": m})
    return scored.select(*rows.columns, "score", "margin", expr.predicted(F.col("score"), limit).alias("pred"))

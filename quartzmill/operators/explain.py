"""Additive attributions: linear in closed form, trees along their paths, any model by coalitions."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import kernel, trees
from .kernel import KERNEL_BACKGROUND, KERNEL_ROWS  # noqa: F401

LOG = logging.getLogger(__name__)


def validate(feature_names: list[str], rows: list[str], background: list[str] | None, n_background: int) -> None:
    if len(feature_names) != len(rows):
        raise ValueError(f"{len(feature_names)} feature names for {len(rows)} columns")
    if list(feature_names) != list(rows):
        raise ValueError("the columns are not the named features in their order")
    if background is not None and list(rows) != list(background):
        raise ValueError("rows and background differ in columns or their order")
    if n_background <= 0:
        raise ValueError("the background is empty")


def column_names(rows: DataFrame) -> list[str] | None:
    """The features behind a vector column in their order, where the column knows them: its own list, or an assembler's attributes."""
    known = rows.schema["features"].metadata
    if "names" in known:
        return known["names"]
    attributes = [a for kind in known.get("ml_attr", {}).get("attrs", {}).values() for a in kind]
    return [a["name"] for a in sorted(attributes, key=lambda a: a["idx"])] if attributes and all("name" in a for a in attributes) else None


def vector_cells(rows: DataFrame, features: list[str]) -> Column:
    """The vector column as an array of just these features: other known names are refused here, another length where the plan runs."""
    from pyspark.ml.functions import vector_to_array

    known = column_names(rows)
    if known is not None:
        validate(features, known, None, 1)
    cells = vector_to_array("features")
    wrong = F.concat(F.lit(f"{len(features)} feature names for a vector of "), F.size(cells).cast("string"))
    return F.when(F.size(cells) == len(features), cells).otherwise(F.raise_error(wrong))


def background_means(background: DataFrame) -> DataFrame:
    return background.groupBy("feature").agg(F.avg("value").alias("bg"))


def linear_shap(rows: DataFrame, coefficients: DataFrame, background: DataFrame) -> DataFrame:
    """Long ``rows`` and ``coefficients(feature, beta)`` -> ``(row_id, feature, fidx, value, phi)``; phi = beta * (x - background mean)."""
    both = coefficients.join(background_means(background), "feature")
    joined = rows.join(F.broadcast(both), "feature")  # a row a feature
    return joined.select("row_id", "feature", "fidx", "value", (F.col("beta") * (F.col("value") - F.col("bg"))).alias("phi"))


def linear_base(coefficients: DataFrame, background: DataFrame, intercept: float) -> DataFrame:
    """One row ``(base,)``: the output at the background's mean."""
    both = coefficients.join(background_means(background), "feature")
    return both.agg((F.coalesce(F.sum(F.col("beta") * F.col("bg")), F.lit(0.0)) + F.lit(intercept)).alias("base"))


def linear_output(rows: DataFrame, coefficients: DataFrame, intercept: float) -> DataFrame:
    """``(row_id, output)``: sum of beta * x plus the intercept."""
    joined = rows.join(F.broadcast(coefficients), "feature")
    return joined.groupBy("row_id").agg((F.sum(F.col("beta") * F.col("value")) + F.lit(intercept)).alias("output"))


def linear_consistency(rows: DataFrame, coefficients: DataFrame, background: DataFrame, intercept: float) -> DataFrame:
    """``(row_id, phi_sum, base, output, deviation, consistency_ok)`` of a linear model in one pass over long ``rows``."""
    both = coefficients.join(background_means(background), "feature")
    joined = rows.join(F.broadcast(both), "feature")  # a row a feature
    beta, value = F.col("beta"), F.col("value")
    sums = joined.groupBy("row_id").agg(F.sum(beta * (value - F.col("bg"))).alias("phi_sum"), (F.sum(beta * value) + F.lit(intercept)).alias("output"))
    base = both.agg((F.coalesce(F.sum(beta * F.col("bg")), F.lit(0.0)) + F.lit(intercept)).alias("base"))
    placed = sums.crossJoin(F.broadcast(base))  # one row
    deviation = F.abs(F.col("base") + F.col("phi_sum") - F.col("output"))
    return placed.select("row_id", "phi_sum", "base", "output", deviation.alias("deviation"), expr.consistent(deviation, F.col("output"), "linear").alias("consistency_ok"))


def self_consistency(phi: DataFrame, base: DataFrame, outputs: DataFrame, method: str) -> DataFrame:
    """``(row_id, phi_sum, base, output, deviation, consistency_ok)``."""
    sums = phi.groupBy("row_id").agg(F.sum("phi").alias("phi_sum"))
    joined = sums.join(outputs, "row_id").crossJoin(F.broadcast(base))  # one row
    deviation = F.abs(F.col("base") + F.col("phi_sum") - F.col("output"))
    return joined.select("row_id", "phi_sum", "base", "output", deviation.alias("deviation"), expr.consistent(deviation, F.col("output"), method).alias("consistency_ok"))


def global_importance(phi: DataFrame) -> DataFrame:
    """``(feature, fidx, mean_abs, std_abs, rank)`` with the population deviation."""
    size = F.abs("phi")
    out = phi.groupBy("feature", "fidx").agg(F.avg(size).alias("mean_abs"), F.stddev_pop(size).alias("std_abs"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "fidx")))


def ranked_contributions(phi: DataFrame, top: int = 5) -> DataFrame:
    """``(row_id, side, pos, feature, value, phi)``: the largest pushing (phi > 0) and protecting (phi < 0) features."""
    side = F.when(F.col("phi") > 0, "push").when(F.col("phi") < 0, "protect")
    order = Window.partitionBy("row_id", "side").orderBy(F.desc(F.abs("phi")), "fidx")
    placed = phi.withColumn("side", side).where("side is not null").withColumn("pos", F.row_number().over(order))
    return placed.where(F.col("pos") <= top).select("row_id", "side", "pos", "feature", "value", "phi")


def plot_bars(phi: DataFrame, top: int = 10) -> DataFrame:
    """``(row_id, pos, feature, phi, colour)``: the largest contributions of each row, red above zero, else blue."""
    order = Window.partitionBy("row_id").orderBy(F.desc(F.abs("phi")), "fidx")
    placed = phi.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top)
    return placed.select("row_id", "pos", "feature", "phi", F.when(F.col("phi") > 0, "red").otherwise("blue").alias("colour"))


def report_lines(contributions: DataFrame) -> DataFrame:
    """``(row_id, side, pos, line)`` with four signed decimals."""
    line = F.format_string("  %d. %s: %+.4f (value=%.3f)", F.col("pos"), F.col("feature"), F.col("phi"), F.col("value"))
    return contributions.select("row_id", "side", "pos", line.alias("line"))


# -- trees ---------------------------------------------------------------------


def tree_shap_values(leaves, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Expected value under the covers and Shapley values (rows, features) of leaves (value, [(feature, low, high, cover ratio)])."""
    groups = trees.of_paths(leaves)
    return trees.base_value(groups), trees.shap_values(groups, x)


def wide_map(rows: DataFrame, features: list[str], run: Callable[[np.ndarray], tuple[np.ndarray, ...]], columns: tuple[str, ...] = ("phi",)) -> DataFrame:
    """``rows(row_id, features)`` through ``run`` (rows, features) -> an array of that shape for each of ``columns``, as long ``(row_id, feature, fidx, value, columns...)``."""
    names = list(features)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                n = len(names)
                cells = {"row_id": np.repeat(pdf["row_id"].to_numpy(), n), "feature": names * len(pdf), "fidx": np.tile(np.arange(n, dtype=np.int32), len(pdf)), "value": x.ravel()}
                yield pd.DataFrame(cells | {c: a.ravel() for c, a in zip(columns, run(x), strict=True)})

    own = rows.select("row_id", vector_cells(rows, features).alias("x"))
    return own.mapInPandas(each, "row_id long, feature string, fidx int, value double, " + ", ".join(f"{c} double" for c in columns))


tree_shap = trees.tree_shap


# -- any model -----------------------------------------------------------------


def kernel_shap_values(predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, x: np.ndarray, seed: int = 0) -> tuple[float, np.ndarray]:
    """Base and Shapley values of ``predict`` against a background."""
    return kernel.estimate(predict, background, x, seed)[:2]


model_shap = kernel.model_shap


def kernel_shap(predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, rows: DataFrame, features: list[str], seed: int = 0) -> tuple[float, DataFrame]:
    """Base and ``(row_id, feature, fidx, value, phi, error)``.

    At most ``KERNEL_BACKGROUND`` background rows; ``rows`` are to be at most ``KERNEL_ROWS``, as the caller samples.
    """
    if not len(background):
        raise ValueError("the background is empty")
    background = background[:KERNEL_BACKGROUND]
    return float(predict(background).mean()), wide_map(rows, features, lambda x: kernel.estimate(predict, background, x, seed)[1:], ("phi", "error"))


def coefficients_of(model, features: list[str]) -> DataFrame:
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(b)) for f, b in zip(features, model.coefficients.toArray(), strict=True)], "feature string, beta double")


def long_of(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows(row_id, features vector)`` -> ``(row_id, feature, fidx, value)``."""
    names = F.array(*[F.lit(f) for f in features])
    cells = rows.select("row_id", F.posexplode(vector_cells(rows, features)).alias("fidx", "value"))
    return cells.select("row_id", F.element_at(names, F.col("fidx") + 1).alias("feature"), "fidx", "value")


def explain(model, rows: DataFrame, background: DataFrame, features: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Attributions, one-row ``(base,)`` and method for vector rows ``(row_id, features)``.

    Trees by their paths, linear models in closed form, all others by coalitions; a forest that
    cannot be read is explained by coalitions, with a warning.
    """
    from . import models

    method = models.kind(model)
    spark = rows.sparkSession
    for side in (rows, background):
        vector_cells(side, features)  # refuses other columns, whatever the method
    if method == "tree":
        try:
            base, phi = tree_shap(model, rows, features)
        except Exception as error:
            LOG.warning("tree attributions failed (%s); coalitions are used instead", error)
            method = "kernel"
    if method == "kernel":
        base, phi = model_shap(model, rows, background, features, seed)
    if method == "linear":
        coef = coefficients_of(model, features)
        bg = long_of(background, features)
        return linear_shap(long_of(rows, features), coef, bg), linear_base(coef, bg, float(model.intercept)), method
    return phi, spark.createDataFrame([(base,)], "base double"), method


def case_record(row, attributions: DataFrame, base: DataFrame, method: str, model, case: str | None = None) -> dict:
    """The record of one explained row; ``row`` has row_id, y, pred, score and margin."""
    from . import models

    own = attributions.where(F.col("row_id") == row.row_id)
    spark = attributions.sparkSession
    outputs = spark.createDataFrame([(row.row_id, float(row.margin))], "row_id long, output double")
    check = self_consistency(own, base, outputs, method).first()
    cells = own.orderBy(F.desc(F.abs("phi")), "fidx").collect()  # a row a feature
    # fixed values: the record's field names
    return {
        "wafer_id": row.row_id, "case": case, "shap_method": method, "output_space": models.output_space(model),
        "y_true": row.y, "y_pred": row.pred, "score": float(row.score), "score_label": models.score_label(model),
        "baseline": check.base, "explained_output": check.output, "reconstruction": check.base + check.phi_sum,
        "consistency_ok": bool(check.consistency_ok), "shap_values": {c.feature: c.phi for c in cells},
    }


def report_text(record: dict, contributions: DataFrame, model_name: str) -> str:
    """The whole report of a record, a line a fact; ``contributions`` as ``ranked_contributions`` gives them."""
    state = lambda v: "fail" if v == 1 else "pass"
    total, gap = record["reconstruction"] - record["baseline"], abs(record["reconstruction"] - record["explained_output"])
    facts = {
        "model": model_name,
        "row": record["wafer_id"],
        "case": f"{record['case']} ({expr.CASES[record['case']]})" if record["case"] else None,
        "true state": state(record["y_true"]),
        "predicted state": state(record["y_pred"]),
        f"displayed score [{record['score_label']}]": f"{record['score']:.4f}",
        "method": record["shap_method"],
        "explained space": f"{record['output_space']} (not to be compared with the displayed score)",
        "base + contributions": f"{record['baseline']:.4f} + {total:.4f} = {record['reconstruction']:.4f}",
        "model output": f"{record['explained_output']:.4f}",
        "deviation": f"{gap:.2e} [{'OK' if record['consistency_ok'] else 'beyond tolerance'}]",
    }
    lines = report_lines(contributions).orderBy("pos").collect()
    out = [f"{k}: {v}" for k, v in facts.items() if v is not None]
    for side, title in (("push", "pushing towards failure"), ("protect", "protecting from failure")):
        own = [r.line for r in lines if r.side == side]
        out += ["", f"top {len(own)} {title}:", *(own or ["  (none)"])]
    return "\n".join(out) + "\n"


def importance_json(importance: DataFrame, **meta: str | int) -> DataFrame:
    """One row ``(json,)``: meta fields and a map of features to mean_abs_shap, std_abs_shap and rank."""
    entry = F.struct("feature", F.struct(F.col("mean_abs").alias("mean_abs_shap"), F.col("std_abs").alias("std_abs_shap"), F.col("rank")).alias("v"))
    cells: list[Column] = [F.lit(v).alias(k) for k, v in meta.items()]
    features = F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("features")
    return importance.agg(features).select(F.to_json(F.struct(*cells, "features")).alias("json"))

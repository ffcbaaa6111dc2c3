"""The full run: load, preprocess, select, split, fit, evaluate, explain, compare, write."""

from __future__ import annotations

import json
import logging
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts
from ..operators import explain as X
from ..operators import metrics, models, preprocess, profile, ranking, scoring, sinks, split
from ..sources import sensor_files as S
from .storage import stored

LOG = logging.getLogger(__name__)
TOP_LINE = "feature %d: %s, mean contribution %.4f"

#: Names and defaults of the configuration.
DEFAULTS: dict = {
    "random_state": 42,
    "preprocessing": {"drop_missing_threshold": 1.0, "impute_strategy": "median", "scale": True, "fit_on_train_only": False},
    "feature_selection": {"n_features_to_select": 40, "methods": ["f_test", "mutual_info", "rfe", "random_forest"], "override_features_path": None, "rfe_step": 1},
    "split": {"test_size": 0.2, "stratify": True},
    "imbalance": {"strategy": "class_weight", "decision_threshold": None},
    "model": {"active": "all", "cv_folds": 10},
    "evaluation": {"run_cv": False},
    "reproducibility": {"baseline_path": None, "tolerance": 0.01},
    "explain": {"enabled": True, "required": True, "background_size": 100},
    "output": {"results_dir": None},
    "run": {"quick": False, "quick_sample_size": 200},
}


def configured(cfg: dict | None) -> dict:
    """The defaults under the given values, two levels deep."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in DEFAULTS.items()}
    for k, v in (cfg or {}).items():
        out[k] = out.get(k, {}) | v if isinstance(v, dict) else v
    return out


def select_features(long: DataFrame, cfg: dict, quick: bool) -> tuple[list[str], DataFrame]:
    """Names in order of mean rank and the rank table; quick runs leave elimination out."""
    fs, seed = cfg["feature_selection"], cfg["random_state"]
    methods = [m for m in fs["methods"] if not (quick and m == "rfe")]
    names = [r.feature for r in long.select("feature", "fidx").distinct().orderBy("fidx").collect()]
    order = {f: i for i, f in enumerate(names)}
    n = min(fs["n_features_to_select"], len(names))
    ids = long.sparkSession.createDataFrame(list(order.items()), "feature string, fidx int")
    again = lambda df, c: df.drop("fidx").join(F.broadcast(ids), "feature").select("feature", "fidx", c)
    ranks: dict[str, DataFrame] = {}
    wide = stored(scoring.vectors(long, names), "vectors") if {"rfe", "random_forest"} & set(methods) else None
    for m in methods:
        if m == "f_test":
            ranks[m] = ranking.rank_descending(scoring.anova_f(long))
        elif m == "mutual_info":
            ranks[m] = ranking.rank_descending(scoring.knn_mutual_info(long).drop("raw"))
        elif m == "random_forest":
            ranks[m] = ranking.rank_descending(again(scoring.forest_importance(wide, names, seed), "score"))
        elif m == "rfe":
            ranks[m] = again(scoring.rfe_ranks(wide, names, n, fs.get("rfe_step", 1)), "rank")
        else:
            raise KeyError(f"unknown selection method {m!r}")
    ranks = {m: again(r, "rank") for m, r in ranks.items()}
    fused = stored(ranking.fuse(ranks), "ranks")  # a row a feature, read twice
    chosen = ranking.select_top(fused, n).orderBy("pos").collect()
    return [r.feature for r in chosen], fused


def _background(train: DataFrame, cfg: dict) -> DataFrame:
    size = cfg["explain"]["background_size"]
    if size <= 0:
        raise ValueError("the background needs at least one row")
    return stored(split.background_sample(train, size, cfg["random_state"]), "background")


def explain_global(model, test: DataFrame, features: list[str], name: str, folder: str | None, background: DataFrame | None = None, seed: int = 0) -> dict:
    """Attributions of all test rows, their base and method, and the importance file; without a background, the rows themselves are one."""
    background = test if background is None else background
    n_background = background.count()
    X.validate(features, scoring.vector_names(test) or features, scoring.vector_names(background), n_background)
    phi, base, method = X.explain(model, test, background, features, seed)
    phi = stored(phi, "phi")
    importance = stored(X.global_importance(phi), "importance")
    for r in importance.where("rank <= 5").orderBy("rank").collect():
        LOG.info(TOP_LINE, r["rank"], r.feature, r.mean_abs)
    n = phi.select("row_id").distinct().count()
    out = {"phi": phi, "base": base, "shap_method": method, "output_space": models.output_space(model), "background_size": n_background, "n_samples_explained": n}
    if folder:
        meta = {"model": name, "shap_method": method, "output_space": out["output_space"], "random_seed": seed, "background_size": n_background, "n_samples_explained": n}
        sinks.write_json(json.loads(X.importance_json(importance, **meta).first().json), f"{folder}/shap_values_{name}.json")
        sinks.write_bytes(charts.summary_chart(importance, method), f"{folder}/{summary_file(name)}")
    return out


#: Names of the explanation's files.
def summary_file(name: str) -> str:
    return f"shap_summary_bar_{name}.png"


def case_files(row_id: int, case: str | None) -> tuple[str, str]:
    """Report and chart of one row."""
    suffix = f"_{case}" if case else ""
    return f"shap_explanation_wafer_{row_id}{suffix}.txt", f"shap_contribution_wafer_{row_id}{suffix}.png"


def explain_case(model, row, found: dict, features: list[str], name: str, folder: str | None, background: DataFrame, case: str, seed: int) -> tuple[dict, str | None, str | None]:
    """The record, the report and the chart of one row; a row that the global stage left out is explained by itself."""
    phi, base, method = found["phi"], found["base"], found["shap_method"]
    if phi.where(F.col("row_id") == row.row_id).isEmpty():
        one = row_frame(background, row)
        phi, base, method = X.explain(model, one, background, features, seed)
    record = X.case_record(row, phi, base, method, model, case)
    if not folder:
        return record, None, None
    own = phi.where(F.col("row_id") == row.row_id)
    report, plot = case_files(row.row_id, case)
    sinks.write_text(X.report_text(record, X.ranked_contributions(own), name), f"{folder}/{report}")
    sinks.write_bytes(charts.contribution_chart(X.plot_bars(own), row.row_id, method, case), f"{folder}/{plot}")
    return record, report, plot


#: Names and kinds of the manifest's fields.
MANIFEST = """enabled boolean, status string, reason string, error string, run_tag string, model string, random_seed long, background_size long, shap_method string, output_space string,
    global struct<png: string, json: string, n_samples_explained: long>,
    cases map<string, struct<status: string, reason: string, error: string, wafer_id: long, report: string, plot: string, output_space: string, consistency_ok: boolean, deviation: double>>"""


def manifest_frame(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    """Manifests as rows, cases as a map; absent fields are null."""
    return spark.createDataFrame([(json.dumps(m, default=str),) for m in manifests], "json string").select(F.from_json("json", MANIFEST).alias("m")).select("m.*")


def row_frame(like: DataFrame, row) -> DataFrame:
    return like.sparkSession.createDataFrame([(row.row_id, row.y, row.features)], like.select("row_id", "y", "features").schema)


def explain_stage(fitted: dict, best: str, train: DataFrame, test: DataFrame, features: list[str], cfg: dict, folder: str | None, tag: str, case_of=explain_case) -> dict:
    """Global and single-row attributions of the best model; the manifest is written whatever happens. ``case_of`` makes a case's record and files."""
    ex, seed = cfg["explain"], cfg["random_state"]
    if not ex["enabled"]:
        manifest = {"enabled": False, "status": "disabled", "reason": "config explain.enabled=false", "run_tag": tag}
        if folder:
            sinks.write_json(manifest, f"{folder}/shap_manifest.json")
        return manifest
    name = models.DISPLAY_NAMES.get(best, best)
    manifest = {"enabled": True, "status": "failed", "run_tag": tag, "model": name, "random_seed": seed, "global": None, "cases": {}}
    try:
        background = _background(train, cfg)
        model = fitted[best]
        found = explain_global(model, test, features, name, folder, background, seed)
        manifest |= {k: found[k] for k in ("background_size", "shap_method", "output_space")}
        manifest["global"] = {"png": summary_file(name), "json": f"shap_values_{name}.json", "n_samples_explained": found["n_samples_explained"]}
        scored = models.score(model, test)
        cases = {r.case: r.row_id for r in metrics.pick_cases(scored).collect()}
        for case in ("TP", "FN"):
            manifest["cases"][case] = _case_entry(case, cases.get(case), scored, model, found, features, name, folder, background, seed, manifest["cases"], case_of)
        manifest["status"] = "ok"
    except Exception as error:
        manifest["error"] = str(error)
        if ex["required"]:
            raise RuntimeError("the explanation failed") from error
    finally:
        if folder:
            sinks.write_json(manifest, f"{folder}/shap_manifest.json")
    return manifest


def _case_entry(case: str, row_id, scored: DataFrame, model, found: dict, features: list[str], name: str, folder: str | None, background: DataFrame, seed: int, entries: dict, case_of=explain_case) -> dict:
    if row_id is None:
        return {"status": "skipped", "reason": f"no {case} row in the test set"}
    try:
        row = scored.where(F.col("row_id") == row_id).first()
        record, report, plot = case_of(model, row, found, features, name, folder, background, case, seed)
    except Exception as error:
        entries[case] = {"status": "failed", "error": str(error)}
        raise
    return {
        "status": "generated", "wafer_id": record["wafer_id"], "report": report, "plot": plot, "output_space": record["output_space"],
        "consistency_ok": record["consistency_ok"], "deviation": abs(record["reconstruction"] - record["explained_output"]), "record": record,
    }


def displayed(record: dict[str, dict[str, float | None]]) -> dict[str, dict[str, float | None]]:
    """A metrics record under the names of the metrics file."""
    return {models.DISPLAY_NAMES.get(m, m): {models.METRIC_NAMES.get(k, k): v for k, v in r.items()} for m, r in record.items()}


def run(spark: SparkSession, rows: DataFrame, cfg: dict | None = None, quick: bool | None = None) -> dict:
    """``rows(row_id, y, feature columns...)`` -> metrics, best model, features, explanation and baseline report."""
    cfg = configured(cfg)
    quick = cfg["run"]["quick"] if quick is None else quick
    seed, pre, tag = cfg["random_state"], cfg["preprocessing"], time.strftime("%Y%m%d_%H%M%S")
    folder = cfg["output"]["results_dir"]
    if quick:
        rows = stored(split.stratified_sample(rows, cfg["run"]["quick_sample_size"], seed), "rows")
    parts = stored(split.stratified_split(rows.select("row_id", "y"), cfg["split"]["test_size"], seed, cfg["split"]["stratify"]).select("row_id", "part"), "parts")
    long = stored(S.to_long(rows), "cells")
    dropped = [r.feature for r in profile.all_null_features(long, pre["drop_missing_threshold"]).orderBy("fidx").collect()]
    kept = long.where(~F.col("feature").isin(dropped)) if dropped else long
    in_train = kept.join(parts.where("part = 'train'"), "row_id", "left_semi")
    fit_on = in_train if pre["fit_on_train_only"] else None
    clean = preprocess.preprocess(kept, fit_on, pre["impute_strategy"]) if pre["scale"] else preprocess.impute(kept, preprocess.impute_statistics(kept if fit_on is None else fit_on, pre["impute_strategy"]))
    clean = stored(clean, "clean")
    override = cfg["feature_selection"]["override_features_path"]
    if override:
        features, detail = S.read_feature_list(spark, override), None
    else:
        source = clean.join(parts.where("part = 'train'"), "row_id", "left_semi") if pre["fit_on_train_only"] else clean
        features, detail = select_features(source, cfg, quick)
    wide = scoring.vectors(clean.where(F.col("feature").isin(features)), features).join(parts, "row_id")
    wide = stored(wide, "wide")
    train, test = wide.where("part = 'train'").drop("part"), wide.where("part = 'test'").drop("part")
    fitted, scored = {}, []
    for name in models.active_models(cfg["model"]["active"]):
        fitted[name] = models.fit(name, train, cfg["imbalance"]["strategy"], seed)
        scored.append(models.score(fitted[name], wide, cfg["imbalance"]["decision_threshold"]).withColumn("model", F.lit(name)))
    records = stored(metrics.train_test_record(stored(reduce(DataFrame.unionByName, scored), "scored")), "records")
    best = metrics.best_model(records, list(models.REGISTRY)).first().model
    out = {"metrics": sinks.metrics_record(records), "best_model": best, "selected_features": features, "dropped_columns": dropped, "rank_table": detail, "baseline_ok": None, "baseline_report": None, "explain": None, "output_dir": folder, "cv": None}
    if cfg["evaluation"]["run_cv"] and not quick:
        out["cv"] = {n: cross_validate(n, wide.drop("part"), cfg) for n in fitted}
    shown = displayed(out["metrics"])
    if folder:
        sinks.write_json(shown, f"{folder}/metrics_{tag}.json")
        chosen = spark.createDataFrame([(i, f) for i, f in enumerate(features, 1)], "pos int, feature string")
        sinks.write_feature_list(chosen, f"{folder}/selected_features_{tag}.txt")
        sinks.write_model(fitted[best], f"{folder}/best_model_{best}_{tag}")
    if not quick:
        out["explain"] = explain_stage(fitted, best, train, test, features, cfg, folder, tag)
        if cfg["reproducibility"]["baseline_path"]:
            current = spark.createDataFrame([(m, k, v) for m, r in shown.items() for k, v in r.items()], "model string, metric string, value double")
            compared = metrics.compare_baseline(current, S.read_baseline(spark, cfg["reproducibility"]["baseline_path"]), cfg["reproducibility"]["tolerance"])
            out["baseline_report"] = [r.asDict() for r in compared.orderBy("model", "metric").collect()]
            out["baseline_ok"] = metrics.all_pass(compared).first().ok
    return out


def cross_validate(name: str, rows: DataFrame, cfg: dict) -> dict[str, float]:
    """Mean and population deviation of the folds' balanced error rates."""
    k = cfg["model"]["cv_folds"]
    folds = split.stratified_folds(rows, k, cfg["random_state"])
    folds = stored(folds, "folds")
    scored = []
    for i in range(k):
        model = models.fit(name, folds.where(F.col("fold") != i), cfg["imbalance"]["strategy"], cfg["random_state"])
        scored.append(models.score(model, folds.where(F.col("fold") == i)))
    got = metrics.cross_validated(reduce(DataFrame.unionByName, scored)).first()
    return {"mean_ber": got.mean_ber, "std_ber": got.std_ber}

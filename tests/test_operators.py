"""Operators on fixtures with known results, files, models and attributions."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quartzmill.operators import explain as X
from quartzmill.operators import metrics, models, preprocess, profile, ranges, ranking, scoring, sinks, split
from quartzmill.plans import run as R
from quartzmill.plans.storage import folder
from quartzmill.sources import sensor_files as S

#: Confusion matrices (tp, fn, fp, tn) and the metrics they imply.
KNOWN = [((15, 6, 71, 222), 0.264018, 0.754777, 0.174419, 0.714286, 0.280374), ((1, 20, 0, 293), 0.476190, 0.936306, 1.0, 0.047619, 0.090909), ((15, 6, 67, 226), 0.257192, 0.767516, 0.182927, 0.714286, 0.291262), ((0, 21, 0, 293), 0.5, 0.933121, 0.0, 0.0, 0.0)]


def scored(spark, tp, fn, fp, tn):
    rows = [(1, 1)] * tp + [(1, 0)] * fn + [(0, 1)] * fp + [(0, 0)] * tn
    return spark.createDataFrame([(i, y, p, float(p)) for i, (y, p) in enumerate(rows)], "row_id long, y int, pred int, score double")


@pytest.mark.parametrize("cells,ber,accuracy,precision,recall,f1", KNOWN)
def test_metrics(spark, cells, ber, accuracy, precision, recall, f1):
    r = metrics.evaluate(scored(spark, *cells)).first()
    for got, want in ((r.ber, ber), (r.accuracy, accuracy), (r.precision, precision), (r.recall, recall), (r.f1, f1)):
        assert got == pytest.approx(want, abs=1e-6)


def test_metrics_edges(spark):
    one = metrics.evaluate(scored(spark, 0, 0, 0, 5)).first()
    assert one.ber == 1.0 and one.auc is None
    both = metrics.evaluate(scored(spark, 0, 0, 3, 2)).first()
    assert both.ber == pytest.approx(0.3)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, score double")
    d = s[y == 1][:, None] - s[y == 0][None]
    assert metrics.auc(df).first().auc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


def test_case_picking(spark):
    rows = [(0, 1, 1, 0.9), (1, 1, 0, 0.4), (2, 1, 0, 0.2), (3, 0, 0, 0.1), (4, 0, 1, 0.8)]
    got = {r.case: r.row_id for r in metrics.pick_cases(spark.createDataFrame(rows, "row_id long, y int, pred int, score double")).collect()}
    assert got == {"TP": 0, "FN": 1}
    got = {r.case: r.row_id for r in metrics.pick_cases(spark.createDataFrame(rows[:1], "row_id long, y int, pred int, score double")).collect()}
    assert got == {"TP": 0, "FN": None}


def test_split_sizes(spark):
    rows = spark.range(1567).select(F.col("id").alias("row_id"), (F.col("id") < 104).cast("int").alias("y"))
    got = {(r.part, r.y): r["count"] for r in split.stratified_split(rows).groupBy("part", "y").count().collect()}
    assert got == {("train", 1): 83, ("train", 0): 1170, ("test", 1): 21, ("test", 0): 293}
    quick = split.stratified_sample(rows, 200)
    assert quick.count() == 200 and quick.where("y = 1").count() == 13
    assert split.stratified_sample(rows, 5000).count() == 1567
    folds = {r.fold: r["count"] for r in split.stratified_folds(rows, 10).groupBy("fold").count().collect()}
    assert max(folds.values()) - min(folds.values()) <= 2 and len(folds) == 10
    plain = split.stratified_split(rows, stratify=False)
    assert plain.where("part = 'test'").count() == 314
    with pytest.raises(ValueError):
        split.background_sample(rows, 0)


def test_files(spark, tmp_path):
    (tmp_path / "x.data").write_text("1.5 NaN 3\nnan 2 NA\n7 8\n")
    (tmp_path / "y.data").write_text('-1 "19/07/2008 11:55:00"\n1 "31/02/2008 00:00:00"\n0 "20/07/2008 01:00:00"\n')
    rows = S.read_sensors(spark, str(tmp_path / "x.data"), str(tmp_path / "y.data"), 3).orderBy("row_id").collect()
    assert [(r.F001, r.F002, r.F003, r.y) for r in rows] == [(1.5, None, 3.0, 0), (None, 2.0, None, 1), (7.0, 8.0, None, None)]
    assert rows[0].ts is not None and rows[1].ts is None
    (tmp_path / "f.txt").write_text("1. F026\nnone\n2. F511\n")
    assert S.read_feature_list(spark, str(tmp_path / "f.txt")) == ["F026", "F511"]
    (tmp_path / "e.txt").write_text("none\n")
    with pytest.raises(ValueError):
        S.read_feature_list(spark, str(tmp_path / "e.txt"))
    with pytest.raises(FileNotFoundError):
        S.read_feature_list(spark, str(tmp_path / "no.txt"))
    (tmp_path / "b.json").write_text(json.dumps({"_note": "x", "m": {"AUC": 0.5, "f1": None}}, indent=4))
    got = {(r.model, r.metric): r.value for r in S.read_baseline(spark, str(tmp_path / "b.json")).collect()}
    assert got == {("m", "AUC"): 0.5, ("m", "f1"): None}
    assert S.read_feature_map(str(tmp_path / "no.yaml")) == {}
    (tmp_path / "c.yaml").write_text("F002: pressure\n")
    assert S.read_feature_map(str(tmp_path / "c.yaml")) == {"F002": "pressure"} == S.read_config(str(tmp_path / "c.yaml"))
    (tmp_path / ".env").write_text("KEY='v'\n#A=1\n")
    assert S.read_secrets(str(tmp_path / ".env"), ["KEY", "ABSENT_NAME_X"]) == {"KEY": "v", "ABSENT_NAME_X": None}
    assert S.resolved("a", "/r") == "/r/a" and S.resolved("/a", "/r") == "/a"
    with pytest.raises(FileNotFoundError):
        S.read_config(str(tmp_path / "none.yaml"))


def test_folders_pair_by_position(spark, tmp_path):
    for name, sizes in (("x", (1, 3, 2)), ("y", (1, 3, 2))):
        (tmp_path / name).mkdir()
        at = 0
        for f, n in zip("abc", sizes, strict=True):
            rows = [f"{at + i} {100 + at + i}" if name == "x" else f'{1 if (at + i) % 2 else -1} "19/07/2008 11:55:0{at + i}"' for i in range(n)]
            (tmp_path / name / f"{f}.data").write_text("\n".join(rows) + "\n")
            at += n
    rows = S.read_sensors(spark, str(tmp_path / "x"), str(tmp_path / "y"), 2).orderBy("row_id").collect()
    assert [(r.row_id, r.F001, r.F002, r.y, r.ts.second) for r in rows] == [(i, float(i), 100.0 + i, i % 2, i) for i in range(6)]
    big = "".join(f"{i} {'x' * 90}\n" for i in range(3000))
    (tmp_path / "big.txt").write_text(big)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = S.numbered(spark.read.text(str(tmp_path / "big.txt"))).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_id, r.value.split()[0]) for r in got] == [(i, str(i)) for i in range(3000)]


def test_anova_extremes(spark):
    x, y = matrix(60, 2)
    x[:, 1] = 0.1 + 3 * y
    x = np.column_stack([x, np.full(60, 7.3)])
    got = {r.feature: r.score for r in scoring.anova_f(long_of(spark, x, y)).collect()}
    a, b = x[y == 0, 0], x[y == 1, 0]
    between = len(a) * (a.mean() - x[:, 0].mean()) ** 2 + len(b) * (b.mean() - x[:, 0].mean()) ** 2
    inside = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert got["F001"] == pytest.approx(between / (inside / 58)) and got["F002"] == math.inf and got["F003"] is None
    ranks = {r.feature: r["rank"] for r in ranking.rank_descending(scoring.anova_f(long_of(spark, x, y))).collect()}
    assert ranks == {"F002": 1.0, "F001": 2.0, "F003": 3.0}


def test_streamed_files(spark, tmp_path):
    from quartzmill.streaming import stream_features

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.data").write_text("1 NaN\n2 3\n")
    q = stream_features(spark, str(tmp_path / "in"), 2).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.F001, r.F002) for r in spark.table("arrived").collect()) == [(1.0, None), (2.0, 3.0)]


def long_of(spark, x, y):
    rows = [(i, int(y[i]), j, f"F{j + 1:03d}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "row_id long, y int, fidx int, feature string, value double")


def matrix(n=150, m=8, seed=42):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    return rng.normal(size=(n, m)) + 0.8 * y[:, None] * (np.arange(m) < 5), y


def test_preprocess(spark):
    x, y = matrix(40, 3)
    x[:5, 0], x[:, 2] = np.nan, np.nan
    out = preprocess.preprocess(long_of(spark, x, y)).collect()
    assert {r.feature for r in out} == {"F001", "F002"}
    v = np.where(np.isnan(x[:, 0]), np.nanmedian(x[:, 0]), x[:, 0])
    want = (v - v.mean()) / v.std()
    assert all(r.value == pytest.approx(want[r.row_id]) for r in out if r.feature == "F001")
    assert profile.all_null_features(long_of(spark, x, y)).first().feature == "F003"
    with pytest.raises(ValueError):
        preprocess.impute_statistics(long_of(spark, x, y), "mode")
    x[:, 1], x[3, 1] = 0.1, np.nan
    for strategy in ("median", "mean"):
        out = preprocess.preprocess(long_of(spark, x, y), strategy=strategy).collect()
        assert all(abs(r.value) < 1e-12 for r in out if r.feature == "F002")


def test_models_and_attributions(spark):
    x, y = matrix()
    names = [f"F{j + 1:03d}" for j in range(8)]
    rows = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(len(x))], ["row_id", "y", "features"])
    rows = rows.withColumn("y", F.col("y").cast("int")).cache()
    background = rows.where("row_id < 40")
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = models.fit("ridge", rows)
    xc = x - (w[:, None] * x).sum(0) / w.sum()
    t = 2.0 * y - 1
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + np.eye(8), (xc * w[:, None]).T @ (t - (w * t).sum() / w.sum()))
    assert np.allclose(ridge.coefficients.toArray(), beta, atol=1e-8)
    for name in ("ridge", "logistic", "random_forest"):
        model = models.fit(name, rows)
        scored = models.score(model, rows.where("row_id < 20"))
        phi, base, method = X.explain(model, rows.where("row_id < 20"), background, names)
        assert method == {"ridge": "linear", "logistic": "linear", "random_forest": "tree"}[name]
        check = X.self_consistency(phi, base, scored.select("row_id", F.col("margin").alias("output")), method)
        assert check.count() == 20 and check.where("not consistency_ok").count() == 0
        assert phi.count() == 160 and phi.where("abs(phi) > 0").count() > 0
        if name != "ridge":
            assert scored.where("score < 0 or score > 1").count() == 0
    with pytest.raises(KeyError, match="ridge"):
        models.fit_function("none")
    assert models.active_models("all") == ["logistic", "random_forest", "ridge"]
    ranks = {r.feature: r["rank"] for r in scoring.rfe_ranks(rows, names, 5).collect()}
    assert sorted(ranks.values()) == [1.0] * 5 + [2.0, 3.0, 4.0]


def test_any_other_model_by_coalitions(spark):
    from pyspark.ml.classification import LinearSVC, NaiveBayes

    x, y = matrix(120, 5)
    names = [f"F{j + 1:03d}" for j in range(5)]
    rows = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(len(x))], ["row_id", "y", "features"])
    rows = rows.withColumn("y", F.col("y").cast("int"))
    model = NaiveBayes(modelType="gaussian", labelCol="y").fit(rows)
    assert models.kind(model) == "kernel" and models.score_label(model) == models.SCORE_LABELS["probability"]
    phi, base, method = X.explain(model, rows.where("row_id < 8"), rows.where("row_id < 30"), names)
    outputs = models.score(model, rows).select("row_id", F.col("margin").alias("output"))
    check = X.self_consistency(phi, base, outputs, method)
    assert method == "kernel" and check.count() == 8 and check.where("not consistency_ok").count() == 0
    # the same by coalitions in numpy, the model written out
    theta, sigma, pi = model.theta.toArray(), model.sigma.toArray(), model.pi.toArray()

    def predict(a):
        e = pi - 0.5 * (np.log(2 * np.pi * sigma)[None] + (a[:, None] - theta[None]) ** 2 / sigma[None]).sum(axis=2)
        return 1 / (1 + np.exp(e[:, 0] - e[:, 1]))

    _, want = X.kernel_shap_values(predict, x[:30], x[:8])
    got = np.zeros((8, 5))
    for r in phi.collect():
        got[r.row_id, r.fidx] = r.phi
    assert np.allclose(got, want, atol=1e-6)
    svm = LinearSVC(labelCol="y", maxIter=5).fit(rows)
    assert models.kind(svm) == "linear" and models.score_label(svm) == models.SCORE_LABELS["margin"]


def test_forest_that_cannot_be_read_goes_by_coalitions(spark, monkeypatch):
    x, y = matrix(80, 3)
    rows = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(len(x))], ["row_id", "y", "features"]).withColumn("y", F.col("y").cast("int"))
    model = models.forest(1, 5, 3).fit(profile.with_class_weight(rows))
    monkeypatch.setattr(X, "tree_shap", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    phi, _, method = X.explain(model, rows.where("row_id < 2"), rows.where("row_id < 20"), ["a", "b", "c"])
    assert method == "kernel" and phi.count() == 6


def test_elimination_and_importance_against_numpy(spark):
    x, y = matrix(160, 6)
    x[:, 2] *= 3
    names = [f"F{j + 1:03d}" for j in range(6)]
    rows = scoring.vectors(long_of(spark, x, y), names)
    assert scoring.vector_names(rows) == names
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def coefficients(a):
        v = np.zeros(a.shape[1] + 1)
        d = np.column_stack([a, np.ones(len(a))])
        ridge = np.r_[np.ones(a.shape[1]), 0.0]
        for _ in range(50):
            p = 1 / (1 + np.exp(-d @ v))
            v -= np.linalg.solve((d * (w * p * (1 - p))[:, None]).T @ d + np.diag(ridge), d.T @ (w * (p - y)) + ridge * v)
        return v

    model = models.fit("logistic", rows)
    v = coefficients(x)
    assert np.allclose(model.coefficients.toArray(), v[:-1], atol=1e-4) and model.intercept == pytest.approx(v[-1], abs=1e-4)
    left, want = list(range(6)), {}
    while len(left) > 2:
        c = coefficients(x[:, left])[:-1] ** 2
        gone = left.pop(int(c.argmin()))
        want[gone] = len(left)
    ranks = {r.fidx: r["rank"] for r in scoring.rfe_ranks(rows, names, 2).collect()}
    assert ranks == {f: 1.0 for f in left} | {f: float(n) for f, n in want.items()}
    scores = {r.fidx: r.score for r in scoring.forest_importance(rows, names, trees=20, depth=5).collect()}
    assert sum(scores.values()) == pytest.approx(1.0) and all(s >= 0 for s in scores.values()) and scores[5] < max(scores.values())


def test_tree_shapley_against_all_coalitions():
    rng = np.random.default_rng(1)
    leaves = [(rng.random(), [(int(f), -math.inf if rng.random() < 0.5 else -0.3, math.inf if rng.random() < 0.5 else 0.5, rng.random()) for f in rng.choice(4, 3, replace=False)]) for _ in range(6)]
    x = rng.normal(size=(5, 4))
    base, phi = X.tree_shap_values(leaves, x)

    def value(row, s):
        return sum(v * math.prod(float(lo < row[f] <= hi) if f in s else z for f, lo, hi, z in path) for v, path in leaves)

    import itertools

    for r, row in enumerate(x):
        for f in range(4):
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value(row, {*s, f}) - value(row, set(s))) for k in range(4) for s in itertools.combinations([g for g in range(4) if g != f], k))
            assert phi[r, f] == pytest.approx(want)
    assert base == pytest.approx(value(x[0], set()))


def test_kernel_shapley():
    rng = np.random.default_rng(2)
    beta, bg, x = rng.normal(size=6), rng.normal(size=(20, 6)), rng.normal(size=(3, 6))
    base, phi = X.kernel_shap_values(lambda a: a @ beta, bg, x)
    assert np.allclose(phi, beta * (x - bg.mean(0))) and base == pytest.approx(float((bg @ beta).mean()))
    wide = np.random.default_rng(3)
    beta, bg, x = wide.normal(size=14), wide.normal(size=(10, 14)), wide.normal(size=(2, 14))
    base, phi = X.kernel_shap_values(lambda a: a @ beta, bg, x)
    assert np.allclose(phi.sum(1) + base, x @ beta)
    with pytest.raises(ValueError):
        X.validate(["a"], ["a", "b"], None, 1)
    with pytest.raises(ValueError):
        X.validate(["a", "b"], ["a", "b"], ["b", "a"], 1)
    with pytest.raises(ValueError):
        X.validate(["a"], ["a"], ["a"], 0)


def test_mutual_information_with_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 120)
    x = np.column_stack([np.round(rng.normal(size=120) + 3 * y, 1), rng.normal(size=120)])
    got = {r.feature: r.score for r in scoring.knn_mutual_info(long_of(spark, x, y)).collect()}
    assert got["F001"] > 0.3 > got["F002"] >= 0


def brute_mutual_info(v, y, k=3):
    """Ross 2014 by all pairs."""
    from math import fsum

    psi = lambda n: -0.5772156649015329 + fsum(1.0 / i for i in range(1, int(n)))
    keep = np.array([(y == c).sum() > 1 for c in y])
    v, y = v[keep], y[keep]
    terms = []
    for i in range(len(v)):
        own = np.sort(np.abs(np.delete(v, i)[np.delete(y, i) == y[i]] - v[i]))
        kc = min(k, len(own))
        r = own[kc - 1]
        m = max(1, int(((v > v[i] - r) & (v < v[i] + r)).sum()))
        terms.append(psi(kc) - psi(len(own) + 1) - psi(m))
    return psi(len(v)) + fsum(terms) / len(terms)


def test_mutual_information_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    n = 1500
    y = rng.choice([0, 1, 2], n, p=[0.6, 0.395, 0.005])
    y[0] = 3  # a class of one row
    spread = rng.normal(size=n) + y
    hot = np.where(rng.random(n) < 0.5, 0.0, np.round(rng.normal(size=n), 2))
    outlier = np.r_[1e12, rng.exponential(size=n - 1)]
    x = np.column_stack([spread, hot, outlier])
    got = {r.feature: r.raw for r in scoring.knn_mutual_info(long_of(spark, x, y)).collect()}
    assert got == {f"F{j + 1:03d}": pytest.approx(brute_mutual_info(x[:, j], y), abs=1e-9) for j in range(3)}
    assert scoring.knn_mutual_info(long_of(spark, x, y).limit(0)).count() == 0


def test_mutual_information_in_wide_ranges(spark, monkeypatch):
    """Ranges of many values, so that most distances are settled within one, beside ranges that hold few of a class; nothing but the result stays."""
    monkeypatch.setattr(scoring.ranges, "RANGES", 8)
    rng = np.random.default_rng(15)
    n = 700
    y = rng.choice([0, 1, 2], n, p=[0.7, 0.29, 0.01])
    y[y == 2] = np.where(np.arange((y == 2).sum()) < 3, 2, 0)  # a class of three rows has two neighbours at most
    x = np.column_stack([rng.normal(size=n) + y, np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.4, 0.0, rng.lognormal(sigma=6, size=n))])
    for k in (1, 3, 5):
        found = scoring.knn_mutual_info(long_of(spark, x, y), k)
        assert {r.feature: r.raw for r in found.collect()} == {f"F{j + 1:03d}": pytest.approx(brute_mutual_info(x[:, j], y, k), abs=1e-9) for j in range(3)}
    assert not [p for p in os.listdir(folder(spark).removeprefix("file://")) if p.startswith("neighbours-")]


def test_ranges_by_steps_and_by_expression(spark):
    rng = np.random.default_rng(16)
    rows = spark.createDataFrame([("a", float(v)) for v in np.r_[np.round(rng.normal(size=900), 2), -1e300, 1e300]], "feature string, value double")
    cuts = ranges.cut_points(rows, ["feature"], "value")
    both = ranges.with_range(rows.join(cuts, "feature"), "cuts", "value", "b").withColumn("same", F.col("b") == ranges.range_of(F.col("cuts"), F.col("value")))
    assert both.where("same").count() == 902 and both.agg(F.min("b"), F.max("b")).first() == (0, ranges.RANGES - 1)


def test_selection_is_computed_once(spark):
    """The rank table of a selection is read from what was stored: taking the chosen features and then the ranks does not score twice."""
    rng = np.random.default_rng(17)
    y = rng.integers(0, 2, 60)
    cfg = R.configured({"feature_selection": {"n_features_to_select": 2, "methods": ["f_test", "mutual_info"]}})
    chosen, fused = R.select_features(long_of(spark, rng.normal(size=(60, 3)) + y[:, None] * [2, 1, 0], y), cfg, True)
    plan = fused._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert [r.feature for r in fused.orderBy("mean_rank", "fidx").collect()][:2] == chosen


def test_median_of_skewed_columns(spark):
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 400, 3001):
        x = np.column_stack([rng.lognormal(sigma=4, size=n), np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)), np.sort(rng.normal(size=n))[::-1]])
        got = {r.feature: r.statistic for r in preprocess.impute_statistics(long_of(spark, x, np.zeros(n, int))).collect()}
        assert got == {f"F{j + 1:03d}": pytest.approx(float(np.median(x[:, j]))) for j in range(3)}
    assert preprocess.impute_statistics(long_of(spark, x, np.zeros(n, int)).limit(0)).count() == 0


def test_auc_with_an_outlier(spark):
    rng = np.random.default_rng(10)
    y, s = rng.integers(0, 2, 900), np.round(rng.normal(size=900), 2)
    s[0] = 1e300
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    d = s[y == 1][:, None] - s[y == 0][None, :]
    assert metrics.auc(df).first().auc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


def test_elimination_on_the_driver_and_by_spark(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 7))
    y = (x[:, 1] - 2 * x[:, 4] + 0.5 * x[:, 6] + rng.normal(size=80) > 0.5).astype(int)
    names = [f"F{j + 1:03d}" for j in range(7)]
    rows = scoring.vectors(long_of(spark, x, y), names)
    ranks = lambda **how: {r.feature: r["rank"] for r in scoring.rfe_ranks(rows, names, 2, **how).collect()}
    assert ranks() == ranks(local_cells=0)
    assert ranks(step=2) == ranks(step=2, local_cells=0)
    alone = scoring.vectors(long_of(spark, x, np.zeros(80, int)), names)
    assert sorted(r["rank"] for r in scoring.rfe_ranks(alone, names, 6).collect()) == [1.0] * 6 + [2.0]


def test_ranking_edges(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 1, float("nan")), ("c", 2, 1.0), ("d", 3, None)], "feature string, fidx int, score double")
    assert {r.feature: r["rank"] for r in ranking.rank_descending(df).collect()} == {"a": 1.0, "b": 4.0, "c": 2.0, "d": 4.0}
    with pytest.raises(ValueError):
        ranking.fuse({})


def wide_rows(spark, n=200):
    x, y = matrix(n, 6)
    return spark.createDataFrame([(i, int(y[i]), *map(float, r), None) for i, r in enumerate(x)], "row_id long, y int, " + ", ".join(f"F{j + 1:03d} double" for j in range(7)))


def test_case_states_and_records(spark, tmp_path, monkeypatch):
    x, y = matrix(120, 4)
    names = [f"F{j + 1:03d}" for j in range(4)]
    rows = scoring.vectors(long_of(spark, x, y), names)
    train, test = rows.where("row_id < 80").cache(), rows.where("row_id >= 80").cache()
    model = models.fit("ridge", train)
    cfg = R.configured({"explain": {"background_size": 20, "required": False}})
    good = R.explain_stage({"ridge": model}, "ridge", train, test, names, cfg, str(tmp_path), "t")
    assert good["status"] == "ok" and good["shap_method"] == "linear" and good["output_space"] == "decision margin" and good["background_size"] == 20
    done = [c for c in good["cases"].values() if c["status"] == "generated"]
    assert done
    for c in done:
        assert set(c["record"]) == {"wafer_id", "case", "shap_method", "output_space", "y_true", "y_pred", "score", "score_label", "baseline", "explained_output", "reconstruction", "consistency_ok", "shap_values"}
        text = (tmp_path / c["report"]).read_text(encoding="utf-8")
        assert "displayed score [决策分数(>0 判失效)]" in text and "true state: fail" in text and "pushing" in text and "protecting" in text
    entry = json.loads((tmp_path / "shap_values_岭分类器.json").read_text(encoding="utf-8"))["features"]["F001"]
    assert set(entry) == {"mean_abs_shap", "std_abs_shap", "rank"}
    with pytest.raises(ValueError):
        R.explain_global(model, test, names[::-1], "m", None, train.limit(5))
    with pytest.raises(ValueError):
        R.explain_global(model, test, names[:3], "m", None, train.limit(5))
    monkeypatch.setattr(X, "case_record", lambda *_: (_ for _ in ()).throw(ValueError("broken")))
    bad = R.explain_stage({"ridge": model}, "ridge", train, test, names, cfg, str(tmp_path), "t")
    assert bad["status"] == "failed" and bad["error"] == "broken" and "failed" in {c["status"] for c in bad["cases"].values()}
    off = R.explain_stage({}, "ridge", None, None, [], R.configured({"explain": {"enabled": False}}), str(tmp_path), "t")
    assert off["enabled"] is False and off["reason"]


def test_command_line(spark, tmp_path, capsys):
    from quartzmill.__main__ import main

    x, y = matrix(120, 4)
    (tmp_path / "x.data").write_text("".join(" ".join(f"{v:.6f}" for v in r) + "\n" for r in x))
    (tmp_path / "y.data").write_text("".join(f'{1 if v else -1} "19/07/2008 11:55:00"\n' for v in y))
    (tmp_path / "base.json").write_text(json.dumps({"岭分类器": {"AUC": 9.0}}))
    (tmp_path / "c.yaml").write_text(f"feature_selection: {{methods: [f_test], n_features_to_select: 2}}\nmodel: {{active: ridge}}\nexplain: {{enabled: false}}\nreproducibility: {{baseline_path: {tmp_path}/base.json}}\n")
    paths = ["--features", str(tmp_path / "x.data"), "--labels", str(tmp_path / "y.data"), "--n-features", "4", "--config", str(tmp_path / "c.yaml")]
    assert main([*paths, "--quick"], spark) == 0
    assert main(paths, spark) == 1
    shown = capsys.readouterr().out
    assert "best model by test BER: ridge" in shown and "differs" in shown


def test_full_run(spark, tmp_path):
    cfg = {"feature_selection": {"n_features_to_select": 3, "methods": ["f_test", "mutual_info"]}, "model": {"active": "ridge"}, "explain": {"background_size": 20}, "output": {"results_dir": str(tmp_path)}}
    out = R.run(spark, wide_rows(spark), cfg)
    assert out["dropped_columns"] == ["F007"] and len(out["selected_features"]) == 3 and out["best_model"] == "ridge"
    assert out["explain"]["status"] == "ok" and all(c.get("consistency_ok", True) for c in out["explain"]["cases"].values())
    assert json.loads((tmp_path / "shap_manifest.json").read_text(encoding="utf-8"))["status"] == "ok"
    values = json.loads((tmp_path / "shap_values_岭分类器.json").read_text(encoding="utf-8"))
    assert len(values["features"]) == 3 and values["shap_method"] == "linear"
    written = next(tmp_path.glob("metrics_*.json"))
    again = R.run(spark, wide_rows(spark), cfg | {"reproducibility": {"baseline_path": str(written)}, "preprocessing": {"fit_on_train_only": False}, "explain": {"enabled": False}})
    assert len(again["baseline_report"]) == 7 and all(r["ok"] and r["diff"] == 0 for r in again["baseline_report"])
    assert again["baseline_ok"] is True and again["explain"]["status"] == "disabled" and sinks.exit_code(again["baseline_ok"]) == 0
    assert sinks.summary({"m": {"AUC": None, "f1": 0.5}}) == ["m: AUC=N/A, f1=0.500"]


def test_quick_run_and_failing_explanation(spark):
    cfg = {"feature_selection": {"n_features_to_select": 2, "methods": ["f_test", "rfe"]}, "model": {"active": "logistic"}, "run": {"quick_sample_size": 100}, "preprocessing": {"fit_on_train_only": True}}
    out = R.run(spark, wide_rows(spark), cfg, quick=True)
    assert out["explain"] is None and out["baseline_ok"] is None and len(out["selected_features"]) == 2
    bad = R.configured({"explain": {"background_size": 0}})
    with pytest.raises(RuntimeError):
        R.explain_stage({}, "ridge", None, None, [], bad, None, "t")
    bad["explain"]["required"] = False
    assert R.explain_stage({}, "ridge", None, None, [], bad, None, "t")["status"] == "failed"

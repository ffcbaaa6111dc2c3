"""Trees, coalitions, elimination, importance, medians, charts and the selection against plain references."""

import itertools
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quartzmill.operators import charts, elimination, kernel, models, preprocess, profile, ranking, scoring, trees
from quartzmill.operators import explain as X
from quartzmill.plans import run as R
from quartzmill.sources import sensor_files as S

from .test_operators import brute_mutual_info, long_of, matrix


def vector_rows(spark, x, y):
    rows = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(len(x))], ["row_id", "y", "features"])
    return rows.withColumn("y", F.col("y").cast("int"))


def shapley(value, m):
    """By all coalitions: ``value`` of a frozenset of features."""
    known = {s: value(s) for k in range(m + 1) for s in map(frozenset, itertools.combinations(range(m), k))}
    phi = np.zeros(m)
    for s, v in known.items():
        for f in set(range(m)) - s:
            phi[f] += math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (known[s | {f}] - v)
    return phi


# -- trees -----------------------------------------------------------------------


def test_fitted_forest_against_all_coalitions(spark, monkeypatch):
    x, y = matrix(150, 4, seed=3)
    rows = vector_rows(spark, x, y)
    model = models.forest(5, trees=7, depth=6).fit(profile.with_class_weight(rows))
    nodes = trees.node_table(model)
    by_tree = {t: nodes[nodes["treeID"] == t] for t in np.unique(nodes["treeID"])}

    def seen(tree, i, row, known):
        n = tree[i]
        if n["left"] < 0:
            return n["share"]
        if n["feature"] in known:
            return seen(tree, n["left"] if row[n["feature"]] <= n["cut"] else n["right"], row, known)
        return sum(tree[c]["cover"] / n["cover"] * seen(tree, c, row, known) for c in (n["left"], n["right"]))

    mean = lambda row, s: np.mean([seen(t, 0, row, s) for t in by_tree.values()])
    base, phi = trees.tree_shap(model, rows.where("row_id < 6"), ["a", "b", "c", "d"])
    got = np.zeros((6, 4))
    for r in phi.collect():
        got[r.row_id, r.fidx] = r.phi
    want = np.array([shapley(lambda s, row=row: mean(row, s), 4) for row in x[:6]])
    assert np.allclose(got, want, atol=1e-12) and base == pytest.approx(mean(x[0], frozenset()))
    assert sum(map(len, trees.open_paths(nodes))) == sum((t["left"] < 0).sum() for t in by_tree.values()) - ((nodes["left"] < 0) & (nodes["share"] == 0)).sum()
    monkeypatch.setattr(trees, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(trees, "TREES_AT_ONCE", 2)
    monkeypatch.setattr(trees, "slices", lambda groups, most=2000, own=trees.slices: own(groups, most))
    _, parts = trees.tree_shap(model, rows.where("row_id < 6"), ["a", "b", "c", "d"])
    again = np.zeros((6, 4))
    for r in parts.collect():
        again[r.row_id, r.fidx] = r.phi
    assert np.allclose(again, want, atol=1e-12)


def test_long_paths_and_empty_covers():
    rng = np.random.default_rng(2)
    leaves = []
    for _ in range(300):
        d = int(rng.integers(1, 12))
        leaves.append((rng.normal(), [(int(f), -math.inf if rng.random() < 0.5 else -0.5, math.inf if rng.random() < 0.5 else 0.4, 0.0 if rng.random() < 0.03 else rng.random()) for f in rng.choice(12, d, replace=False)]))
    leaves += [(0.0, [(0, -1.0, 1.0, 0.5)]), (0.7, [])]
    x = rng.normal(size=(4, 12))
    x[0, 3] = np.nan
    base, phi = X.tree_shap_values(leaves, x)

    def one(row, path):
        """One leaf by the polynomial's coefficients, a feature at a time."""
        out = np.zeros(12)
        for i, (f, lo, hi, z) in enumerate(path):
            poly = np.array([1.0])
            for j, (g, a, b, r) in enumerate(path):
                if j != i:
                    poly = np.convolve(poly, [r, float(a < row[g] <= b)])
            d = len(path)
            out[f] += (float(lo < row[f] <= hi) - z) * sum(c * math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s, c in enumerate(poly))
        return out

    want = np.array([sum(v * one(row, path) for v, path in leaves) for row in x])
    assert np.allclose(phi, want, atol=1e-9)
    assert base == pytest.approx(sum(v * math.prod(p[3] for p in path) for v, path in leaves))


# -- coalitions ---------------------------------------------------------------------------


def bumpy(a):
    return np.tanh(a[:, 0] * a[:, 1]) + np.where(a[:, 2] > 0, a[:, 3], -a[:, 4]) + 0.5 * a[:, 5] * a[:, 6] * a[:, 7] + a[:, 8:].max(axis=1)


def test_sampled_coalitions_against_exact_ones():
    rng = np.random.default_rng(4)
    background, x = rng.normal(size=(5, 14)), rng.normal(size=(3, 14))
    base, phi, error = kernel.estimate(bumpy, background, x, seed=1)
    cells = np.array(list(itertools.product([False, True], repeat=14)))
    for r in range(3):
        v = bumpy(np.where(cells[:, None, :], x[r], background[None]).reshape(-1, 14)).reshape(len(cells), -1).mean(axis=1)
        table = {frozenset(np.flatnonzero(c)): value for c, value in zip(cells, v, strict=True)}
        want = shapley(table.__getitem__, 14)
        assert (np.abs(phi[r] - want) <= 5 * error[r] + 1e-12).all() and np.abs(phi[r] - want).max() > 0
        assert error[r].max() <= kernel.ERROR * max(1.0, abs(bumpy(x[r : r + 1])[0]))
        assert phi[r].sum() + base == pytest.approx(bumpy(x[r : r + 1])[0])
    few, exact, none = kernel.estimate(lambda a: a[:, 0] * a[:, 1], background[:, :3], x[:, :3])
    assert (none == 0).all()
    assert kernel.stretches(14, 5000) == [(0, 2048), (2048, 2048), (4096, 4096)]
    assert (kernel.sample(14, 4096, 3)[:2048] == kernel.drawn(14, 2048, 3, 0)).all()
    masks = kernel.drawn(20, 2048, 0, 0)
    assert (masks[::2] == ~masks[1::2]).all()


def test_any_model_beyond_the_exact_sum(spark, monkeypatch):
    from pyspark.ml.classification import NaiveBayes

    x, y = matrix(60, 13, seed=7)
    rows = vector_rows(spark, x, y)
    names = [f"n{i}" for i in range(13)]
    model = NaiveBayes(modelType="gaussian", labelCol="y").fit(rows)
    theta, sigma, pi = model.theta.toArray(), model.sigma.toArray(), model.pi.toArray()

    def predict(a):
        e = pi - 0.5 * (np.log(2 * np.pi * sigma)[None] + (a[:, None] - theta[None]) ** 2 / sigma[None]).sum(axis=2)
        return 1 / (1 + np.exp(e[:, 0] - e[:, 1]))

    monkeypatch.setattr(kernel, "ERROR", 0.004)
    base, phi = X.model_shap(model, rows.where("row_id < 3"), rows.where("row_id >= 54"), names, 2)
    _, want, error = kernel.estimate(predict, x[54:], x[:3], 2)
    got, errors = np.zeros((3, 13)), np.zeros((3, 13))
    for r in phi.collect():
        got[r.row_id, r.fidx], errors[r.row_id, r.fidx] = r.phi, r.error
    assert np.allclose(got, want, atol=1e-6) and np.allclose(errors, error, atol=1e-6) and 0 < errors.max() <= 0.004


def test_swapped_columns_fail_in_each_branch(spark):
    x, y = matrix(60, 3)
    names = ["F001", "F002", "F003"]
    rows = scoring.vectors(long_of(spark, x, y), names)
    swapped = scoring.vectors(long_of(spark, x, y), names[::-1])
    short = vector_rows(spark, x[:, :2], y)
    from pyspark.ml.classification import NaiveBayes

    fitted = [models.fit("ridge", rows), models.fit("random_forest", rows), NaiveBayes(modelType="gaussian", labelCol="y").fit(rows)]
    for model, kind in zip(fitted, ("linear", "tree", "kernel"), strict=True):
        assert models.kind(model) == kind
        for a, b in ((swapped, rows), (rows, swapped)):
            with pytest.raises(ValueError):
                X.explain(model, a, b, names)
        with pytest.raises(ValueError):
            X.explain(model, rows, rows, names[:2])
    plan = X.long_of(short, names)
    with pytest.raises(Exception, match="3 feature names for a vector of 2"):
        plan.collect()
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=["b", "a"], outputCol="features").transform(spark.createDataFrame([(0, 1.0, 2.0)], "row_id long, a double, b double"))
    assert X.column_names(assembled) == ["b", "a"]
    with pytest.raises(ValueError):
        X.long_of(assembled, ["a", "b"])


# -- elimination and importance -------------------------------------------------------------


def newton(x, y, w):
    d, free = np.c_[x, np.ones(len(x))], np.r_[np.ones(x.shape[1]), 0.0]
    v = np.zeros(d.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-d @ v))
        step = np.linalg.solve((d * (w * p * (1 - p))[:, None]).T @ d + np.diag(free), d.T @ (w * (p - y)) + free * v)
        v -= step
        if np.abs(step).max() < 1e-13:
            break
    return v


def plain_elimination(x, y, w, keep):
    left, out = list(range(x.shape[1])), []
    while len(left) > keep:
        squares = newton(x[:, left], y, w)[:-1] ** 2
        out.append([left.pop(int(np.flatnonzero(squares <= squares.min() * (1 + 1e-6))[0]))])
    return [*out, left]


@pytest.mark.parametrize("seed", range(5))
def test_elimination_against_newton_fits(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(60, 300)), int(rng.integers(5, 50))
    x = rng.normal(size=(n, m)) * rng.lognormal(size=m)
    x = np.c_[x, x[:, 3], x[:, 1]]  # two exact ties
    y = (x[:, :3] @ rng.normal(size=3) + 2 * rng.normal(size=n) > 0).astype(float)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    rows = elimination.LocalRows(x, y, w)
    assert elimination.eliminate(rows, m + 2, 3) == plain_elimination(x, y, w, 3)


def test_elimination_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(elimination, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(elimination, "SUMS", 2)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 9))
    x[:, 8] = x[:, 0] + 1e-9 * rng.normal(size=150)  # nearly a tie
    y = (x[:, 1] - 2 * x[:, 4] + rng.normal(size=150) > 0.5).astype(int)
    names = [f"F{j + 1:03d}" for j in range(9)]
    rows = scoring.vectors(long_of(spark, x, y), names).repartition(5)
    ranks = lambda **how: {r.feature: r["rank"] for r in scoring.rfe_ranks(rows, names, 2, **how).collect()}
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = plain_elimination(x, y.astype(float), w, 2)
    assert ranks() == ranks(local_cells=0) == {names[f]: float(r) for r, g in enumerate(reversed(want), 1) for f in g}
    assert ranks(step=3) == ranks(step=3, local_cells=0)


def plain_tree(x, y, w, depth):
    """Gains of an exact tree by the best Gini split of each node, by feature; midpoints between different values.
    A split whose children are leaves of one class is taken back, as Spark does."""

    def weights(k):
        return np.array([w[k & (y == c)].sum() for c in (0, 1)])

    def gini(k):
        p = weights(k)
        return 1 - ((p / p.sum()) ** 2).sum()

    def grow(k, level):
        """Gains below, and the class if it is a leaf."""
        best, total, gains = (1e-12, None, None), w[k].sum(), np.zeros(x.shape[1])
        for f in range(x.shape[1]) if level else ():
            values = np.unique(x[k, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left, right = k & (x[:, f] <= cut), k & (x[:, f] > cut)
                gain = gini(k) - sum(w[s].sum() / total * gini(s) for s in (left, right))
                if gain > best[0] + 1e-12:
                    best = (gain, f, cut)
        if best[1] is None:
            return gains, int(weights(k).argmax())
        sides = [grow(k & s, level - 1) for s in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2])]
        if sides[0][1] is not None and sides[0][1] == sides[1][1]:
            return gains, sides[0][1]
        gains[best[1]] += best[0] * total
        return gains + sides[0][0] + sides[1][0], None

    gains, _ = grow(np.ones(len(y), bool), depth)
    return gains / gains.sum()


def test_importance_of_an_exact_tree(spark):
    rng = np.random.default_rng(21)
    x = np.stack([rng.integers(0, k, 200) * 1.0 for k in (7, 11, 23, 40)], axis=1)
    y = ((x[:, 0] > 3) & (x[:, 2] > 8) | (x[:, 3] > 33) | (rng.random(200) < 0.1)).astype(int)
    names = ["F001", "F002", "F003", "F004"]
    rows = scoring.vectors(long_of(spark, x, y), names)
    got = [r.score for r in scoring.forest_importance(rows, names, trees=1, depth=3, drawn=False).orderBy("fidx").collect()]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    assert got == pytest.approx(plain_tree(x, y, w, 3).tolist(), abs=1e-9)


# -- medians ----------------------------------------------------------------------------------


def test_narrowed_medians(spark):
    rng = np.random.default_rng(30)
    n = 6001
    x = np.column_stack([rng.normal(size=n), rng.lognormal(sigma=5, size=n), np.where(rng.random(n) < 0.5, 1.0, 2.0), np.round(rng.normal(size=n), 1), np.full(n, 3.5), np.r_[np.zeros(n // 2), rng.normal(size=n - n // 2)]])
    long = long_of(spark, x, np.zeros(n, int)).repartition(3).cache()
    for most in (3, 40, 1 << 16):
        got = {r.feature: r.statistic for r in preprocess.impute_statistics(long, most=most).collect()}
        assert got == {f"F{j + 1:03d}": pytest.approx(float(np.median(x[:, j])), abs=0) for j in range(6)}
    even = long.where("row_id < 6000")
    got = {r.feature: r.statistic for r in preprocess.impute_statistics(even, most=5).collect()}
    assert got == {f"F{j + 1:03d}": pytest.approx(float(np.median(x[:6000, j])), abs=1e-15) for j in range(6)}
    brackets = long.groupBy("feature").agg(*preprocess._bracket())
    held = preprocess.narrowed(long, brackets, 10).join(long, "feature").where("value between lo and hi").groupBy("feature").agg(F.count_distinct("value").alias("d"))
    assert held.agg(F.max("d")).first()[0] <= 20


# -- charts, manifest, selection -----------------------------------------------------------------


def pixels(data):
    """A PNG file without filters, read back."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunk)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", chunk[:8])
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 3 * width)
    assert (lines[:, 0] == 0).all()
    return lines[:, 1:].reshape(height, width, 3)


def test_charts():
    shown = pixels(charts.bars([("F001", 0.8, "red"), ("F002", -0.4, "blue"), ("Fé", 0.0, "red")], "title (x=1)", "axis"))
    width = lambda i, c: int((shown[charts.TOP + charts.ROW * i + charts.ROW // 2] == charts.COLOURS[c]).all(axis=1).sum())
    assert abs(width(0, "red") - 2 * width(1, "blue")) <= 3 and width(2, "red") == 0 and width(1, "red") == 0
    assert (shown[:, :, 0] == 0).sum() > 300  # letters
    assert pixels(charts.bars([], "none", "axis")).shape == (charts.TOP + charts.BOTTOM, charts.WIDTH, 3)
    assert all(len(g) == 5 and set(g) <= set("01234567") for g in charts.GLYPHS.values())


def test_explanation_files_and_manifest(spark, tmp_path):
    x, y = matrix(120, 4)
    names = [f"F{j + 1:03d}" for j in range(4)]
    rows = scoring.vectors(long_of(spark, x, y), names)
    train, test = rows.where("row_id < 80").cache(), rows.where("row_id >= 80").cache()
    cfg = R.configured({"explain": {"background_size": 20}})
    found = R.explain_stage({"ridge": models.fit("ridge", train)}, "ridge", train, test, names, cfg, str(tmp_path), "t")
    kept = json.loads((tmp_path / "shap_manifest.json").read_text(encoding="utf-8"))
    chart = pixels((tmp_path / kept["global"]["png"]).read_bytes())
    rows_of = lambda img: (img.shape[0] - charts.TOP - charts.BOTTOM) // charts.ROW
    assert rows_of(chart) == 4 and (chart == charts.COLOURS["steel"]).all(axis=2).any()
    done = {k: c for k, c in kept["cases"].items() if c["status"] == "generated"}
    assert done
    for case, c in done.items():
        assert (tmp_path / c["report"]).is_file() and c["plot"] == f"shap_contribution_wafer_{c['wafer_id']}_{case}.png"
        drawn = pixels((tmp_path / c["plot"]).read_bytes())
        values = found["cases"][case]["record"]["shap_values"].values()
        assert rows_of(drawn) == 4
        assert (drawn == charts.COLOURS["red"]).all(axis=2).any() == any(v > 0 for v in values)
        assert (drawn == charts.COLOURS["blue"]).all(axis=2).any() == any(v < 0 for v in values)
    row = R.manifest_frame(spark, [found]).first()
    assert row.status == "ok" and row["global"].png == kept["global"]["png"] and {k: v.status for k, v in row.cases.items()} == {k: v["status"] for k, v in kept["cases"].items()}


def test_selection_by_all_methods(spark):
    rng = np.random.default_rng(40)
    y = (rng.random(200) < 0.3).astype(int)
    x = rng.normal(size=(200, 7)) + np.outer(y, [0, 1.5, 0.2, 0, 0.8, 0, 0.4])
    names = [f"F{j + 1:03d}" for j in range(7)]
    cfg = R.configured({"feature_selection": {"n_features_to_select": 3}})
    chosen, fused = R.select_features(long_of(spark, x, y), cfg, False)
    got = {r.feature: r for r in fused.collect()}
    place = lambda s: np.argsort(np.argsort(-np.array(s), kind="stable"), kind="stable") + 1.0
    a, b = x[y == 0], x[y == 1]
    f = [((len(a) * (a[:, j].mean() - x[:, j].mean()) ** 2 + len(b) * (b[:, j].mean() - x[:, j].mean()) ** 2)) / ((a[:, j].var() * len(a) + b[:, j].var() * len(b)) / 198) for j in range(7)]
    mi = [max(0.0, brute_mutual_info(x[:, j], y)) for j in range(7)]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    rfe = {i: float(r) for r, g in enumerate(reversed(plain_elimination(x, y.astype(float), w, 3)), 1) for i in g}
    wide = scoring.vectors(long_of(spark, x, y), names)
    forest = {r.fidx: r["rank"] for r in ranking.rank_descending(scoring.forest_importance(wide, names, 42)).collect()}
    ranks = np.stack([place(f), place(mi), [rfe[j] for j in range(7)], [forest[j] for j in range(7)]])
    for j, n in enumerate(names):
        r = got[n]
        assert (r.rank_f_test, r.rank_mutual_info, r.rank_rfe, r.rank_random_forest) == tuple(ranks[:, j])
        assert r.mean_rank == pytest.approx(ranks[:, j].mean())
    assert chosen == [names[j] for j in np.argsort(ranks.mean(axis=0), kind="stable")[:3]]
    with pytest.raises(KeyError):
        R.select_features(long_of(spark, x, y), R.configured({"feature_selection": {"methods": ["none"]}}), False)


def test_small_files_on_other_file_systems(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1. F026\nnone\n2. F511\n")
    (tmp_path / "c.yaml").write_text("F002: pressure\n")
    root = f"file://{tmp_path}"
    assert S.read_feature_list(spark, f"{root}/f.txt") == ["F026", "F511"]
    assert S.read_feature_map(f"{root}/c.yaml") == {"F002": "pressure"} == S.read_config(f"{root}/c.yaml")
    assert S.read_feature_map(f"{root}/no.yaml") == {}
    for read in (S.read_config, lambda p: S.read_feature_list(spark, p)):
        with pytest.raises(FileNotFoundError):
            read(f"{root}/no.txt")

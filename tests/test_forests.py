"""Forests: large and small nodes alike, scores and files; attributions along trees against leaves by themselves."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quartzmill.operators import forests, models, profile, trees


def fitted(spark, n=300, m=6, seed=4, **how):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, m))
    x[:, 1] = rng.integers(0, 5, n)
    y = ((x[:, 0] + x[:, 1] > 2) ^ (rng.random(n) < 0.2)).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(n)], ["row_id", "y", "features"])
    return x, y, rows, models.forest(9, trees=4, **how).fit(profile.with_class_weight(rows))


def test_large_nodes_give_the_same_forest(spark, monkeypatch):
    x, y, rows, model = fitted(spark)
    monkeypatch.setattr(forests, "NODE_ROWS", 50)
    again = fitted(spark)[3]
    for a, b in zip(model.trees, again.trees, strict=True):
        names = lambda t, i=0: [(t[i]["feature"], t[i]["bin"], t[i]["n0"], t[i]["n1"])] + ([] if t[i]["left"] < 0 else names(t, t[i]["left"]) + names(t, t[i]["left"] + 1))
        assert names(a) == names(b) and len(a) > 20
    assert np.allclose(model.gains, again.gains) and np.allclose(model.positive(x), again.positive(x), atol=0)


def test_scores_and_saved_form(spark, tmp_path):
    x, y, rows, model = fitted(spark)
    got = {r.row_id: r.score for r in models.score(model, rows).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(model.positive(x).tolist()) and ((model.positive(x) > 0.5) == y).mean() > 0.9
    model.write().overwrite().save(f"file://{tmp_path}/m")
    back = forests.Forest.load(f"file://{tmp_path}/m")
    assert np.array_equal(back.positive(x), model.positive(x)) and np.array_equal(back.featureImportances, model.featureImportances)


def test_all_deep_levels_cost_one_pass(spark, monkeypatch):
    """A deep forest of as many nodes as rows is grown from one read of the rows."""
    passes = []
    monkeypatch.setattr(forests, "_large_splits", lambda *_: passes.append(1))
    nodes = fitted(spark, n=500)[3].table()
    assert not passes and len(nodes) > 200


def test_along_trees_against_leaves(spark):
    x, _, _, model = fitted(spark, n=600, m=12)
    nodes = model.table()
    every, leaves = trees.tree_list(nodes), trees.open_paths(nodes)
    assert trees.expected(every) == pytest.approx(trees.base_value(leaves), abs=1e-12)
    got = trees.forest_values(every, x[:50])
    assert np.allclose(got, trees.shap_values(leaves, x[:50]), atol=1e-12)
    assert np.allclose(got.sum(axis=1) + trees.expected(every), model.positive(x[:50]), atol=1e-12)


def test_paths_pass_in_pieces_between_leaves_that_add(spark):
    """Splits beside leaves of value zero cost no pass of their own: pieces go with the leaves that add to the output, not with the nodes."""
    x, _, _, model = fitted(spark, n=2000, m=12)
    every = trees.tree_list(model.table())
    for tree, nodes in zip(every, model.trees, strict=True):
        leaves = int((tree.value != 0).sum())
        assert leaves == ((nodes["left"] < 0) & (nodes["n1"] > 0)).sum() and len(tree.after) < 0.8 * len(nodes)
        many = np.array([tree.after[i] - i for i in range(len(tree.after))])
        assert (tree.value[many == 1] != 0).all() and (tree.value[many > 1] == 0).all()
    want = trees.shap_values(trees.open_paths(model.table()), x[:700])
    assert np.allclose(trees.forest_values(every, x[:700]), want, atol=1e-12)


def test_bits_blocks_and_rules_change_nothing(spark, monkeypatch):
    x, _, _, model = fitted(spark, n=900, m=5)
    nodes = model.table()
    want = trees.forest_values(trees.tree_list(nodes), x)
    for bits, rows, together, points in ((2, 100, 0, (1, 2, 8)), (8, 7, 5, (3, 15)), (3, 4096, 1000, (15,))):
        for name, value in (("BITS", bits), ("ROWS", rows), ("TOGETHER", together), ("POINTS", points)):
            monkeypatch.setattr(trees, name, value)
        assert np.allclose(trees.forest_values(trees.tree_list(nodes), x), want, atol=1e-12)


def test_paths_of_more_than_thirty_features():
    """A path of 40 features, as deep trees on wide data have; its leaf was left out before."""
    m = 40
    form = [("treeID", "i4"), ("id", "i4"), ("left", "i4"), ("right", "i4"), ("feature", "i4"), ("cut", "f8"), ("cover", "f8"), ("share", "f8")]
    nodes = np.zeros(2 * m + 1, form)
    nodes["id"], nodes["left"], nodes["right"], nodes["feature"] = np.arange(2 * m + 1), -1, -1, -1
    for d in range(m):
        i = 0 if d == 0 else 2 * d
        nodes[i] = (0, i, 2 * d + 1, 2 * d + 2, d, 0.0, 0.97**d, 0.0)
        nodes[2 * d + 1]["cover"] = 0.03 * 0.97**d
    nodes[2 * m]["cover"], nodes[2 * m]["share"] = 0.97**m, 1.0
    x = np.where(np.arange(3 * m).reshape(3, m) % 7 == 0, -1.0, 1.0)
    x[2] = 1.0
    every = trees.tree_list(nodes.view(np.recarray))
    got = trees.forest_values(every, x)
    assert np.allclose(got, trees.shap_values(trees.open_paths(nodes), x), atol=1e-12)
    assert trees.expected(every) == pytest.approx(0.97**m) and got[2].sum() == pytest.approx(1 - 0.97**m)

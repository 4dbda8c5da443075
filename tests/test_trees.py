"""Histogram trees against brute force and against what pruning and model leaves must do."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.base import get_algorithm
from millrace.operators import trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (600, 3)).astype(float)
    y = np.where(x[:, 0] < 7, "a", np.where(x[:, 1] < 12, "b", "c"))
    flip = rng.random(600) < 0.1
    y[flip] = rng.choice(["a", "b", "c"], flip.sum())
    v = np.where(x[:, 0] < 10, 3 * x[:, 1] + x[:, 2], 50 - 4 * x[:, 1]) + rng.normal(0, 0.5, 600)
    pdf = pd.DataFrame(x, columns=["x0", "x1", "x2"]).assign(y=y, v=v)
    return pdf, spark.createDataFrame(pdf).cache()


def entropy(y):
    p = pd.Series(y).value_counts(normalize=True)
    return float(-(p * np.log2(p)).sum())


def test_root_split_is_the_best_of_all(table):
    pdf, df = table
    m = trees.ReducedErrorPruningTreeClassifier(no_pruning=True, max_depth=1, max_bins=100).fit(df, "y", ["x0", "x1", "x2"])
    gains = {}
    for c in ("x0", "x1", "x2"):
        for t in sorted(pdf[c].unique())[1:]:
            left, right = pdf.y[pdf[c] < t], pdf.y[pdf[c] >= t]
            gains[c, t] = entropy(pdf.y) - (len(left) * entropy(left) + len(right) * entropy(right)) / len(pdf)
    c, t = max(gains, key=gains.get)
    assert (m.features[m.tree.feature[0]], m.tree.threshold[0]) == (c, t)
    n = sorted(float(s.sum()) for s in m.tree.stats[1:])
    assert n == sorted([float((pdf[c] < t).sum()), float((pdf[c] >= t).sum())])


def test_c45_prunes_noise_and_walks_like_python(table):
    pdf, df = table
    full = trees.C45TreeClassifier(unpruned=True).fit(df, "y", ["x0", "x1", "x2"])
    m = trees.C45TreeClassifier().fit(df, "y", ["x0", "x1", "x2"])
    assert 3 <= len(m.tree.leaves) < len(full.tree.leaves)
    got = m.predict(df).toPandas()
    assert (got.prediction == pdf.y).mean() > 0.88
    t = m.tree
    for r in got.head(50).itertuples():
        n = 0
        while t.feature[n] >= 0:
            n = t.left[n] if (r.x0, r.x1, r.x2)[t.feature[n]] < t.threshold[n] else t.right[n]
        assert m.classes[int(t.stats[n].argmax())] == r.prediction
        assert math.isclose(sum(r.probability.values()), 1.0)
    assert "x0 <" in m.describe()


def test_reduced_error_pruning_shrinks(table):
    _, df = table
    for name, label in (("ReducedErrorPruningTreeClassifier", "y"), ("ReducedErrorPruningTreeRegressor", "v")):
        full = get_algorithm(name)(no_pruning=True).fit(df, label, ["x0", "x1", "x2"])
        m = get_algorithm(name)().fit(df, label, ["x0", "x1", "x2"])
        assert len(m.tree.leaves) < len(full.tree.leaves)
    assert m.predict(df).select(F.corr("prediction", "v")).first()[0] > 0.95


def test_model_tree_fits_pieces(table):
    _, df = table
    m = get_algorithm("M5ModelTreeRegressor")().fit(df, "v", ["x0", "x1", "x2"])
    wrong = m.predict(df).select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("v"), 2)))).first()[0]
    assert wrong < 1.5 and len(m.tree.leaves) < 40
    plain = get_algorithm("M5ModelTreeRegressor")(build_regression_tree=True).fit(df, "v", ["x0", "x1", "x2"])
    assert plain.predict(df).select(F.corr("prediction", "v")).first()[0] > 0.95


def test_missing_values_empty_and_constant_tables(spark, table):
    _, df = table
    holes = df.withColumn("x0", F.when(F.rand(1) < 0.2, None).otherwise(F.col("x0")))
    m = trees.C45TreeClassifier().fit(holes, "y", ["x0", "x1", "x2"])
    out = m.predict(holes)
    assert out.where("prediction is null").count() == 0 and out.where("prediction = y").count() > 420
    for name, label in (("C45TreeClassifier", "y"), ("C45TreeRegressor", "v"), ("M5ModelTreeRegressor", "v")):
        same = get_algorithm(name)().fit(df.withColumn("y", F.lit("a")).withColumn("v", F.lit(2.0)), label, ["x0", "x1"])
        assert [r[0] for r in same.predict(df).select("prediction").distinct().collect()] in (["a"], [2.0])
        none = get_algorithm(name)().fit(df.limit(0), label, ["x0", "x1"])
        assert none.predict(df.limit(3)).count() == 3


def test_complexity_pruning_and_upper_errors(table):
    _, df = table
    m = trees.C45TreeClassifier(unpruned=True).fit(df, "y", ["x0", "x1", "x2"])
    sizes = []
    for alpha in (0.0, 3.0, 1e9):
        m.tree.prune_by_complexity(alpha, m._errors)
        sizes.append(len(m.tree.leaves))
    assert sizes[0] > sizes[1] > sizes[2] == 1
    assert trees.upper_errors(0, 1) == pytest.approx(0.75) and trees.upper_errors(2, 10) > 2


@pytest.mark.parametrize("name,label", [("C45TreeClassifier", "y"), ("C45TreeRegressor", "v"), ("M5ModelTreeRegressor", "v")])
def test_levels_scored_in_either_place_agree(table, monkeypatch, name, label):
    _, df = table
    df = df.withColumn("x1", F.when(F.col("x2") == 3, None).otherwise(F.col("x1")))
    make = lambda: get_algorithm(name)(max_depth=3).fit(df, label, ["x0", "x1", "x2"]).tree
    here = make()
    monkeypatch.setattr(trees, "SMALL", 0)
    there = make()
    assert (here.feature, here.threshold, here.missing) == (there.feature, there.threshold, there.missing)
    assert np.allclose(np.array(here.stats), np.array(there.stats))

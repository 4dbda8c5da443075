import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import base
from millrace.functions import metrics as M
from millrace.operators import neighbors as N
from millrace.operators import tree_tools as T
from millrace.operators.associations import AprioriAssociator
from millrace.plans import validation as V
from millrace.plans import workflow as W
from millrace.plans.splitting import KFold, ranked, rising
from millrace.sources import bundled, files, generators


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, z=np.where(x[:, 2] > 1, 2, y), t=3 * np.sin(x[:, 0]) + x[:, 1] ** 2, row_id=range(1200))
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf


def brute_split(X, y, cost):
    best = (-1, 0.0, 0.0)
    for j in range(X.shape[1]):
        v = np.unique(X[:, j])
        for t in (v[1:] + v[:-1]) / 2:
            low = X[:, j] <= t
            gain = cost(y) - cost(y[low]) - cost(y[~low])
            if gain > best[2] + 1e-9:
                best = (j, t, gain)
    return best


def test_exact_splits_against_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(5):
        X, y = rng.integers(0, 12, (60, 3)).astype(float), rng.integers(0, 3, 60)
        for criterion in ("gini", "entropy"):
            j, t, g = T.best_split_classifier(X, y, criterion, 3)
            want = brute_split(X, y, lambda v, c=criterion: T.classifier_node_impurity(v, c, 3) * len(v))
            assert g * 60 == pytest.approx(want[2])
        v = X[:, 1] * 2 + rng.normal(size=60)
        for criterion in ("squared_error", "absolute_error"):
            j, t, g = T.best_split_regressor(X, v, criterion)
            want = brute_split(X, v, lambda a, c=criterion: T.regressor_node_impurity(a, c) * len(a))
            assert (j, t) == want[:2] and g * 60 == pytest.approx(want[2])
    j, t, low, high = T.best_split_stump(np.array([[0.0], [1], [2], [3]]), [0, 0, 1, 1])
    assert (j, t, low.tolist(), high.tolist()) == (0, 1.5, [2, 0], [0, 2])
    assert T.gain_ratio_score(1.0, [0, 0], [2, 2], 4) == 1 and T.compute_max_features("sqrt", 9) == 3 and T.compute_max_features(0.5, 9) == 4


def test_trees_flat_and_as_expression(points):
    df, pdf = points
    X, z = pdf[list("abcd")].to_numpy(), pdf["z"].to_numpy()
    full = T.build_classifier_tree(X, z, T.TreeConfig())
    flat = T.flatten_tree(full)
    assert (T.predict_batch(flat, X) == z).all() and len(flat.feature) == T.count_nodes(full)
    assert [T.predict_single_numpy(full, x) for x in X[:50]] == T.predict_batch(flat, X[:50]).tolist()
    small = T.build_regressor_tree(X, pdf["t"].to_numpy(), T.TreeConfig(max_depth=3, min_samples_leaf=5))
    assert T.max_depth_of(small) == 3
    flat = T.flatten_tree(small)
    odd = df.withColumn("a", F.when(F.col("row_id") % 7 != 0, F.col("a")))
    got = odd.select("row_id", T.tree_column(flat, list("abcd")).alias("p")).toPandas().sort_values("row_id")["p"]
    X2 = np.where((pdf["row_id"] % 7 == 0).to_numpy()[:, None] & (np.arange(4) == 0), np.nan, X)
    assert np.allclose(got, T.predict_batch(flat, X2))
    trees = T.fit_trees(df, "z", list("abcd"), "t", T.TreeConfig(max_depth=2)).collect()
    assert len(trees) == 3 and all(r["depth"] == 2 and r["nodes"] == 7 for r in trees)


def test_pruning(points):
    _, pdf = points
    rng = np.random.default_rng(2)
    X, y = pdf[list("abcd")].to_numpy(), pdf["y"].to_numpy()
    noisy = np.where(rng.random(len(y)) < 0.2, 1 - y, y)
    for prune in (lambda k: T.cost_complexity_prune(k, 0.01), lambda k: T.reduced_error_prune_classifier(k, X[800:], y[800:]), lambda k: T.pessimistic_prune(k, X[:800], noisy[:800], 0.1)):
        root = T.build_classifier_tree(X[:800], noisy[:800], T.TreeConfig())
        before, flat = T.count_nodes(root), T.flatten_tree(root)
        wrong = (T.predict_batch(flat, X[800:]) != y[800:]).mean()
        prune(root)
        assert T.count_nodes(root) < before and (T.predict_batch(T.flatten_tree(root), X[800:]) != y[800:]).mean() <= wrong
    v = pdf["t"].to_numpy() + rng.normal(size=len(y))
    root = T.build_regressor_tree(X[:800], v[:800], T.TreeConfig())
    before = T.count_nodes(root)
    assert T.count_nodes(T.reduced_error_prune_regressor(root, X[800:], v[800:])) < before
    assert "<=" in T.get_tree_description(root, task="value", names=list("abcd"))


def test_sequential_learners(points):
    df, pdf = points
    for name, label, least in (("PerceptronClassifier", "y", 0.97), ("AveragedPerceptronClassifier", "z", 0.9), ("VotedPerceptronClassifier", "y", 0.97)):
        m = base.resolve(name, **({"max_iter": 20} if name.startswith("Perc") else {})).fit(df, label, list("abcd"))
        assert M.accuracy_score(m.predict(df), label, "prediction") >= least, name
    for name, kw, least in (("MultilayerPerceptronRegressor", {"max_epochs": 30}, 0.85), ("AdaBoostRegressor", {"n_estimators": 4}, 0.7)):
        m = base.resolve(name, **kw).fit(df, "t", list("abcd"))
        assert M.r2_score(m.predict(df), "t", "prediction") >= least, name
    with pytest.raises(ValueError):
        base.resolve("DecisionTreeClassifier", max_depth=40).fit(df, "y", list("abcd"))


def test_ranks_in_buckets(spark):
    df = spark.createDataFrame([(i * 7919 % 5000, i % 3) for i in range(5000)], "row_id long, k int")
    got = ranked(df, [F.col("row_id")], rising(df, "row_id"), "k").toPandas().sort_values(["k", "row_id"])
    assert all((g["_rank"] == range(len(g))).all() and (g["_n"] == len(g)).all() for _, g in got.groupby("k"))
    names = df.select(F.format_string("n%05d", "row_id").alias("row_id"))
    sizes = KFold(7).folds(names).groupBy("fold").agg(F.count("*").alias("n"), F.min("row_id").alias("a")).orderBy("fold").collect()
    assert [r["n"] for r in sizes] == [715, 715, 714, 714, 714, 714, 714] and [r["a"] for r in sizes] == sorted(r["a"] for r in sizes)
    assert KFold(3).folds(df.limit(0)).count() == 0


def test_helpers(spark, points, tmp_path):
    df, pdf = points
    assert M.get_class_labels(df, "z") == [0, 1, 2] and M.get_num_classes(df, "y", "z") == 3 and M.is_binary(df, "y")
    assert M.weighted_sum(df, "a", "b") == pytest.approx((pdf["a"] * pdf["b"]).sum())
    with pytest.raises(ValueError):
        M.check_classification_targets(df, "y", "a")
    with pytest.raises(ValueError):
        M.check_consistent_length([1], [1, 2])
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "i long, v array<double>")
    for f, want in ((N.euclidean_pairwise, 5), (N.manhattan_pairwise, 7), (N.chebyshev_pairwise, 4), (N.minkowski_pairwise, 5)):
        assert f(v, None, "i", "v").first()["distance"] == pytest.approx(want)
    b = spark.createDataFrame([(["x", "y"],), (["x", "y"],), (["x"],)], "items array<string>")
    m = AprioriAssociator(0.5, 0.5).fit(b)
    assert m.top_itemsets(1)[0].items == ("x",) and {r.antecedent for r in m.top_rules()} == {("x",), ("y",)}
    data = generators.Friedman(50).data(spark)
    assert data.target_name == "y" and len(data.feature_names) == 10 and data.X.count() == 50 and isinstance(generators.Blobs(), generators.ClusteringGenerator)
    assert len(W.execute_read_data(df, 3, condition="y = 1")) == 3 and W.execute_data_profile(df, "y")["shape"] == (1200, 8)
    r = V.run_experiment({"nb": "NaiveBayesClassifier", "zero": "ZeroRuleClassifier"}, {"d": (df, "y")}, 2, ["accuracy"]).datasets()["d"]
    assert r.best("accuracy") == "nb" and len(r.models["nb"].folds) == 2
    path = tmp_path / "iris.arff"
    path.write_text("@relation iris\n@attribute a numeric\n@attribute class {u,v}\n@data\n1,u\n2,v\n")
    assert [tuple(x) for x in bundled.load_iris(spark, str(tmp_path)).frame.collect()] == [(1.0, 0.0), (2.0, 1.0)]
    a = files.read_arff(spark, str(path))
    assert a.nominal == {"class": ["u", "v"]} and [x["class"] for x in a.frame.collect()] == ["u", "v"]
    with pytest.raises(FileNotFoundError):
        bundled.load_glass(spark)

    class Mine(base.Params, base.Registrable):
        component_type = base.ComponentType.FILTER

    assert "Mine" in base.registry.list("filter")

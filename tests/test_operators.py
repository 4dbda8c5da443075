import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.base import list_algorithms, registry, resolve
from millrace.functions import metrics as M
from millrace.functions import stats as S
from millrace.functions import text as T
from millrace.operators import associations, clustering, features, learners, neighbors, sampling, timeseries  # noqa: F401
from millrace.operators import preprocessing as P
from millrace.plans import splitting, validation, workflow
from millrace.sources import files, generators


@pytest.fixture(scope="module")
def two(spark):
    return generators.Blobs(300, 3, 2, 1.0, [[0, 0, 0], [5, 5, 5]], random_state=1).generate(spark).cache()


@pytest.fixture(scope="module")
def line(spark):
    x = generators.Friedman(400, 5, noise=0.1, random_state=2).generate(spark)
    return x.withColumn("y", 3 * F.col("f0") - 2 * F.col("f1") + 1).cache()


CLASSIFIERS = ["NaiveBayesClassifier", "BayesianNetworkClassifier", "OneRuleClassifier", "LogisticRegression", "SGDClassifier", "PerceptronClassifier", "DecisionTreeClassifier", "DecisionStumpClassifier", "C45TreeClassifier", "RandomTreeClassifier", "SVC", "MultilayerPerceptronClassifier"]


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifier_separates(two, name):
    out = resolve(name).fit(two, "y", ["f0", "f1", "f2"]).predict(two)
    assert M.accuracy_score(out, "y", "prediction") > 0.95


@pytest.mark.parametrize("name,kw", [("RandomForestClassifier", {"n_estimators": 5}), ("XGBoostClassifier", {"n_estimators": 3}), ("BaggingClassifier", {"n_estimators": 2}), ("AdaBoostClassifier", {"n_estimators": 3}), ("RandomSubspaceClassifier", {"n_estimators": 2}), ("VotingClassifier", {}), ("StackingClassifier", {"num_folds": 2}), ("MultiClassClassifier", {}), ("FilteredClassifier", {})])
def test_ensemble_separates(two, name, kw):
    out = resolve(name, **kw).fit(two, "y", ["f0", "f1", "f2"]).predict(two)
    assert M.accuracy_score(out, "y", "prediction") > 0.95


@pytest.mark.parametrize("name,kw,least", [("LinearRegression", {}, 0.999), ("SimpleLinearRegression", {}, 0.4), ("BayesianLinearRegressor", {"alpha": 1e-3}, 0.99), ("SGDRegressor", {}, 0.99), ("DecisionTreeRegressor", {}, 0.8), ("RandomForestRegressor", {"n_estimators": 10, "max_features": None}, 0.8), ("AdditiveRegression", {"n_estimators": 3}, 0.5), ("SVR", {"kernel": "linear"}, 0.9), ("RegressionByDiscretization", {}, 0.6), ("VotingRegressor", {}, 0.8), ("M5ModelTreeRegressor", {}, 0.8)])
def test_regressor_fits(line, name, kw, least):
    out = resolve(name, **kw).fit(line, "y", ["f0", "f1", "f2"]).predict(line)
    assert M.r2_score(out, "y", "prediction") > least


@pytest.mark.parametrize("name,kw", [("KMeansClusterer", {"n_init": 1}), ("GaussianMixtureClusterer", {}), ("FarthestFirstClusterer", {}), ("AgglomerativeClusterer", {}), ("FilteredClusterer", {}), ("DBSCANClusterer", {"eps": 2.0})])
def test_clusterer_finds_blobs(two, name, kw):
    out = resolve(name, **kw).fit(two, None, ["f0", "f1", "f2"]).predict(two)
    assert M.adjusted_rand_score(out, "y", "prediction") > 0.9


def test_canopy_update(two):
    c = clustering.CanopyClusterer(t2=4.0).fit(two, None, ["f0", "f1", "f2"])
    n = len(c.centers)
    assert len(c.update(two.withColumn("f0", F.col("f0") + 100)).centers) > n


@pytest.mark.parametrize("name,kw", [("IsolationForestDetector", {"random_state": 1}), ("LocalOutlierFactorDetector", {}), ("EllipticEnvelopeDetector", {}), ("ABODDetector", {}), ("OneClassSVMDetector", {})])
def test_detector_ranks_far_row_first(spark, name, kw):
    x = generators.Blobs(120, 2, 1, 1.0, [[0, 0]], random_state=3).generate(spark).drop("y")
    x = x.unionByName(spark.createDataFrame([(9999, 40.0, 40.0)], "row_id long, f0 double, f1 double")).cache()
    d = resolve(name, **kw).fit(x, None, ["f0", "f1"])
    assert d.decision_function(x).orderBy(F.desc("score")).first()["row_id"] == 9999
    assert d.predict(x).where("row_id = 9999").first()["prediction"] == -1


def test_balancing(spark):
    x = generators.Blobs(400, 2, 2, 1.0, [[0, 0], [3, 3]], random_state=4).generate(spark).where("y = 0 or row_id % 8 = 1").cache()
    n = sampling.class_sizes(x, "y")
    for name in ("SMOTESampler", "ADASYNSampler"):
        got = sampling.class_sizes(resolve(name, random_state=1).fit(x, "y").transform(x), "y")
        assert got[0] == n[0] and abs(got[1] - n[0]) < 0.25 * n[0] or name == "ADASYNSampler" and got[1] > n[1]
    over = sampling.class_sizes(sampling.RandomOverSampler().fit(x, "y").transform(x), "y")
    assert abs(over[1] - over[0]) < 0.2 * over[0]
    under = sampling.class_sizes(sampling.RandomUnderSampler().fit(x, "y").transform(x), "y")
    assert under[0] < 2 * n[1]
    assert sampling.ReservoirSampler(17).fit(x).transform(x).count() == 17
    near = sampling.class_sizes(sampling.NearMissSampler().fit(x, "y").transform(x), "y")
    assert near[0] == near[1] == n[1]
    assert sampling.ENNSampler().fit(x, "y").transform(x).count() <= x.count()


def test_knn_imputer(spark):
    x = spark.createDataFrame([(i, float(i), float(2 * i) if i != 5 else None) for i in range(10)], "row_id long, a double, b double")
    out = neighbors.KNNImputer(2, id_col="row_id").fit(x).transform(x).where("row_id = 5").first()
    assert out["b"] == pytest.approx(10.0)


def test_mdl_and_pca_and_selection(two):
    cuts = P.MDLDiscretizer(columns=["f0"]).fit(two, "y").cuts["f0"]
    assert any(1 < c < 4 for c in cuts)
    p = features.PCAExtractor(2, columns=["f0", "f1", "f2"]).fit(two)
    assert p.explained_variance_ratio[0] > 0.8 and "pc0" in p.transform(two).columns
    noisy = two.withColumn("f3", F.rand(1))
    assert "f3" not in features.SelectKBestSelector(k=3).fit(noisy.drop("row_id"), "y").selected
    assert features.SelectFprSelector(alpha=1e-6).fit(noisy.drop("row_id"), "y").get_support() == ["f0", "f1", "f2"]
    assert features.CFSSelector(columns=["f0", "f1", "f3"]).fit(noisy, "y").selected
    s = features.SequentialFeatureSelector("NaiveBayesClassifier", 1, cv=2, columns=["f0", "f3"]).fit(noisy, "y")
    assert s.selected == ["f0"]


def test_missing_and_constant_columns(spark):
    x = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, None, 2.0)], "row_id int, a double, b double")
    out = P.StandardScaler(columns=["b"]).fit_transform(x).collect()
    assert [r["b"] for r in out] == [0.0] * 3
    assert [r["a"] for r in P.SimpleImputer(columns=["a"]).fit_transform(x).collect()] == [0.0] * 3
    assert P.EqualWidthDiscretizer(3, ["b"]).fit_transform(x).count() == 3
    assert P.StandardScaler(columns=["b"]).fit(x.limit(0)).transform(x.limit(0)).count() == 0


def test_text(spark):
    x = spark.createDataFrame([(1, "Dr. Who said: running <b>fast</b> isn't easy. It is!"), (2, "")], "id int, text string")
    assert x.select(T.SentenceTokenizer()("text").alias("s")).first()["s"] == ["Dr. Who said: running <b>fast</b> isn't easy.", "It is!"]
    assert x.select(T.NGramTokenizer(2)("text").alias("s")).first()["s"][0] == "dr who"
    assert "n't" in x.select(T.TreebankTokenizer()("text").alias("s")).first()["s"]
    assert T.TextCleaner(columns=["text"]).transform(x).first()["text"].startswith("dr. who said: running fast isn't")
    assert T.Stemmer(columns=["text"]).transform(x.withColumn("text", F.lit("running cats"))).first()["text"] == "runn cat"
    assert T.HashingVectorizer(n_features=64).fit(x, "text").transform(x, "id").count() > 5
    assert T.TextNormalizer(columns=["text"]).transform(x.withColumn("text", F.lit("ﬁX "))).first()["text"] == "fix"


def test_associations(spark):
    x = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],), (["a", "c"],), (["b"],), (["a", "b", "c"],)], "items array<string>")
    m = associations.ECLATAssociator(0.4, 0.6).fit(x)
    got = {tuple(r["items"]): r["count"] for r in m.itemsets.collect()}
    assert got[("a", "b")] == 3 and got[("a", "b", "c")] == 2
    rule = m.rules.where(F.col("antecedent") == F.array(F.lit("c"))).where(F.col("consequent") == F.array(F.lit("a"))).first()
    assert rule["confidence"] == 1.0 and rule["lift"] == pytest.approx(1.25)


def test_forecasters(spark):
    t = np.arange(60)
    x = spark.createDataFrame(pd.DataFrame({"s": 1, "t": t, "value": 10 + 0.5 * t + 3 * np.sin(2 * np.pi * t / 12)}))
    for name, kw in (("AR", {"order": 12}), ("ARIMA", {"order": (12, 1, 0)}), ("ExponentialSmoothing", {"trend": "add", "seasonal": "add", "seasonal_periods": 12}), ("STLDecomposition", {"period": 12}), ("Prophet", {"period": 12}), ("MA", {}), ("ARMA", {"order": (2, 1)})):
        got = resolve(name, **kw).fit(x, "value", "t", "s").forecast(6).toPandas().sort_values("step")["prediction"].to_numpy()
        assert len(got) == 6 and np.isfinite(got).all()
        if name in ("ARIMA", "STLDecomposition", "Prophet"):
            want = 10 + 0.5 * np.arange(60, 66) + 3 * np.sin(2 * np.pi * np.arange(60, 66) / 12)
            assert np.abs(got - want).mean() < 2.5, name
    d = timeseries.STLDecomposition(12).fit(x, "value", "t", "s").decompose().toPandas()
    assert np.allclose(d["trend"] + d["seasonal"] + d["resid"], 10 + 0.5 * d["t"] + 3 * np.sin(2 * np.pi * d["t"] / 12))


def test_statistics():
    assert S.t_sf2(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.f_sf(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert S.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    r = S.paired_t_test([0.9, 0.8, 0.95, 0.85], [0.7, 0.65, 0.7, 0.72])
    assert r.significance is S.SignificanceLevel.WIN
    p = [0.01, 0.04, 0.03, 0.005]
    assert S.holm_correction(p)[0].tolist() == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert S.benjamini_hochberg(p)[0].tolist() == pytest.approx([0.02, 0.04, 0.04, 0.02])
    assert S.hochberg_correction(p)[0].tolist() == pytest.approx([0.03, 0.04, 0.04, 0.02])
    assert all(S.hommel_correction(p)[0] <= S.hochberg_correction(p)[0] + 1e-12)
    res = np.array([[0.9, 0.8, 0.7], [0.91, 0.82, 0.75], [0.88, 0.8, 0.71], [0.9, 0.85, 0.6]])
    assert S.friedman_test(res)["average_ranks"].tolist() == [1, 2, 3]
    assert S.friedman_test(res)["statistic"] == pytest.approx(8.0)
    assert S.quade_test(res)["p_value"] < 0.05 and S.friedman_aligned_ranks_test(res)["p_value"] < 0.05
    assert S.nemenyi_post_hoc(res).different[0, 2]


def test_splitters(two):
    for s in (splitting.KFold(3), splitting.StratifiedKFold(3, True), splitting.HashKFold(3), splitting.ShuffleSplit(2), splitting.BootstrapSplit(2)):
        for train, test in s.split(two, "y"):
            assert train.join(test, "row_id").isEmpty() and not test.isEmpty()
    small = two.limit(4)
    assert sum(1 for _ in splitting.LeavePOut(2).split(small)) == 6
    a, b = splitting.train_test_split(two, 0.25, stratify="y")
    assert a.count() + b.count() == 300 and b.count() == 74


def test_validation_and_tuning(two):
    s = validation.cross_val_score("NaiveBayesClassifier", two, "y", features=["f0", "f1"], cv=3)
    assert len(s) == 3 and min(s) > 0.9
    g = validation.GridSearchCV("DecisionTreeClassifier", {"max_depth": [1, 3]}, cv=2).fit(two, "y", ["f0", "f1"])
    assert g.best_score > 0.9 and len(g.result.results) == 2
    b = validation.BayesianSearchCV("KNearestNeighborsClassifier", {"k": (1, 5)}, 3, n_random_starts=2, cv=2, random_state=1).fit(two, "y", ["f0"])
    assert 1 <= b.best_params["k"] <= 5
    e = validation.run_experiment({"nb": "NaiveBayesClassifier", "zero": "ZeroRuleClassifier"}, {"two": (two.drop("f2"), "y")}, 3, ["accuracy"])
    m = e.matrix("accuracy")
    assert m.cells["two", "nb"].mean > m.cells["two", "zero"].mean and "nb" in validation.to_markdown_table(m)


def test_workflow_and_persistence(spark, two, tmp_path):
    out = workflow.train("LogisticRegression", two, "y", preprocessing=["SimpleImputer", "StandardScaler"], cv=2)
    assert out.metrics["accuracy"] > 0.95 and out.predict(two).count() == 300
    workflow.save_model(out.model, str(tmp_path / "m"), {"note": "x"})
    again = workflow.load_model(str(tmp_path / "m"))
    scaled = out.pipeline[1].transform(out.pipeline[0].transform(two))
    assert again.predict(scaled).where("prediction = y").count() > 285
    assert workflow.load_model_info(str(tmp_path / "m"))["metadata"] == {"note": "x"}
    assert workflow.profile(two, "y")["rows"] == 300
    assert "LogisticRegression" in list_algorithms("classifier") and registry.search("forest")


def test_files(spark, tmp_path):
    arff = "@relation 'w'\n@attribute outlook {sunny, rainy}\n@attribute 'temp c' numeric\n@attribute play {yes, no}\n@data\nsunny, 85, no\n% c\nrainy, ?, yes\n{1 3.5, 2 no}\n"
    d = files.parse_arff_string(spark, arff)
    assert d.target == "play" and [tuple(r) for r in d.frame.collect()] == [(0.0, 85.0, 1.0), (1.0, None, 0.0), (0.0, 3.5, 1.0)]
    files.save_arff(str(tmp_path / "o.arff"), d.frame, d.labels)
    assert sorted(map(str, files.load(spark, str(tmp_path / "o.arff")).frame.collect())) == sorted(map(str, d.frame.collect()))
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x,y",u\nna,2,v\n')
    c = files.load(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in c.frame.orderBy("c").collect()] == [(1.0, None, 0.0), (None, 2.0, 1.0)] and c.labels["c"] == ["u", "v"]
    files.save(str(tmp_path / "b.parquet"), c.frame)
    assert files.load(spark, str(tmp_path / "b.parquet")).frame.count() == 2
    (tmp_path / "n.json").write_text('[{"id": 1, "items": [{"p": 1.5}, {"p": 2.5}]}]')
    assert files.load_json_nested(spark, str(tmp_path / "n.json"), "items", ["id"]).frame.count() == 2
    files.save_numpy(str(tmp_path / "z.npz"), c.frame.fillna(0.0), "c")
    assert files.load(spark, str(tmp_path / "z.npz")).frame.count() == 2


@pytest.mark.parametrize("name", ["Agrawal", "Hyperplane", "LED", "RandomRBF", "Blobs", "Circles", "Moons", "SwissRoll", "Friedman", "MexicanHat", "Sine"])
def test_generators(spark, name):
    g = getattr(generators, name)(200, random_state=1)
    df = g.generate(spark)
    assert df.count() == 200 and "y" in df.columns
    assert df.orderBy("row_id").limit(5).collect() == g.generate(spark).orderBy("row_id").limit(5).collect()


def test_streaming(spark, two, tmp_path):
    from millrace.streaming import incremental as I

    two.withColumn("y", F.col("y")).repartition(2).write.parquet(str(tmp_path / "in"))
    nb = learners.NaiveBayesMultinomialClassifier()
    src = spark.readStream.schema(two.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    src = src.withColumns({c: F.abs(c) for c in ("f0", "f1", "f2")})
    run = I.IncrementalLearner(nb, "y", ["f0", "f1", "f2"])
    q = run.start(src, str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(120)
    assert run.batches == 2 and sum(n for n, _ in nb.counts.values()) == 300
    ev = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:05:00", "a", 2.0), ("2024-01-01 02:00:00", "a", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert {r["n"] for r in I.windowed(ev, "ts", "k", "v").collect()} == {1, 2}
    assert I.sessions(ev, "ts", "k").count() == 2


def test_nearest_manhattan_reads_all_vectors(spark):
    from millrace.queries import QUERIES

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(e["embedding"].to_list()).astype(float)
    dist = np.stack([np.abs(x - row).sum(1) for row in x])
    np.fill_diagonal(dist, np.inf)
    got = QUERIES["nearest_manhattan"](spark, d).toPandas().set_index("query")
    assert len(got) == len(e) > 50
    assert np.allclose(got.loc[e["vec_id"], "distance"], dist.min(1), atol=1e-5)


def test_text_queries_read_all_documents(spark):
    from millrace.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    worded = {r[0] for r in docs.where(F.size(T.WordTokenizer()("text")) > 0).select("doc_id").collect()}
    assert {r[0] for r in QUERIES["tfidf_all"](spark, d).select("doc_id").distinct().collect()} == worded
    words = docs.select(F.size(T.WordTokenizer()("text")).alias("n"))
    pairs = words.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0)))).first()[0]
    assert QUERIES["bigrams_all"](spark, d).agg(F.sum("n")).first()[0] == pairs
    assert QUERIES["clean_text"](spark, d).count() == docs.count()


def test_vector_queries_use_all_components(spark, tmp_path):
    from millrace.queries import QUERIES

    rng = np.random.default_rng(5)
    label = np.arange(60) % 3
    x = np.zeros((60, 64))
    x[:, 10:] = rng.normal(size=(60, 54)) * 0.01 + label[:, None]
    spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["knn_classify"](spark, str(tmp_path)).toPandas()
    assert (got["prediction"] == got["vec_id"] % 3).all()
    assert QUERIES["silhouette"](spark, str(tmp_path)).agg(F.min("silhouette")).first()[0] > 0.9
    assert QUERIES["dbscan"](spark, str(tmp_path)).select("cluster").distinct().count() == 3


def test_no_silent_caps(spark, monkeypatch):
    v = T.CountVectorizer()
    assert v.max_vocabulary is None and T.CountVectorizer(max_features=2).fit(spark.createDataFrame([("a b c",)], "t string"), "t").vocabulary.count() == 2
    docs = spark.range(1, 4).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(400_000)), lambda i: F.concat(F.lit("w"), (i + 400_001 * F.col("id")).cast("string"))), " ").alias("t"))
    assert v.fit(docs, "t").vocabulary.count() == 1_200_003
    rows = spark.createDataFrame([("d", 1), ("b", 2), ("a", 3), ("c", 4), (None, 5), ("d", 6)], "c string, o int")
    monkeypatch.setattr(P.OrdinalEncoder, "max_categories", 2)
    first = P.OrdinalEncoder(columns=["c"], order_by="o").fit(rows).transform(rows.unionByName(spark.createDataFrame([("x", 7)], "c string, o int")))
    assert [r["c"] for r in first.orderBy("o").collect()] == [0, 1, 2, 3, None, 0, -1]
    assert [r["c"] for r in P.OrdinalEncoder(columns=["c"]).fit_transform(rows).orderBy("o").collect()] == [3, 1, 0, 2, None, 3]
    monkeypatch.setattr(files, "MAX_LABELS", 2)
    out = files.encode(rows, None)
    assert out.frame.columns == ["c", "o"] and [r["c"] for r in out.frame.orderBy("o").collect()] == [3, 1, 0, 2, None, 3]
    assert {r["_kept"]: r["_code"] for r in out.tables["c"].collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}

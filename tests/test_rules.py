import pytest
from pyspark.sql import functions as F

from millrace.base import resolve
from millrace.functions import estimators, kernels
from millrace.functions import metrics as M
from millrace.operators import rules, sampling
from millrace.sources import generators


@pytest.fixture(scope="module")
def two(spark):
    return generators.Blobs(300, 3, 2, 1.0, [[0, 0, 0], [5, 5, 5]], random_state=1).generate(spark).cache()


@pytest.mark.parametrize("name", ["PARTClassifier", "RIPPERClassifier", "LogisticModelTreeClassifier", "DecisionTableClassifier", "KStarClassifier", "HoeffdingTreeClassifier"])
def test_classifiers(two, name):
    # equal gains of all columns split only at the tie threshold
    m = resolve(name, **({"tie_threshold": 0.3} if name == "HoeffdingTreeClassifier" else {})).fit(two, "y", ["f0", "f1", "f2"])
    assert M.accuracy_score(m.predict(two), "y", "prediction") > 0.95
    if name == "HoeffdingTreeClassifier":
        before = len(m.leaves)
        assert before >= 2 and M.accuracy_score(m.partial_fit(two).predict(two), "y", "prediction") > 0.95
    if name == "PARTClassifier":
        assert "if " in repr(m.rules[0])


@pytest.mark.parametrize("name", ["M5ModelRulesRegressor", "LocallyWeightedLearningRegressor"])
def test_regressors(two, name):
    x = two.withColumn("y", 2 * F.col("f0") - F.col("f1"))
    out = resolve(name).fit(x, "y", ["f0", "f1"]).predict(x)
    assert out.count() == 300 and M.r2_score(out, "y", "prediction") > 0.95


def test_samplers(two):
    x = two.where("y = 0 or row_id % 6 = 1").cache()
    n = sampling.class_sizes(x, "y")
    for name in ("KMeansSMOTESampler", "SVMSMOTESampler", "ClusterOverSampler"):
        got = sampling.class_sizes(resolve(name, random_state=1).fit(x, "y").transform(x), "y")
        assert got[0] == n[0] and abs(got[1] - n[0]) < 0.3 * n[0], name
    got = sampling.class_sizes(resolve("HardnessThresholdSampler").fit(x, "y").transform(x), "y")
    assert got[0] == got[1] == n[1]
    assert 2 <= resolve("CNNSampler").fit(x, "y").transform(x).count() < x.count()


def test_relief(two):
    s = rules.relief_f(two.withColumn("noise", F.rand(2)), ["f0", "noise"], "y", 5)
    assert s["f0"] > 0.2 > s["noise"] + 0.1


def test_kernels(spark):
    x = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    k = lambda z: {(r["i"], r["j"]): r["k"] for r in z.gram(x, "id", "v").collect()}
    assert k(kernels.LinearKernel())[1, 2] == 11
    assert k(kernels.PolynomialKernel(2))[1, 2] == 144
    assert k(kernels.NormalizedPolynomialKernel())[1, 1] == pytest.approx(1)
    assert k(kernels.RBFKernel(0.5))[1, 2] == pytest.approx(2.718281828 ** -4)
    assert k(kernels.PearsonUniversalKernel())[1, 1] == 1
    assert -1 <= k(kernels.SigmoidKernel())[1, 2] <= 1
    s = spark.createDataFrame([(1, "science"), (2, "sconce")], "id int, v string")
    got = {(r["i"], r["j"]): r["k"] for r in kernels.StringKernel(2).gram(s, "id", "v").collect()}
    assert got[1, 1] == pytest.approx(1) and 0 < got[1, 2] < 1 and got[1, 2] == pytest.approx(got[2, 1])


def test_estimators_and_split(two):
    n = estimators.NormalEstimator().fit(two, "f0")
    k = estimators.KernelEstimator().fit(two, "f0")
    d = estimators.DiscreteEstimator().fit(two, "y")
    r = two.select(n.probability(F.lit(2.5)).alias("n"), k.probability(F.lit(0.0)).alias("k"), d.probability(F.lit(1)).alias("d")).first()
    assert r["n"] > 0 and r["k"] > 0.05 and r["d"] == pytest.approx((two.where("y = 1").count() + 1) / 302)
    s = estimators.best_split(two, "f0", "y")
    assert 1 < s["threshold"] < 4.5 and s["impurity"] < 0.05

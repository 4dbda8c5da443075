"""Classifiers and regressors: those fitted by aggregates, and those of pyspark.ml behind one interface."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Classifier, Regressor, classifier, clean, one_row, regressor, resolve
from .features import covariance

# ---------------------------------------------------------------- helpers


def classes_of(df: DataFrame, label: str, most: int = 10_000) -> list:
    got = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().limit(most + 1).collect())
    if len(got) > most:
        raise ValueError(f"{label} has more than {most} classes")
    return got


def argmax_class(scores: dict) -> Column:
    """The class with the greatest score; ties go to the first."""
    return F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]))["k"]


def _code(label: str, classes: list) -> Column:
    out = F.lit(None).cast("double")
    for i, k in enumerate(classes):
        out = F.when(F.col(label) == F.lit(k), F.lit(float(i))).otherwise(out)
    return out


def linear(features: list[str], weights, bias: float = 0.0, means=None) -> Column:
    """A linear form; missing values count as the mean."""
    e = F.lit(float(bias))
    for i, (c, w) in enumerate(zip(features, weights, strict=True)):
        e = e + F.coalesce(clean(c), F.lit(float(means[i]) if means is not None else 0.0)) * F.lit(float(w))
    return e


# ---------------------------------------------------------------- by aggregates


@classifier
class ZeroRuleClassifier(Classifier):
    """The most frequent class; of ties the smallest."""

    def fit(self, df, label=None, features=None):
        self.label = label
        self.majority = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()[0]
        return self

    def predict(self, df):
        return df.withColumn("prediction", F.lit(self.majority))


@classifier
class OneRuleClassifier(Classifier):
    """The one column whose equal-width bins predict best by their majority class."""

    defaults = {"min_bucket_size": 6, "n_bins": 10}

    def fit(self, df, label=None, features=None):
        from .preprocessing import EqualWidthDiscretizer

        self._names(df, label, features)
        self.binner = EqualWidthDiscretizer(self.n_bins, self.features).fit(df)
        b = self.binner.transform(df)
        best = (-1.0, None, {})
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(self.features)]))
        counts: dict = {}
        for r in b.select(F.col(label).alias("y"), cells.alias("x")).groupBy("x.i", "x.v", "y").count().collect():
            counts.setdefault(r["i"], {}).setdefault(r["v"], []).append((r["count"], r["y"]))
        for i, c in enumerate(self.features):
            rule, right = {}, 0
            for v, rows in counts.get(i, {}).items():
                n, k = max(rows, key=lambda t: (t[0], str(t[1])))
                right += n
                if v is not None and sum(x[0] for x in rows) >= self.min_bucket_size:
                    rule[v] = k
            if right > best[0]:
                best = (right, c, rule)
        self.column, self.rule = best[1], best[2]
        self.default = ZeroRuleClassifier().fit(df, label).majority
        return self

    def predict(self, df):
        bin_ = self.binner._apply(self.column, self.binner.stats[self.column])
        out = F.lit(self.default)
        for v, k in self.rule.items():
            out = F.when(bin_ == F.lit(v), F.lit(k)).otherwise(out)
        return df.withColumn("prediction", out)


@classifier
class NaiveBayesClassifier(Classifier):
    """Gaussian by class and column, from one aggregate; prior (n + 1) / (N + classes); missing values are left out."""

    defaults = {"use_kernel_estimator": False, "use_laplace": True}

    def fit(self, df, label=None, features=None):
        if self.use_kernel_estimator:
            raise ValueError("use_kernel_estimator: use functions.estimators.KernelEstimator of each class")
        self._names(df, label, features)
        rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(self.features) for e in (F.avg(clean(c)).alias(f"m{i}"), F.var_pop(clean(c)).alias(f"v{i}"))]).orderBy(label).collect()
        total = sum(r["n"] for r in rows)
        k = len(rows) if self.use_laplace else 0
        self.model = {r[label]: (math.log((r["n"] + (1 if k else 0)) / (total + k)), [(r[f"m{i}"] or 0.0, max(r[f"v{i}"] or 0.0, 1e-9)) for i in range(len(self.features))]) for r in rows}
        return self

    def _scores(self) -> dict:
        out = {}
        for k, (prior, stats) in self.model.items():
            e = F.lit(prior)
            for c, (m, v) in zip(self.features, stats, strict=True):
                x = clean(c)
                e = e + F.coalesce(F.lit(-0.5 * math.log(2 * math.pi * v)) - (x - m) * (x - m) / F.lit(2 * v), F.lit(0.0))
            out[k] = e
        return out

    def predict(self, df):
        return df.withColumn("prediction", argmax_class(self._scores()))

    def predict_proba(self, df):
        scores = self._scores()
        out = df.withColumn("_s", F.array(*scores.values())).withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
        total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("probability", F.map_from_arrays(F.array(*map(F.lit, scores)), F.transform("_e", lambda e: e / total)))
        return out.withColumn("prediction", argmax_class(scores)).drop("_s", "_e")


@classifier
class NaiveBayesMultinomialClassifier(Classifier):
    """Token counts (columns) with additive smoothing; ``partial_fit`` adds counts."""

    defaults = {"alpha": 1.0}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.counts: dict = {}
        return self.partial_fit(df)

    def partial_fit(self, df):
        if (low := one_row(df, [F.least(*[F.min(clean(c)) for c in self.features], F.lit(0.0)).alias("m")])["m"]) < 0:
            raise ValueError(f"counts must not be negative; found {low}")
        for r in df.where(F.col(self.label).isNotNull()).groupBy(self.label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(clean(c)).alias(f"s{i}") for i, c in enumerate(self.features)]).collect():
            n, s = self.counts.get(r[self.label], (0, np.zeros(len(self.features))))
            self.counts[r[self.label]] = (n + r["n"], s + np.array([r[f"s{i}"] or 0.0 for i in range(len(self.features))]))
        return self

    def predict(self, df):
        total = sum(n for n, _ in self.counts.values())
        scores = {k: linear(self.features, np.log((s + self.alpha) / (s + self.alpha).sum()), math.log(n / total)) for k, (n, s) in sorted(self.counts.items())}
        return df.withColumn("prediction", argmax_class(scores))


@classifier
class BayesianNetworkClassifier(Classifier):
    """Naive structure over ten quantile bins with Laplace tables."""

    defaults = {"search_algorithm": "naive", "max_parents": 3, "use_laplace": True, "random_state": None, "n_bins": 10}

    def fit(self, df, label=None, features=None):
        if self.search_algorithm != "naive":
            raise ValueError("search_algorithm: only naive (each column has the class as its parent)")
        from .preprocessing import QuantileDiscretizer

        self._names(df, label, features)
        self.binner = QuantileDiscretizer(self.n_bins, self.features).fit(df)
        b = self.binner.transform(df)
        long = b.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in self.features])).alias("x")).groupBy(label, "x.f", "x.b").count().collect()
        n = {r[label]: r["count"] for r in b.groupBy(label).count().collect() if r[label] is not None}
        total, a = sum(n.values()), 1 if self.use_laplace else 1e-9
        self.prior = {k: math.log((v + a) / (total + a * len(n))) for k, v in sorted(n.items())}
        self.tables = {(r[label], r["f"], r["b"]): math.log((r["count"] + a) / (n[r[label]] + a * self.n_bins)) for r in long if r[label] is not None}
        self.none = {k: math.log(a / (v + a * self.n_bins)) for k, v in n.items()}
        return self

    def predict(self, df):
        scores = {}
        for k, p in self.prior.items():
            e = F.lit(p)
            for c in self.features:
                bin_, part = self.binner._apply(c, self.binner.stats[c]), F.lit(self.none[k])
                for (k2, f, b), v in self.tables.items():
                    if k2 == k and f == c and b is not None:
                        part = F.when(bin_ == F.lit(b), F.lit(v)).otherwise(part)
                e = e + part
            scores[k] = e
        return df.withColumn("prediction", argmax_class(scores))


@regressor
class LinearRegression(Regressor):
    """Ridge least squares from one pass of covariances; collinear columns (abs r > 0.99) go."""

    defaults = {"ridge": 1e-8, "attribute_selection": "none", "eliminate_colinear": True, "fit_intercept": True}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        rows = df.where(clean(label).isNotNull())
        mean, cov, n = covariance(rows, [*self.features, label])
        sd = np.sqrt(np.diag(cov))
        keep: list[int] = []
        for i in range(len(self.features)):
            r = [abs(cov[i, j] / (sd[i] * sd[j])) for j in keep if sd[i] * sd[j] > 0]
            if sd[i] > 0 and not (self.eliminate_colinear and any(x > 0.99 for x in r)):
                keep.append(i)
        k = np.array(keep, int)
        z = cov[np.ix_(k, k)] / np.outer(sd[k], sd[k]) if len(k) else np.zeros((0, 0))
        b = np.linalg.solve(z + self.ridge / max(n, 1) * np.eye(len(k)), cov[k, -1] / sd[k]) if len(k) else np.zeros(0)
        self.coef = np.zeros(len(self.features))
        self.coef[k] = b / sd[k] if len(k) else b
        self.means = mean[:-1]
        self.intercept = float(mean[-1] - self.coef @ mean[:-1]) if self.fit_intercept else 0.0
        return self

    def predict(self, df):
        return df.withColumn("prediction", linear(self.features, self.coef, self.intercept, self.means))


@regressor
class SimpleLinearRegression(LinearRegression):
    """The one column with the least squared error."""

    defaults = {"attribute_index": -1}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        mean, cov, _ = covariance(df.where(clean(label).isNotNull()), [*self.features, label])
        var, c = np.diag(cov)[:-1], cov[:-1, -1]
        gain = np.where(var > 0, c**2 / np.where(var > 0, var, 1), -1)
        i = self.attribute_index if self.attribute_index >= 0 else int(gain.argmax())
        self.coef = np.zeros(len(self.features))
        self.coef[i] = c[i] / var[i] if var[i] > 0 else 0.0
        self.means, self.intercept = mean[:-1], float(mean[-1] - self.coef @ mean[:-1])
        return self


@regressor
class BayesianLinearRegressor(Regressor):
    """Gaussian posterior of the weights from X'X and X'y; adds ``prediction_std``."""

    defaults = {"alpha": 1.0, "beta": 1.0, "fit_intercept": True}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        mean, cov, n = covariance(df.where(clean(label).isNotNull()), [*self.features, label])
        second = (cov + np.outer(mean, mean)) * n
        d = len(self.features)
        xtx, xty = second[:d, :d], second[:d, d]
        if self.fit_intercept:
            xtx = np.block([[np.array([[n]]), (mean[:d] * n)[None]], [(mean[:d] * n)[:, None], xtx]])
            xty = np.r_[mean[d] * n, xty]
        self.cov = np.linalg.inv(self.alpha * np.eye(len(xtx)) + self.beta * xtx)
        self.weights, self.means = self.beta * self.cov @ xty, mean[:d]
        return self

    def predict(self, df):
        w, b = (self.weights[1:], self.weights[0]) if self.fit_intercept else (self.weights, 0.0)
        x = [F.lit(1.0)] * self.fit_intercept + [F.coalesce(clean(c), F.lit(float(m))) for c, m in zip(self.features, self.means, strict=True)]
        var = F.lit(1 / self.beta)
        for i in range(len(x)):
            for j in range(len(x)):
                var = var + x[i] * x[j] * F.lit(float(self.cov[i, j]))
        return df.withColumns({"prediction": linear(self.features, w, b, self.means), "prediction_std": F.sqrt(var)})


# ---------------------------------------------------------------- of pyspark.ml


class _ML:
    """One interface over an estimator of pyspark.ml: columns become a vector, classes become indexes and back."""

    def _estimator(self, n_features: int, n_classes: int):
        raise NotImplementedError

    def _vector(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"_x_{c}": F.coalesce(clean(c), F.lit(self.means[c] or 0.0)) for c in self.features})
        out = VectorAssembler(inputCols=[f"_x_{c}" for c in self.features], outputCol="_v").transform(filled).drop(*[f"_x_{c}" for c in self.features])
        return self._widen(out)

    def _widen(self, df: DataFrame) -> DataFrame:
        return df

    def _fit_ml(self, df, label, features, weight=None):
        self._names(df, label, features)
        self.means = one_row(df, [F.avg(clean(c)).alias(c) for c in self.features])
        is_class = isinstance(self, Classifier)
        self.classes = classes_of(df, label) if is_class else []
        y = _code(label, self.classes) if is_class else clean(label)
        rows = self._vector(df.withColumn("_y", y).where("_y is not null"))
        if is_class and len(self.classes) < 2:
            self.model = None
            return self
        est = self._estimator(len(self.features), len(self.classes))
        if is_class and len(self.classes) > 2 and isinstance(est, (C.GBTClassifier, C.LinearSVC, C.FMClassifier)):
            est = C.OneVsRest(classifier=est)
        est = est.setFeaturesCol("_v").setLabelCol("_y").setPredictionCol("_p")
        if weight is not None and est.hasParam("weightCol"):
            est = est.setWeightCol(weight)
        self.model = est.fit(rows)
        return self

    def fit(self, df, label=None, features=None):
        return self._fit_ml(df, label, features)

    def predict(self, df):
        if isinstance(self, Regressor):
            return self.model.transform(self._vector(df)).withColumn("prediction", F.col("_p")).drop("_v", "_p")
        if self.model is None:
            return df.withColumn("prediction", F.lit(self.classes[0] if self.classes else None))
        out = self.model.transform(self._vector(df))
        table = F.array(*map(F.lit, self.classes))
        out = out.withColumn("prediction", F.element_at(table, F.col("_p").cast("int") + 1))
        if "probability" in out.columns and "probability" not in df.columns:
            out = out.withColumn("probability", F.map_from_arrays(table, vector_to_array("probability")))
        return out.drop("_v", "_p", "rawPrediction")


def _ml(base, name: str, doc: str, defaults: dict, make):
    """A class of the given name whose estimator ``make`` builds from its parameters."""
    cls = type(name, (_ML, base), {"__doc__": doc, "defaults": defaults, "__module__": __name__, "_estimator": lambda self, d, k: make(self, d, k)})
    globals()[name] = cls
    return (classifier if base is Classifier else regressor)(cls)


def _share(s, d: int) -> str:
    """featureSubsetStrategy from sqrt, log2, a count or a share."""
    m = s.max_features
    return {"sqrt": "sqrt", "log2": "log2", None: "all"}.get(m) or (str(m) if isinstance(m, int) else str(float(m)))


_TREE = {"criterion": "gini", "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": None, "random_state": None, "max_bins": 64}
_FOREST = _TREE | {"n_estimators": 100, "max_features": "sqrt"}
_BOOST = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "min_child_weight": 1, "random_state": None, "max_bins": 64}


#: The depth that pyspark.ml's trees can have; none given means this.
MOST_LEVELS = 30


def _tree_kw(s) -> dict:
    """Parameters of pyspark.ml's trees, which go 30 levels deep at most and know no cost-complexity pruning."""
    if (s.max_depth or 0) > MOST_LEVELS:
        raise ValueError(f"max_depth is {MOST_LEVELS} at most")
    if getattr(s, "ccp_alpha", 0.0):
        raise ValueError("ccp_alpha: use the trees of operators.trees or tree_tools.cost_complexity_prune")
    return {"maxDepth": s.max_depth or MOST_LEVELS, "minInstancesPerNode": max(s.min_samples_leaf, (s.min_samples_split + 1) // 2 if s.min_samples_split > 2 else 1), "maxBins": s.max_bins, "seed": s.random_state or 0}


def _impurity(s) -> str:
    return "gini" if s.criterion == "gini" else "entropy"


_ml(Classifier, "LogisticRegression", "Multinomial logistic regression with ridge.", {"max_iter": 100, "learning_rate": 1.0, "ridge": 1e-8, "tol": 1e-4}, lambda s, d, k: C.LogisticRegression(maxIter=s.max_iter, regParam=s.ridge, tol=s.tol))
_ml(Classifier, "SimpleLogisticRegression", "Logistic regression with a few iterations.", {"n_boosting_iterations": 500, "use_cross_validation": True, "n_folds": 5, "weight_trim_beta": 0.0, "use_aic": False}, lambda s, d, k: C.LogisticRegression(maxIter=s.n_boosting_iterations, regParam=1e-6))
_ml(Classifier, "SGDClassifier", "Linear model: hinge loss gives a linear SVM, log loss logistic regression; l1, l2 or elastic net.", {"loss": "hinge", "learning_rate": 0.01, "regularization": "l2", "lambda_": 1e-4, "n_epochs": 100, "l1_ratio": 0.15}, lambda s, d, k: C.LinearSVC(maxIter=s.n_epochs, regParam=s.lambda_) if s.loss == "hinge" and s.regularization == "l2" else C.LogisticRegression(maxIter=s.n_epochs, regParam=s.lambda_, elasticNetParam={"l1": 1.0, "elasticnet": s.l1_ratio}.get(s.regularization, 0.0)))
_ml(Regressor, "SGDRegressor", "Linear model with squared or Huber loss; l1, l2 or elastic net.", {"loss": "squared_error", "learning_rate": 0.01, "regularization": "l2", "lambda_": 1e-4, "n_epochs": 100, "l1_ratio": 0.15}, lambda s, d, k: R.LinearRegression(maxIter=s.n_epochs, regParam=s.lambda_, loss="huber" if s.loss == "huber" else "squaredError", elasticNetParam=0.0 if s.loss == "huber" else {"l1": 1.0, "elasticnet": s.l1_ratio}.get(s.regularization, 0.0)))
_ml(Classifier, "MultilayerPerceptronClassifier", "Hidden layers with a softmax output.", {"hidden_layers": None, "learning_rate": 0.1, "momentum": 0.9, "max_epochs": 200, "validation_size": 0.0, "random_state": None}, lambda s, d, k: C.MultilayerPerceptronClassifier(layers=[d, *(s.hidden_layers or [(d + k) // 2 + 1]), k], maxIter=s.max_epochs, seed=s.random_state or 0))
_ml(Classifier, "DecisionTreeClassifier", "One tree over quantile bins: gini or entropy.", _TREE | {"ccp_alpha": 0.0}, lambda s, d, k: C.DecisionTreeClassifier(impurity=_impurity(s), **_tree_kw(s)))
_ml(Regressor, "DecisionTreeRegressor", "One tree over quantile bins by variance.", _TREE | {"criterion": "squared_error", "ccp_alpha": 0.0}, lambda s, d, k: R.DecisionTreeRegressor(**_tree_kw(s)))
_ml(Classifier, "DecisionStumpClassifier", "A tree of one split.", {"max_bins": 64}, lambda s, d, k: C.DecisionTreeClassifier(maxDepth=1, maxBins=s.max_bins))
_ml(Classifier, "RandomTreeClassifier", "One tree that sees random columns at each split.", _TREE | {"max_features": "sqrt"}, lambda s, d, k: C.RandomForestClassifier(numTrees=1, featureSubsetStrategy=_share(s, d), bootstrap=False, **_tree_kw(s)))
_ml(Regressor, "RandomTreeRegressor", "One tree that sees random columns at each split.", _TREE | {"max_features": "sqrt"}, lambda s, d, k: R.RandomForestRegressor(numTrees=1, featureSubsetStrategy=_share(s, d), bootstrap=False, **_tree_kw(s)))
_ml(Classifier, "RandomForestClassifier", "Bagged trees with random columns.", _FOREST, lambda s, d, k: C.RandomForestClassifier(numTrees=s.n_estimators, impurity=_impurity(s), featureSubsetStrategy=_share(s, d), **_tree_kw(s)))
_ml(Regressor, "RandomForestRegressor", "Bagged trees with random columns.", _FOREST | {"criterion": "squared_error"}, lambda s, d, k: R.RandomForestRegressor(numTrees=s.n_estimators, featureSubsetStrategy=_share(s, d), **_tree_kw(s)))
_ml(Classifier, "LogitBoostClassifier", "Boosted trees of depth 3 on the logistic loss.", {"base_classifier": "DecisionStumpClassifier", "n_iterations": 100, "shrinkage": 0.1, "max_depth": 3, "random_state": None}, lambda s, d, k: C.GBTClassifier(maxIter=s.n_iterations, stepSize=s.shrinkage, maxDepth=s.max_depth, seed=s.random_state or 0))
for _name in ("XGBoost", "LightGBM", "CatBoost"):
    _ml(Classifier, f"{_name}Classifier", f"Gradient-boosted trees with the parameters of {_name}, grown by Spark.", _BOOST, lambda s, d, k: C.GBTClassifier(maxIter=s.n_estimators, stepSize=min(s.learning_rate, 1.0), maxDepth=max(1, s.max_depth), subsamplingRate=s.subsample, minInstancesPerNode=max(1, int(s.min_child_weight)), maxBins=s.max_bins, seed=s.random_state or 0))
    _ml(Regressor, f"{_name}Regressor", f"Gradient-boosted trees with the parameters of {_name}, grown by Spark.", _BOOST, lambda s, d, k: R.GBTRegressor(maxIter=s.n_estimators, stepSize=min(s.learning_rate, 1.0), maxDepth=max(1, s.max_depth), subsamplingRate=s.subsample, minInstancesPerNode=max(1, int(s.min_child_weight)), maxBins=s.max_bins, seed=s.random_state or 0))


class _Fourier(_ML):
    """Kernels by random Fourier features: cosines of random projections, whose products approach the RBF kernel."""

    n_components = 256

    def _widen(self, df):
        if self.kernel == "linear":
            return df
        if not hasattr(self, "_w"):
            v = one_row(df, [F.var_pop(F.element_at(vector_to_array("_v"), i + 1)).alias(str(i)) for i in range(len(self.features))])
            sd = np.sqrt([max(v[str(i)] or 0.0, 1e-12) for i in range(len(self.features))])
            rng = np.random.default_rng(7)
            gamma = 1 / len(self.features) if isinstance(self.gamma, str) else self.gamma
            self._w = rng.normal(0, math.sqrt(2 * gamma), (len(self.features), self.n_components)) / sd[:, None]
            self._b = rng.uniform(0, 2 * math.pi, self.n_components)
        w, b = self._w, self._b

        @F.pandas_udf("array<double>")
        def cosines(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(w)))
            return pd.Series(list(np.cos(x @ w + b) * math.sqrt(2 / len(b))), index=rows.index)

        return df.withColumn("_v", array_to_vector(cosines(vector_to_array("_v"))))


_SVM = {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3, "coef0": 0.0, "tol": 1e-3, "max_iter": 100}


@classifier
class SVC(_Fourier, Classifier):
    """Support vector machine; non-linear kernels through random Fourier features."""

    defaults = _SVM

    def _estimator(self, d, k):
        return C.LinearSVC(maxIter=self.max_iter, regParam=1e-4 / self.C, tol=self.tol)


@regressor
class SVR(_Fourier, Regressor):
    """Robust regression (Huber) on random Fourier features."""

    defaults = _SVM | {"epsilon": 0.1}

    def _estimator(self, d, k):
        return R.LinearRegression(maxIter=self.max_iter, loss="huber", regParam=1e-4 / self.C)


@regressor
class GaussianProcessesRegressor(SVR):
    """Gaussian process mean by ridge regression on random Fourier features."""

    defaults = {"kernel": "rbf", "gamma": "scale", "degree": 2, "noise": 1.0, "normalize": True}

    def _estimator(self, d, k):
        return R.LinearRegression(regParam=self.noise * 1e-3, maxIter=200)


# ---------------------------------------------------------------- ensembles


def _vote(columns: list[Column], classes: list) -> Column:
    return argmax_class({k: sum((F.coalesce((c == F.lit(k)).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0)) for k in classes})


class _Members:
    """Members predict one after the other in one projection; each column of predictions is then combined."""

    def _each(self, df):
        before = df.columns
        for i, m in enumerate(self.members):
            out = m.predict(df)
            df = out.withColumnRenamed("prediction", f"_p{i}").select(*before, *[f"_p{j}" for j in range(i + 1)])
        return df, [F.col(f"_p{i}") for i in range(len(self.members))]

    def _finish(self, df, combined: Column):
        return df.withColumn("prediction", combined).drop(*[f"_p{i}" for i in range(len(self.members))])


@classifier
class VotingClassifier(_Members, Classifier):
    """Majority vote of fitted classifiers."""

    defaults = {"classifiers": None, "combination_rule": "majority"}

    def fit(self, df, label=None, features=None):
        if self.combination_rule != "majority":
            raise ValueError("combination_rule: only majority")
        self._names(df, label, features)
        self.classes = classes_of(df, label)
        self.members = [resolve(c).fit(df, label, self.features) for c in self.classifiers or ("NaiveBayesClassifier", "DecisionTreeClassifier")]
        return self

    def predict(self, df):
        out, cols = self._each(df)
        return self._finish(out, _vote(cols, self.classes))


@regressor
class VotingRegressor(_Members, Regressor):
    """average, median, max or min of fitted regressors."""

    defaults = {"regressors": None, "combination_rule": "average"}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.members = [resolve(c).fit(df, label, self.features) for c in self.regressors or ("LinearRegression", "DecisionTreeRegressor")]
        return self

    def predict(self, df):
        out, cols = self._each(df)
        arr = F.array_sort(F.array(*cols))
        n = len(cols)
        rule = {"average": sum(cols, F.lit(0.0)) / n, "max": F.array_max(arr), "min": F.array_min(arr), "median": (F.element_at(arr, (n + 1) // 2) + F.element_at(arr, n // 2 + 1)) / 2}
        return self._finish(out, rule[self.combination_rule])


class _Bag(_Members):
    def _draw(self, df, i):
        return df.sample(withReplacement=True, fraction=self.bag_size_percent / 100, seed=(self.random_state or 0) + i), self.features

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        if isinstance(self, Classifier):
            self.classes = classes_of(df, label)
        self.members = []
        for i in range(self.n_estimators):
            rows, cols = self._draw(df, i)
            base = resolve(self._base())
            if "random_state" in base.defaults:
                base.set_params(random_state=(self.random_state or 0) + i)
            self.members.append(base.fit(rows, label, cols))
        return self

    def predict(self, df):
        out, cols = self._each(df)
        return self._finish(out, _vote(cols, self.classes) if isinstance(self, Classifier) else sum(cols, F.lit(0.0)) / len(cols))


_BAG = {"n_estimators": 10, "bag_size_percent": 100, "random_state": None}


@classifier
class BaggingClassifier(_Bag, Classifier):
    defaults = {"base_classifier": "C45TreeClassifier"} | _BAG

    def _base(self):
        return self.base_classifier


@regressor
class BaggingRegressor(_Bag, Regressor):
    defaults = {"base_regressor": "C45TreeRegressor"} | _BAG

    def _base(self):
        return self.base_regressor


class _Committee(_Bag):
    def _draw(self, df, i):
        return df, self.features


@classifier
class RandomCommitteeClassifier(_Committee, Classifier):
    defaults = {"base_classifier": "RandomTreeClassifier"} | _BAG
    _base = BaggingClassifier._base


@regressor
class RandomCommitteeRegressor(_Committee, Regressor):
    defaults = {"base_regressor": "RandomTreeRegressor"} | _BAG
    _base = BaggingRegressor._base


class _Subspace(_Bag):
    def _draw(self, df, i):
        d, s = len(self.features), self.subspace_size
        n = max(1, int(d * s) if isinstance(s, float) else s)
        pick = np.sort(np.random.default_rng((self.random_state or 0) + i).permutation(d)[:n])
        return df, [self.features[j] for j in pick]


@classifier
class RandomSubspaceClassifier(_Subspace, Classifier):
    defaults = {"base_classifier": "C45TreeClassifier", "subspace_size": 0.5} | _BAG
    _base = BaggingClassifier._base


@regressor
class RandomSubspaceRegressor(_Subspace, Regressor):
    defaults = {"base_regressor": "C45TreeRegressor", "subspace_size": 0.5} | _BAG
    _base = BaggingRegressor._base


@classifier
class AdaBoostClassifier(_Members, Classifier):
    """SAMME: each round's weights are an expression over the earlier members' predictions, cut once a round."""

    defaults = {"base_classifier": "DecisionStumpClassifier", "n_estimators": 20, "weight_threshold": 100, "random_state": None}

    def fit(self, df, label=None, features=None):
        from ..plans.graph import cut

        self._names(df, label, features)
        self.classes = classes_of(df, label)
        rows, self.members, self.alphas = cut(df.where(F.col(label).isNotNull()).withColumn("_w", F.lit(1.0))), [], []
        for _ in range(self.n_estimators):
            base = resolve(self.base_classifier)
            m = base._fit_ml(rows, label, self.features, weight="_w") if hasattr(base, "_fit_ml") else base.fit(rows, label, self.features)
            wrong = F.coalesce((F.col("prediction") != F.col(label)).cast("double"), F.lit(1.0))
            out = m.predict(rows).withColumn("_bad", wrong)
            r = out.agg((F.sum(F.col("_w") * F.col("_bad")) / F.sum("_w")).alias("e"), F.avg("_w").alias("m")).first()
            e = max(r["e"], 1e-10)
            if e >= 1 - 1 / max(len(self.classes), 2):
                break
            a = math.log((1 - e) / e) + math.log(max(len(self.classes) - 1, 1))
            self.members.append(m)
            self.alphas.append(a)
            if e <= 1e-10:
                break
            rows = cut(out.withColumn("_w", F.col("_w") * F.exp(F.lit(a) * F.col("_bad")) / F.lit(r["m"])).select(*rows.columns))
        if not self.members:
            self.members, self.alphas = [ZeroRuleClassifier().fit(df, label)], [1.0]
        return self

    def predict(self, df):
        out, cols = self._each(df)
        return self._finish(out, argmax_class({k: sum((F.coalesce((c == F.lit(k)).cast("double"), F.lit(0.0)) * a for c, a in zip(cols, self.alphas, strict=True)), F.lit(0.0)) for k in self.classes}))


@regressor
class AdditiveRegression(_Members, Regressor):
    """The mean, and members fitted on what remains, each scaled by ``shrinkage``."""

    defaults = {"base_regressor": None, "n_estimators": 10, "shrinkage": 1.0, "minimize_absolute_error": False}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        y = clean(label)
        self.start = df.agg(F.median(y) if self.minimize_absolute_error else F.avg(y)).first()[0] or 0.0
        rows, self.members = df.withColumn("_r", y - F.lit(self.start)), []
        for _ in range(self.n_estimators):
            m = resolve(self.base_regressor or DecisionTreeRegressor(max_depth=2)).fit(rows.withColumn("_t", F.signum("_r") if self.minimize_absolute_error else F.col("_r")), "_t", self.features)  # noqa: F821
            self.members.append(m)
            rows = m.predict(rows).withColumn("_r", F.col("_r") - F.col("prediction") * self.shrinkage).select(*rows.columns)
        return self

    def predict(self, df):
        out, cols = self._each(df)
        return self._finish(out, F.lit(self.start) + sum(cols, F.lit(0.0)) * self.shrinkage)


@regressor
class AdaBoostRegressor(_Members, Regressor):
    """Drucker's boosting: each member is fitted with the rows weighed by the errors so far, and the prediction is the
    members' median, weighed by the logarithm of one over their odds of error.

    ``loss``: linear, square or exponential, of the error's share of the largest.  Boosting ends where a member's mean
    loss reaches one half.  The rows with their weights are written once a round.
    """

    defaults = {"base_regressor": None, "n_estimators": 10, "learning_rate": 1.0, "loss": "linear", "random_state": None}

    def fit(self, df, label=None, features=None):
        from ..plans.graph import cut, discard

        self._names(df, label, features)
        rows = df.select(*dict.fromkeys([*self.features, label])).where(clean(label).isNotNull())
        rows = cut(rows.withColumn("_w", F.lit(1.0)))
        self.members, self.powers = [], []
        for _ in range(self.n_estimators):
            m = resolve(self.base_regressor or DecisionTreeRegressor(max_depth=3))._fit_ml(rows, label, self.features, "_w")  # noqa: F821
            out = m.predict(rows).withColumn("_e", F.abs(clean(label) - F.col("prediction"))).select(*rows.columns, "_e")
            most = out.agg(F.max("_e")).first()[0] or 0.0
            if most <= 0:
                self.members, self.powers = [*self.members, m], [*self.powers, 1.0]
                break
            share = F.col("_e") / F.lit(most)
            lost = {"linear": share, "square": share * share, "exponential": 1 - F.exp(-share)}[self.loss]
            mean = out.agg(F.sum(F.col("_w") * lost) / F.sum("_w")).first()[0]
            if mean >= 0.5:
                if not self.members:
                    self.members, self.powers = [m], [1.0]
                break
            odds = max(mean / (1 - mean), 1e-10)
            self.members.append(m)
            self.powers.append(self.learning_rate * math.log(1 / odds))
            rows, before = cut(out.withColumn("_w", F.col("_w") * F.pow(F.lit(odds), (1 - lost) * self.learning_rate)).select(*rows.columns)), rows
            discard(before)
        return self

    def predict(self, df):
        out, cols = self._each(df)
        votes = F.array_sort(F.array(*[F.struct(c.alias("p"), F.lit(w).alias("w")) for c, w in zip(cols, self.powers, strict=True)]))
        half = F.lit(sum(self.powers) / 2)
        step = lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["m"].isNull() & (a["s"] + x["w"] >= half - 1e-12), x["p"]).otherwise(a["m"]).alias("m"))
        middle = F.aggregate(votes, F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m")), step)["m"]
        return self._finish(out, middle)


class _Stack(_Members):
    """Out-of-fold predictions of the members become the columns of a meta learner."""

    def _fit_stack(self, df, label, features, kinds, meta, id_col):
        from ..plans.splitting import fold_column

        self._names(df, label, features)
        rows = df.withColumn("_fold", fold_column(id_col, self.num_folds, self.random_state or 0))
        parts = []
        for f in range(self.num_folds):
            train, test = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
            self.members = [resolve(k).fit(train, label, self.features) for k in kinds]
            parts.append(self._each(test)[0])
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        self.members = [resolve(k).fit(df, label, self.features) for k in kinds]
        self.classes = classes_of(df, label) if isinstance(self, Classifier) else []
        self.inputs = [f"_m{i}_{j}" for i in range(len(kinds)) for j in range(max(len(self.classes), 1))]
        self.meta = resolve(meta).fit(self._meta_rows(every), label, self.inputs)
        return self

    def _meta_rows(self, df):
        cols = {}
        for i in range(len(self.members)):
            for j, k in enumerate(self.classes or [None]):
                cols[f"_m{i}_{j}"] = F.col(f"_p{i}") if k is None else F.coalesce((F.col(f"_p{i}") == F.lit(k)).cast("double"), F.lit(0.0))
        return df.withColumns(cols)

    def predict(self, df):
        out, _ = self._each(df)
        return self.meta.predict(self._meta_rows(out)).select(*df.columns, "prediction")


@classifier
class StackingClassifier(_Stack, Classifier):
    defaults = {"classifiers": None, "meta_classifier": "LogisticRegression", "num_folds": 5, "use_probabilities": False, "random_state": None, "id_col": "row_id"}

    def fit(self, df, label=None, features=None):
        return self._fit_stack(df, label, features, self.classifiers or ("NaiveBayesClassifier", "DecisionTreeClassifier"), self.meta_classifier, self.id_col)


@regressor
class StackingRegressor(_Stack, Regressor):
    defaults = {"regressors": None, "meta_regressor": "LinearRegression", "num_folds": 5, "random_state": None, "id_col": "row_id"}

    def fit(self, df, label=None, features=None):
        return self._fit_stack(df, label, features, self.regressors or ("LinearRegression", "DecisionTreeRegressor"), self.meta_regressor, self.id_col)


@classifier
class FilteredClassifier(Classifier):
    """A transformer, then a classifier."""

    defaults = {"base_classifier": "C45TreeClassifier", "filter": None, "filter_params": None}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.step = resolve(self.filter or "StandardScaler", **(self.filter_params or {}) | ({"columns": self.features} if not self.filter_params else {})) if not hasattr(self.filter, "fit") or isinstance(self.filter, type) else self.filter
        rows = self.step.fit_transform(df, label)
        self.model = resolve(self.base_classifier).fit(rows, label)
        return self

    def predict(self, df):
        return self.model.predict(self.step.transform(df))


@classifier
class MultiClassClassifier(_Members, Classifier):
    """One classifier for each class against the rest; the greatest chance wins."""

    defaults = {"base_classifier": "LogisticRegression", "method": "ova", "random_state": None}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.classes = classes_of(df, label)
        self.models = [resolve(self.base_classifier).fit(df.withColumn("_one", (F.col(label) == F.lit(k)).cast("int")), "_one", self.features) for k in self.classes]
        return self

    def predict(self, df):
        names = df.columns
        for i, m in enumerate(self.models):
            out = m.predict_proba(df)
            s = F.element_at("probability", 1) if "probability" in out.columns else F.col("prediction").cast("double")
            df = out.withColumn(f"_s{i}", s).select(*names, *[f"_s{j}" for j in range(i + 1)])
        return df.withColumn("prediction", argmax_class({k: F.col(f"_s{i}") for i, k in enumerate(self.classes)})).drop(*[f"_s{i}" for i in range(len(self.models))])


@regressor
class RegressionByDiscretization(Regressor):
    """A classifier of the target's bins; the prediction is the mean of the bins' means by their chances."""

    defaults = {"base_classifier": None, "n_bins": 10, "use_equal_frequency": True}

    def fit(self, df, label=None, features=None):
        from .preprocessing import EqualWidthDiscretizer, QuantileDiscretizer

        self._names(df, label, features)
        rows = df.withColumn("_bin", clean(label))
        rows = (QuantileDiscretizer if self.use_equal_frequency else EqualWidthDiscretizer)(self.n_bins, ["_bin"]).fit_transform(rows)
        self.means_of = {r["_bin"]: r["m"] for r in rows.groupBy("_bin").agg(F.avg(clean(label)).alias("m")).collect() if r["_bin"] is not None}
        self.model = resolve(self.base_classifier or "DecisionTreeClassifier").fit(rows, "_bin", self.features)
        return self

    def predict(self, df):
        out = self.model.predict_proba(df)
        table = F.create_map(*[x for k, v in self.means_of.items() for x in (F.lit(k), F.lit(v))])
        if "probability" in out.columns:
            e = F.aggregate(F.map_entries("probability"), F.lit(0.0), lambda a, x: a + x["value"] * F.coalesce(F.element_at(table, x["key"]), F.lit(0.0)))
        else:
            e = F.element_at(table, F.col("prediction"))
        return out.withColumn("prediction", e).drop("probability")

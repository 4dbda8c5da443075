"""Feature construction, extraction and selection."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Params, Transformer, clean, feature_constructor, feature_extractor, feature_selector, numeric_columns, one_row
from ..functions import metrics as M
from .preprocessing import EqualWidthDiscretizer, QuantileDiscretizer

FeatureMethod = FeatureConstructor = FeatureExtractor = Transformer

MATH = {
    "log": (F.log, "> 0"), "log2": (F.log2, "> 0"), "log10": (F.log10, "> 0"), "log1p": (F.log1p, "> -1"), "sqrt": (F.sqrt, ">= 0"), "cbrt": (F.cbrt, None), "square": (lambda c: c * c, None), "cube": (lambda c: c * c * c, None),
    "exp": (F.exp, None), "expm1": (F.expm1, None), "sin": (F.sin, None), "cos": (F.cos, None), "tan": (F.tan, None), "abs": (F.abs, None), "reciprocal": (lambda c: F.when(c != 0, 1 / c), "<> 0"), "sigmoid": (lambda c: 1 / (1 + F.exp(-c)), None),
}


@feature_constructor
class MathematicalFeaturesGenerator(Transformer):
    """Adds ``log(x)`` and so on; invalid values give null or are clipped to 1e-10."""

    defaults = {"transformations": None, "include_original": True, "handle_invalid": "nan", "columns": None}

    def transform(self, df):
        names = numeric_columns(df, self.columns)
        new = {}
        for c in names:
            for t in self.transformations or ("log", "sqrt", "square"):
                f, valid = MATH[t]
                x = clean(c)
                if valid:
                    ok = F.expr(f"`{c}` {valid}")
                    x = F.when(ok, x) if self.handle_invalid == "nan" else F.greatest(x, F.lit(1e-10))
                new[f"{t}({c})"] = f(x)
        out = df.withColumns(new)
        return out if self.include_original else out.drop(*names)


@feature_constructor
class PolynomialFeaturesGenerator(Transformer):
    """All monomials to a degree: ``a^2``, ``a*b``; the bias is ``1``."""

    defaults = {"degree": 2, "interaction_only": False, "include_bias": True, "order": "C", "columns": None}

    def terms(self, names):
        pick = itertools.combinations if self.interaction_only else itertools.combinations_with_replacement
        return [t for d in range(0 if self.include_bias else 1, self.degree + 1) for t in pick(names, d)]

    def transform(self, df):
        names = numeric_columns(df, self.columns)
        new: dict[str, Column] = {}
        for t in self.terms(names):
            powers = [(c, t.count(c)) for c in dict.fromkeys(t)]
            value = F.lit(1.0)
            for c in t:
                value = value * clean(c)
            new["*".join(c if n == 1 else f"{c}^{n}" for c, n in powers) or "1"] = value
        return df.select(*[c for c in df.columns if c not in names], *[e.alias(k) for k, e in new.items()])


@feature_constructor
class InteractionFeaturesGenerator(Transformer):
    """Products of pairs, ``a*b``."""

    defaults = {"include_original": True, "columns": None}

    def transform(self, df):
        names = numeric_columns(df, self.columns)
        out = df.withColumns({f"{a}*{b}": clean(a) * clean(b) for a, b in itertools.combinations(names, 2)})
        return out if self.include_original else out.drop(*names)


@feature_constructor
class BinningFeaturesGenerator(Transformer):
    """Adds ``x_bin`` (or a 0/1 column for each bin) by equal width or quantiles."""

    defaults = {"n_bins": 5, "strategy": "quantile", "encode": "ordinal", "include_original": False, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        kind = QuantileDiscretizer if self.strategy == "quantile" else EqualWidthDiscretizer
        self.binner = kind(self.n_bins, self.names).fit(df)
        return self

    def transform(self, df):
        bins = {c: self.binner._apply(c, self.binner.stats[c]) for c in self.names}
        new = {f"{c}_bin": b for c, b in bins.items()} if self.encode == "ordinal" else {f"{c}_bin_{i}": (b == i).cast("double") for c, b in bins.items() for i in range(self.n_bins)}
        out = df.withColumns(new)
        return out if self.include_original else out.drop(*self.names)


def covariance(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariance and rows in one pass of d * d aggregates; missing values count as the mean."""
    means = one_row(df, [F.avg(clean(c)).alias(c) for c in names])
    m = np.array([means[c] or 0.0 for c in names])
    x = [F.coalesce(clean(c) - F.lit(float(m[i])), F.lit(0.0)) for i, c in enumerate(names)]
    d = len(names)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x[i] * x[j]).alias(f"{i},{j}") for i in range(d) for j in range(i, d)]).first().asDict()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[f"{i},{j}"] or 0.0
    return m, cov, row["n"]


class _Projected(Transformer):
    """Linear combinations of centered columns as a projection."""

    def _project(self, df, prefix):
        x = [F.coalesce(clean(c) - F.lit(float(m)), F.lit(0.0)) for c, m in zip(self.names, self.mean, strict=True)]
        new = {}
        for k in range(self.matrix.shape[1]):
            e = F.lit(0.0)
            for i, v in enumerate(self.matrix[:, k]):
                if v:
                    e = e + x[i] * F.lit(float(v))
            new[f"{prefix}{k}"] = e
        return df.select(*[c for c in df.columns if c not in self.names], *[e.alias(k) for k, e in new.items()])


@feature_extractor
class PCAExtractor(_Projected):
    """Principal components from the covariance; each has its largest loading positive."""

    defaults = {"n_components": None, "center": True, "whiten": False, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        self.mean, cov, n = covariance(df, self.names)
        if not self.center:
            s = np.sqrt(np.diag(cov))
            s[s == 0] = 1
            cov = cov / np.outer(s, s)
        value, vector = np.linalg.eigh(cov)
        order = np.argsort(-value)
        value, vector = np.maximum(value[order], 0), vector[:, order]
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))])
        share = value / max(value.sum(), 1e-300)
        k = self.n_components
        k = len(value) if k is None else k if isinstance(k, int) and k >= 1 else int(np.searchsorted(share.cumsum(), k) + 1)
        self.explained_variance_ratio, self.components = share[:k], vector[:, :k].T
        self.matrix = vector[:, :k] / (np.sqrt(np.maximum(value[:k] * n, 1e-12)) if self.whiten else 1)
        if not self.center:
            self.matrix = self.matrix / s[:, None]
        return self

    def transform(self, df):
        return self._project(df, "pc")


@feature_extractor
class RandomProjectionExtractor(_Projected):
    """gaussian, sparse1 (+-1) or sparse2 (+-root 3, one in three) projections; 'auto' sizes by the JL bound."""

    defaults = {"n_components": 10, "distribution": "gaussian", "random_state": None, "eps": 0.1, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        d, rng = len(self.names), np.random.default_rng(self.random_state)
        k = self.n_components
        if k == "auto":
            k = min(d, int(4 * math.log(max(df.count(), 2)) / (self.eps**2 / 2 - self.eps**3 / 3)))
        self.mean = np.zeros(d)
        density = getattr(self, "density", 1 / 3)
        draw = {"gaussian": lambda: rng.normal(size=(d, k)), "sparse1": lambda: rng.choice((-1.0, 1.0), (d, k)), "sparse2": lambda: rng.choice((-1.0, 0.0, 1.0), (d, k), p=(density / 2, 1 - density, density / 2)) / math.sqrt(density)}
        self.matrix = draw[self.distribution]() / math.sqrt(k)
        return self

    def transform(self, df):
        return self._project(df, "rp")


@feature_extractor
class SparseRandomProjectionExtractor(RandomProjectionExtractor):
    defaults = {"n_components": 10, "density": 1 / 3, "random_state": None, "eps": 0.1, "columns": None, "distribution": "sparse2"}


# ---------------------------------------------------------------- selection

SCORES = {"chi2": M.chi2, "f_classif": M.f_classif, "f_regression": M.f_regression, "correlation": M.correlation, "oner_score": M.oner_score}


class FeatureSelector(Params):
    """Keeps some numeric columns; ``fit(df, y)``, ``transform(df)``, ``get_support()``."""

    defaults = {"score_func": "f_classif"}

    def _scores(self, df, y):
        self.y, self.names = y, numeric_columns(df, getattr(self, "columns", None), skip=(y,))
        f = SCORES[self.score_func or "f_classif"] if not callable(self.score_func) else self.score_func
        self.scores = f(df, self.names, y)
        return self.scores

    def _rank(self):
        at = {c: i for i, c in enumerate(self.names)}
        key = lambda c: (-math.inf if self.scores[c] is None or math.isnan(self.scores[c]) else self.scores[c], at[c])
        return sorted(self.names, key=key, reverse=True)

    def get_support(self) -> list[str]:
        return [c for c in self.names if c in set(self.selected)]

    def transform(self, df: DataFrame) -> DataFrame:
        gone = set(self.names) - set(self.selected)
        return df.drop(*gone)

    def fit_transform(self, df, y=None):
        return self.fit(df, y).transform(df)


SelectorMixin = FeatureSelector


@feature_selector
class SelectKBestSelector(FeatureSelector):
    defaults = {"score_func": "f_classif", "k": 10}

    def fit(self, df, y=None):
        self._scores(df, y)
        self.selected = self._rank()[: self.k]
        return self


@feature_selector
class SelectPercentileSelector(FeatureSelector):
    defaults = {"score_func": "f_classif", "percentile": 10}

    def fit(self, df, y=None):
        self._scores(df, y)
        self.selected = self._rank()[: max(1, int(len(self.names) * self.percentile / 100))]
        return self


@feature_selector
class SelectThresholdSelector(FeatureSelector):
    defaults = {"score_func": "f_classif", "threshold": 0.0, "ignore_features": None}

    def fit(self, df, y=None):
        self._scores(df, y)
        self.selected = [c for c in self.names if self.scores[c] is not None and self.scores[c] >= self.threshold and c not in (self.ignore_features or ())]
        return self


@feature_selector
class SelectFprSelector(FeatureSelector):
    """Keeps features whose F test has p below alpha."""

    defaults = {"score_func": "f_classif", "alpha": 0.05}

    def fit(self, df, y=None):
        from ..functions.stats import f_sf

        self._scores(df, y)
        n = df.count()
        k = df.select(y).distinct().count() if self.score_func == "f_classif" else 2
        self.pvalues = {c: 0.0 if math.isinf(s) else f_sf(s, k - 1, n - k) for c, s in self.scores.items()}
        self.selected = [c for c in self.names if self.pvalues[c] < self.alpha]
        return self


@feature_selector
class GenericUnivariateSelector(FeatureSelector):
    defaults = {"score_func": "f_classif", "mode": "k_best", "param": 10}

    def fit(self, df, y=None):
        kind, key = {"k_best": (SelectKBestSelector, "k"), "percentile": (SelectPercentileSelector, "percentile"), "fpr": (SelectFprSelector, "alpha"), "threshold": (SelectThresholdSelector, "threshold")}[self.mode]
        inner = kind(score_func=self.score_func, **{key: self.param}).fit(df, y)
        self.names, self.scores, self.selected = inner.names, inner.scores, inner.selected
        return self


@feature_selector
class VarianceThresholdSelector(FeatureSelector):
    defaults = {"threshold": 0.0, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        v = one_row(df, [F.var_pop(clean(c)).alias(c) for c in self.names])
        self.scores = v
        self.selected = [c for c in self.names if (v[c] or 0.0) > self.threshold]
        return self


@feature_selector
class CFSSelector(FeatureSelector):
    """Greedy growth of merit = k r_cf / sqrt(k + k (k - 1) r_ff), by symmetrical uncertainty of binned columns."""

    defaults = {"n_bins": 10, "search_method": "best_first", "search_termination": 5, "locally_predictive": True, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        b = EqualWidthDiscretizer(self.n_bins, self.names).fit_transform(df).select(*self.names, y)
        cf = {c: M.symmetrical_uncertainty(b, c, y) for c in self.names}
        ff = {frozenset(p): M.symmetrical_uncertainty(b, *p) for p in itertools.combinations(self.names, 2)}

        def merit(s):
            k = len(s)
            r = sum(ff[frozenset(p)] for p in itertools.combinations(s, 2)) / max(k * (k - 1) / 2, 1)
            return sum(cf[c] for c in s) / math.sqrt(k + k * (k - 1) * r) if k else 0.0

        best: list[str] = []
        while len(best) < len(self.names):
            c = max((x for x in self.names if x not in best), key=lambda x: merit([*best, x]))
            if merit([*best, c]) <= merit(best):
                break
            best.append(c)
        self.scores, self.selected = cf, best
        return self


@feature_selector
class RandomSubsetSelector(FeatureSelector):
    defaults = {"n_features": 0.5, "invert": False, "random_state": None, "columns": None}

    def fit(self, df, y=None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        d = len(self.names)
        n = {"sqrt": int(math.sqrt(d)), "log2": int(math.log2(max(d, 1)))}.get(self.n_features, self.n_features)
        n = max(1, int(n * d) if isinstance(n, float) else n)
        pick = set(np.random.default_rng(self.random_state).permutation(d)[:n].tolist())
        self.selected = [c for i, c in enumerate(self.names) if (i in pick) != self.invert]
        return self


@feature_selector
class BootstrapFeaturesSelector(RandomSubsetSelector):
    """Drawn with replacement; columns drawn more than once count once."""

    defaults = {"n_features": "sqrt", "random_state": None, "columns": None}
    invert = False


@feature_selector
class SequentialFeatureSelector(FeatureSelector):
    """Greedy growth (or shrinking) of the columns by the cross-validated score of an estimator."""

    defaults = {"estimator": None, "n_features_to_select": "auto", "direction": "forward", "scoring": "accuracy", "cv": 5, "tol": 0.0, "random_state": None, "columns": None, "id_col": "row_id"}

    def fit(self, df, y=None):
        from ..plans.validation import cross_val_score

        self.names = numeric_columns(df, self.columns, skip=(y, self.id_col))
        want = len(self.names) // 2 if self.n_features_to_select == "auto" else self.n_features_to_select
        score = lambda s: float(np.mean(cross_val_score(self.estimator, df, y, features=s, cv=self.cv, scoring=self.scoring, id_col=self.id_col))) if s else -math.inf
        grow = self.direction == "forward"
        now, best = ([], -math.inf) if grow else (list(self.names), score(list(self.names)))
        while len(now) < want if grow else len(now) > want:
            options = [[*now, c] for c in self.names if c not in now] if grow else [[x for x in now if x != c] for c in now]
            scored = [(score(o), o) for o in options]
            s, o = max(scored, key=lambda t: t[0])
            if s < best + self.tol and self.n_features_to_select == "auto":
                break
            now, best = o, s
        self.selected, self.best_score = now, best
        return self


WrapperSelector = BestFirstSelector = SequentialFeatureSelector

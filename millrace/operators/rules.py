"""Rule learners, decision tables, lazy learners, model trees and incremental trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Classifier, Regressor, classifier, clean, one_row, regressor, sampler
from .clustering import KMeansClusterer
from .learners import DecisionTreeClassifier, DecisionTreeRegressor, LinearRegression, LogisticRegression, ZeroRuleClassifier, classes_of  # type: ignore[attr-defined]
from .neighbors import knn_join
from .preprocessing import QuantileDiscretizer
from .sampling import SMOTESampler, _Sampler, repeat_rows


def paths(model, features: list[str], root=None, conditions=()):
    """Leaves of a fitted tree as (conditions, node); a condition is (column, threshold, goes left)."""
    node = root if root is not None else model._call_java("rootNode")
    if node.subtreeDepth() == 0:
        yield list(conditions), node
        return
    s = node.split()
    c, t = features[s.featureIndex()], float(s.threshold())
    yield from paths(model, features, node.leftChild(), (*conditions, (c, t, True)))
    yield from paths(model, features, node.rightChild(), (*conditions, (c, t, False)))


def _holds(conditions, means) -> F.Column:
    out = F.lit(True)
    for c, t, left in conditions:
        x = F.coalesce(clean(c), F.lit(means[c] or 0.0))
        out = out & ((x <= F.lit(t)) if left else (x > F.lit(t)))
    return out


class Rule:
    def __init__(self, conditions, outcome, covered: float = 0.0):
        self.conditions, self.outcome, self.covered = conditions, outcome, covered

    def __repr__(self):
        left = " and ".join(f"{c} {'<=' if le else '>'} {t:.6g}" for c, t, le in self.conditions) or "true"
        return f"if {left} then {self.outcome}"


@classifier
class PARTClassifier(Classifier):
    """An ordered list of rules, one for each leaf of an entropy tree, those that cover most rows first."""

    defaults = {"min_samples_leaf": 2, "confidence_factor": 0.25, "unpruned": False, "random_state": None, "max_depth": 6}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        tree = DecisionTreeClassifier(criterion="entropy", max_depth=self.max_depth, min_samples_leaf=self.min_samples_leaf).fit(df, label, self.features)
        self.means, self.classes = tree.means, tree.classes
        self.default = ZeroRuleClassifier().fit(df, label).majority
        found = [Rule(c, self.classes[int(n.prediction())], float(n.impurityStats().count())) for c, n in paths(tree.model, self.features)] if tree.model else []
        self.rules = sorted(found, key=self._order)
        return self

    def _order(self, r):
        return (-r.covered, len(r.conditions))

    def predict(self, df):
        out = F.lit(self.default)
        for r in reversed(self.rules):
            out = F.when(_holds(r.conditions, self.means), F.lit(r.outcome)).otherwise(out)
        return df.withColumn("prediction", out)


@classifier
class RIPPERClassifier(PARTClassifier):
    """Rules for the rarer classes first; the most frequent class is the default."""

    defaults = {"min_no": 2.0, "num_folds": 3, "num_optimizations": 2, "use_pruning": True, "random_state": None, "max_depth": 6}
    min_samples_leaf = 2

    def fit(self, df, label=None, features=None):
        self.min_samples_leaf = max(1, int(self.min_no))
        n = {r[0]: r["count"] for r in df.groupBy(label).count().collect()}
        self._rank = {k: i for i, k in enumerate(sorted((k for k in n if k is not None), key=lambda k: (n[k], str(k))))}
        super().fit(df, label, features)
        self.rules = [r for r in self.rules if r.outcome != self.default]
        return self

    def _order(self, r):
        return (self._rank.get(r.outcome, 0), -r.covered)


class _ModelTree:
    """A tree whose leaves hold models of their own rows."""

    def _grow(self, df, label, features, tree, leaf):
        self._names(df, label, features)
        self.tree = tree.fit(df, label, self.features)
        self.leaves = []
        for cond, _ in paths(self.tree.model, self.features) if self.tree.model else [([], None)]:
            rows = df.where(_holds(cond, self.tree.means))
            self.leaves.append((cond, leaf().fit(rows, label, self.features)))
        return self

    def predict(self, df):
        out = None
        for cond, m in self.leaves:
            part = m.predict(df.where(_holds(cond, self.tree.means))).select(*df.columns, "prediction")
            out = part if out is None else out.unionByName(part)
        return out


@regressor
class M5ModelRulesRegressor(_ModelTree, Regressor):
    """Disjoint rules, each with a linear model of the rows that it covers."""

    defaults = {"min_samples_leaf": 4, "use_unsmoothed": False, "max_depth": 3}

    def fit(self, df, label=None, features=None):
        return self._grow(df, label, features, DecisionTreeRegressor(max_depth=self.max_depth, min_samples_leaf=max(self.min_samples_leaf, 2)), LinearRegression)


@classifier
class LogisticModelTreeClassifier(_ModelTree, Classifier):
    """A shallow entropy tree with a logistic model in each leaf."""

    defaults = {"min_samples_leaf": 15, "max_depth": None, "num_boosting_iterations": -1, "use_aic": False}

    def fit(self, df, label=None, features=None):
        tree = DecisionTreeClassifier(criterion="entropy", max_depth=self.max_depth or 2, min_samples_leaf=self.min_samples_leaf)
        return self._grow(df, label, features, tree, lambda: LogisticRegression(max_iter=30, ridge=1e-4))


@classifier
class DecisionTableClassifier(Classifier):
    """Majority class of each cell of the quantile bins of up to five columns, chosen greedily; other cells take the
    most frequent class.  Edges are those of the training rows."""

    defaults = {"search_method": "best_first", "cross_val_folds": 1, "use_ibk": False, "random_state": None, "n_bins": 5, "max_columns": 5}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.binner = QuantileDiscretizer(self.n_bins, self.features).fit(df)
        rows = self.binner.transform(df).where(F.col(label).isNotNull())
        self.default = ZeroRuleClassifier().fit(df, label).majority

        def table(cols):
            n = rows.groupBy(*cols, label).count()
            # leave-one-out: a row's own vote does not count
            return n, n.groupBy(*cols).agg(F.max("count").alias("m"), F.sum("count").alias("s")).agg(F.sum(F.when(F.col("s") > 1, F.col("m") - F.col("m") / F.col("s")).otherwise(0.0))).first()[0]

        self.columns, best = [], -1.0
        while len(self.columns) < min(self.max_columns, len(self.features)):
            options = [(table([*self.columns, c])[1], c) for c in self.features if c not in self.columns]
            s, c = max(options, key=lambda t: t[0])
            if s <= best:
                break
            best = s
            self.columns.append(c)
        self.cells = table(self.columns)[0].groupBy(*[F.col(c).alias(f"_b_{c}") for c in self.columns]).agg(F.min(F.struct(-F.col("count"), F.col(label)))[label].alias("_cell"))
        return self

    def predict(self, df):
        bins = df.withColumns({f"_q_{c}": self.binner._apply(c, self.binner.stats[c]) for c in self.columns})
        on = [F.col(f"_q_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in self.columns]
        out = bins.join(self.cells, on, "left") if on else bins.withColumn("_cell", F.lit(None))
        return out.withColumn("prediction", F.coalesce("_cell", F.lit(self.default))).select(*df.columns, "prediction")


@classifier
class KStarClassifier(Classifier):
    """Similarity exp(-distance / blend) of the ``k`` nearest rows in deviations, added by class."""

    defaults = {"global_blend": 20, "entropy_auto_blend": False, "missing_mode": "average", "k": 50, "id_col": "row_id"}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        r = one_row(df, [F.stddev_pop(clean(c)).alias(c) for c in self.features] + [F.avg(clean(c)).alias(f"m_{c}") for c in self.features])
        self.scale = {c: (r[c] or 1.0, r[f"m_{c}"] or 0.0) for c in self.features}
        self.train = self._scaled(df).select(self.id_col, *self.features, F.col(label).alias("_label")).where("_label is not null")
        return self

    def _scaled(self, df):
        return df.withColumns({c: F.coalesce(clean(c), F.lit(m)) / F.lit(s) for c, (s, m) in self.scale.items()})

    def predict(self, df):
        near = knn_join(self._scaled(df), self.train, self.k, self.features, self.id_col, "manhattan", carry=["_label"])
        votes = near.groupBy("query", "_label").agg(F.sum(F.exp(-F.col("distance") * F.lit(100.0 / self.global_blend) / len(self.features))).alias("v"))
        best = votes.groupBy("query").agg(F.min(F.struct(-F.col("v"), "_label"))["_label"].alias("prediction"))
        return df.join(best, F.col(self.id_col) == F.col("query"), "left").drop("query")


@regressor
class LocallyWeightedLearningRegressor(KStarClassifier, Regressor):
    """A ridge fit around each row to its k nearest, weighted by distance."""

    defaults = {"k": 30, "weight_kernel": "linear", "use_all_attributes": True, "id_col": "row_id"}

    def predict(self, df):
        k = self.k if self.k > 0 else 200
        near = knn_join(self._scaled(df), self.train, k, self.features, self.id_col, carry=[*self.features, "_label"])
        feats, kind = self.features, self.weight_kernel
        key = near.schema["query"].dataType.simpleString()
        own = self._scaled(df).select(F.col(self.id_col).alias("query"), *[F.col(c).alias(f"_q_{c}") for c in feats])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            d = pdf["distance"].to_numpy() / max(pdf["distance"].max(), 1e-12)
            w = np.sqrt({"linear": np.maximum(1.0001 - d, 0), "inverse": 1 / (1e-6 + d), "gaussian": np.exp(-d * d)}[kind])
            x = np.column_stack([np.ones(len(pdf)), pdf[feats].to_numpy(float) - pdf[[f"_q_{c}" for c in feats]].to_numpy(float)])
            a = (x * w[:, None]).T @ (x * w[:, None]) + 1e-6 * np.eye(x.shape[1])
            b = np.linalg.solve(a, (x * (w * w)[:, None]).T @ pdf["_label"].to_numpy(float))
            return pd.DataFrame({"query": [pdf["query"].iloc[0]], "prediction": [float(b[0])]})

        got = near.join(own, "query").groupBy("query").applyInPandas(fit, f"query {key}, prediction double")
        return df.join(got, F.col(self.id_col) == F.col("query"), "left").drop("query")


@classifier
class HoeffdingTreeClassifier(Classifier):
    """A tree grown batch by batch: each leaf keeps counts by class and quantile bin, and splits once the gain of the
    best column beats the second by the Hoeffding bound.  ``partial_fit`` adds a batch; counts come from one
    aggregate for all leaves, so batches of any size are fine."""

    defaults = {"grace_period": 200, "split_confidence": 1e-7, "tie_threshold": 0.05, "n_bins": 16, "max_leaves": 64}

    def fit(self, df, label=None, features=None):
        self._names(df, label, features)
        self.classes = classes_of(df, label)
        self.edges = {c: sorted(set(v))[1:-1] for c, v in ((c, df.approxQuantile(c, [i / self.n_bins for i in range(self.n_bins + 1)], 0.001)) for c in self.features)}
        self.leaves = [[]]
        self.counts: list[dict] = [{}]
        return self.partial_fit(df)

    def _leaf(self):
        out = F.lit(0)
        for i, cond in enumerate(self.leaves):
            hold = F.lit(True)
            for c, t, left in cond:
                x = F.coalesce(clean(c), F.lit(0.0))
                hold = hold & ((x <= F.lit(t)) if left else (x > F.lit(t)))
            out = F.when(hold, F.lit(i)).otherwise(out)
        return out

    def _bin(self, c):
        edges, x = self.edges[c], F.coalesce(clean(c), F.lit(0.0))
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)

    def partial_fit(self, df):
        bins = F.array(*[F.struct(F.lit(c).alias("f"), self._bin(c).alias("b")) for c in self.features])
        rows = df.where(F.col(self.label).isNotNull()).select(self._leaf().alias("l"), F.col(self.label).alias("y"), F.explode(bins).alias("x"))
        for r in rows.groupBy("l", "y", "x.f", "x.b").count().collect():
            k = (r["f"], r["b"], r["y"])
            self.counts[r["l"]][k] = self.counts[r["l"]].get(k, 0) + r["count"]
        for i in range(len(self.leaves)):
            self._maybe_split(i)
        return self

    def _matrix(self, i, c):
        m = np.zeros((len(self.edges[c]) + 1, len(self.classes)))
        for (f, b, y), n in self.counts[i].items():
            if f == c and y in self.classes:
                m[b, self.classes.index(y)] += n
        return m

    def _maybe_split(self, i):
        def h(n):
            p = n / max(n.sum(), 1)
            p = p[p > 0]
            return float(-(p * np.log2(p)).sum())

        gains = []
        for c in self.features:
            m = self._matrix(i, c)
            total = m.sum(axis=0)
            for b in range(len(self.edges[c])):
                lo, hi = m[: b + 1].sum(axis=0), m[b + 1 :].sum(axis=0)
                if lo.sum() and hi.sum():
                    gains.append((h(total) - (lo.sum() * h(lo) + hi.sum() * h(hi)) / total.sum(), c, b))
        n = sum(v for (f, _, _), v in self.counts[i].items() if f == self.features[0])
        if n < self.grace_period or not gains or len(self.leaves) >= self.max_leaves:
            return
        best = max(gains)
        second = max((g for g in gains if g[1] != best[1]), default=(0.0,))
        eps = math.sqrt(math.log2(max(len(self.classes), 2)) ** 2 * math.log(1 / self.split_confidence) / (2 * n))
        if best[0] > 0 and (best[0] - second[0] > eps or eps < self.tie_threshold):
            _, c, b = best
            # children start with the parent's votes on their side of the split, for prediction before new rows come
            m = self._matrix(i, c)
            t, cond = self.edges[c][b], self.leaves[i]
            self.leaves[i], self.counts[i] = [*cond, (c, t, True)], {(c, 0, y): v for y, v in zip(self.classes, m[: b + 1].sum(axis=0), strict=True)}
            self.leaves.append([*cond, (c, t, False)])
            self.counts.append({(c, len(self.edges[c]), y): v for y, v in zip(self.classes, m[b + 1 :].sum(axis=0), strict=True)})

    def predict(self, df):
        votes = []
        for counts in self.counts:
            n = {k: 0.0 for k in self.classes}
            for (_, _, y), v in counts.items():
                n[y] = n.get(y, 0) + v
            votes.append(max(self.classes, key=lambda k: n[k]))
        return df.withColumn("prediction", F.element_at(F.array(*map(F.lit, votes)), self._leaf() + 1))


# ---------------------------------------------------------------- further samplers


@sampler
class ClusterOverSampler(_Sampler):
    """Each smaller class is repeated to the largest, its k-means clusters in proportion to their sizes."""

    defaults = {"sampling_strategy": "auto", "n_clusters": 5, "random_state": None, "id_col": "row_id"}

    def transform(self, df):
        return repeat_rows(df, self._rates(self._over()), self.id_col, self.random_state or 0)


@sampler
class KMeansSMOTESampler(SMOTESampler):
    """New rows in clusters of the smaller class only: seeds of larger clusters weigh more."""

    defaults = SMOTESampler.defaults | {"n_clusters": None, "cluster_balance_threshold": 0.5}

    def _seeds(self, df, k):
        rows = self._pool(df, k)
        feats = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (self.y, self.id_col)]
        n = self.n_clusters or max(2, int(math.sqrt(self.sizes[k])))
        out = KMeansClusterer(n, n_init=1, random_state=self.random_state).fit(rows, None, feats).predict(rows)
        size = out.groupBy("prediction").agg((F.count(F.lit(1)) / F.lit(self.sizes[k])).alias("_share"))
        return out.join(F.broadcast(size), "prediction").drop("prediction")


@sampler
class SVMSMOTESampler(SMOTESampler):
    """Seeds are the smaller class's rows nearest to a linear separator."""

    defaults = SMOTESampler.defaults | {"svm_estimator": None}

    def _seeds(self, df, k):
        feats = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (self.y, self.id_col)]
        m = LogisticRegression(max_iter=30, ridge=1e-3).fit(df.withColumn("_one", (F.col(self.y) == F.lit(k)).cast("int")), "_one", feats)
        p = F.element_at("probability", 1)
        out = m.predict(self._pool(df, k)).withColumn("_d", F.abs(p - 0.5))
        cutoff = out.agg(F.percentile("_d", 0.5)).first()[0]
        return out.where(F.col("_d") <= cutoff).drop("_d", "probability", "prediction").withColumn("_share", F.lit(1.0))


@sampler
class HardnessThresholdSampler(_Sampler):
    """Of larger classes, the rows with the most certain out-of-fold chance of their own class."""

    defaults = {"estimator": None, "cv": 3, "sampling_strategy": "auto", "random_state": None, "id_col": "row_id"}

    def transform(self, df):
        from ..base import resolve
        from ..plans.splitting import HashKFold

        feats = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (self.y, self.id_col)]
        scored = None
        for train, test in HashKFold(self.cv, True, self.random_state, self.id_col).split(df):
            m = resolve(self.estimator or LogisticRegression(max_iter=20, ridge=1e-4)).fit(train, self.y, feats)
            part = m.predict_proba(test).select(F.col(self.id_col).alias("_k"), F.element_at("probability", F.col(self.y)).alias("_p"))
            scored = part if scored is None else scored.unionByName(part)
        least, out = min(self.sizes.values()), None
        for k in self.sizes:
            rows = df.where(F.col(self.y) == F.lit(k))
            if self.sizes[k] > least:
                keep = scored.join(rows.select(F.col(self.id_col).alias("_k")), "_k", "left_semi").orderBy(F.desc("_p"), "_k").limit(least).select(F.col("_k").alias(self.id_col))
                rows = rows.join(keep, self.id_col, "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out


@sampler
class CNNSampler(_Sampler):
    """Condensing: rows that the store misclassifies by 1-NN join it, in passes until none does."""

    defaults = {"n_neighbors": 1, "random_state": None, "id_col": "row_id", "max_passes": 10}

    def transform(self, df):
        from ..plans.graph import cut

        feats = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in (self.y, self.id_col)]
        h = F.xxhash64(F.lit(self.random_state or 0), F.col(self.id_col))
        first = df.groupBy(self.y).agg(F.min_by(self.id_col, h).alias("_k")).select(F.col("_k").alias(self.id_col))
        store = cut(first)
        for _ in range(self.max_passes):
            rest = df.join(store, self.id_col, "left_anti")
            near = knn_join(rest, df.join(store, self.id_col, "left_semi"), self.n_neighbors, feats, self.id_col, carry=[self.y])
            vote = near.groupBy("query").agg(F.mode(self.y, True).alias("_v"))
            wrong = cut(rest.join(vote, F.col(self.id_col) == F.col("query")).where(F.col("_v") != F.col(self.y)).select(self.id_col))
            if wrong.isEmpty():
                break
            store = cut(store.unionByName(wrong))
        return df.join(store, self.id_col, "left_semi")


def relief_f(df: DataFrame, features: list[str], y: str, n_neighbors: int = 10, id_col: str = "row_id") -> dict[str, float]:
    """Mean difference to the nearest rows of other classes less that to the nearest of the same, in shares of range."""
    r = one_row(df, [e for c in features for e in (F.min(clean(c)).alias(f"lo{c}"), F.max(clean(c)).alias(f"hi{c}"))])
    unit = df.select(id_col, y, *[((clean(c) - F.lit(r[f"lo{c}"])) / F.lit(((r[f"hi{c}"] or 0) - (r[f"lo{c}"] or 0)) or 1.0)).alias(c) for c in features])
    n = {k[0]: k["count"] for k in unit.groupBy(y).count().collect()}
    total, out = sum(n.values()), dict.fromkeys(features, 0.0)
    for a in n:
        own = unit.where(F.col(y) == F.lit(a))
        for b in n:
            near = knn_join(own, unit.where(F.col(y) == F.lit(b)), n_neighbors, features, id_col, "manhattan", exclude_self=True, carry=features)
            me = own.select(F.col(id_col).alias("query"), *[F.col(c).alias(f"_q_{c}") for c in features])
            d = near.join(me, "query").agg(*[F.avg(F.abs(F.col(c) - F.col(f"_q_{c}"))).alias(c) for c in features]).first().asDict()
            weight = -n[a] / total if a == b else n[a] / total * n[b] / max(total - n[a], 1)
            for c in features:
                out[c] += weight * (d[c] or 0.0)
    return out

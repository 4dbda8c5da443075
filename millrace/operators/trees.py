"""Trees grown level by level from histograms, their pruning, and model trees.

Columns are cut at quantiles once; a row keeps one byte a column.  A level is one aggregate over (node, column,
bin) of class weights or of ``n, sum(y), sum(y * y)``; running sums over the bins give every split's two sides,
and one row per open node, its best split, reaches the driver.  (A level of at most ``SMALL`` numbers, known before
it runs, comes as it is and is scored there, which saves two shuffles.)  So a fit costs a job a level whatever the number
of rows, nodes are never moved, and the driver holds the tree alone.  Rows find their leaf by walking constant
arrays in an expression whose size is that of the tree's depth and not of its number of nodes.

Missing values take no part in a split and go to the side with more rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Classifier, Regressor, classifier, clean, one_row, regressor
from .learners import classes_of

MISSING, MOST_BINS = 127, 120
#: Numbers in a level's histograms (open nodes x bins of all columns x statistics) that the driver scores itself.
SMALL = 400_000
#: Depth where none is given, and classes that a tree tells apart at most.
DEPTH, MOST_CLASSES = 12, 200


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def weight_of(stats: list, task: str):
    """Number of rows of a node: the sum of its classes, or the first number of a regression's three."""
    return sum(stats[1:], stats[0]) if task == "class" else stats[0]


def impurity(stats: list[Column], criterion: str) -> Column:
    """Rows times impurity: entropy, gini, squared_error (friedman_mse has the same gains) or sdr, the deviation."""
    n = weight_of(stats, "class" if criterion in ("entropy", "log_loss", "gain_ratio", "gini") else "value")
    if criterion == "gini":
        return F.when(n > 0, n - sum((s * s for s in stats[1:]), stats[0] * stats[0]) / n).otherwise(0.0)
    if criterion in ("entropy", "log_loss", "gain_ratio"):
        return _xlogx(n) - sum(map(_xlogx, stats[1:]), _xlogx(stats[0]))
    _, s, ss = stats
    if criterion in ("squared_error", "friedman_mse"):
        return F.when(n > 0, F.greatest(ss - s * s / n, F.lit(0.0))).otherwise(0.0)
    if criterion == "sdr":
        return F.sqrt(F.greatest(n * ss - s * s, F.lit(0.0)))
    raise ValueError(f"no criterion {criterion!r}")


def _array(values, kind: str = "int") -> str:
    return f"array({', '.join(f'{v!r}D' if kind == 'double' else str(v) for v in (float(v) if kind == 'double' else int(v) for v in values))})"


class Tree:
    """Nodes by number: children come after their parent, node 0 is the root, a leaf has feature -1."""

    def __init__(self, root: np.ndarray):
        self.feature, self.bin, self.threshold = [-1], [0], [0.0]
        self.left, self.right, self.missing = [0], [0], [0]
        self.depth, self.stats = [0], [np.asarray(root, float)]

    def split(self, node: int, feature: int, at: int, threshold: float, left: np.ndarray, right: np.ndarray, missing_left: bool) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        self.left[node], self.right[node], self.missing[node] = a, a + 1, a if missing_left else a + 1
        for stats in (left, right):
            for column, v in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.missing, 0), (self.depth, self.depth[node] + 1), (self.stats, stats)):
                column.append(v)
        return a, a + 1

    def route(self, values: str, by_bin: bool = False) -> Column:
        """The leaf of a row with the given array column of values (null: missing) or of bins."""
        x = f"get({values}, get({_array(self.feature)}, n))"
        absent, below = (f"{x} = {MISSING}", f"{x} <= get({_array(self.bin)}, n)") if by_bin else (f"{x} is null", f"{x} < get({_array(self.threshold, 'double')}, n)")
        step = f"if(get({_array(self.feature)}, n) < 0, n, if({absent}, get({_array(self.missing)}, n), if({below}, get({_array(self.left)}, n), get({_array(self.right)}, n))))"
        return F.expr(f"aggregate(sequence(1, {max(1, *self.depth) if len(self.depth) > 1 else 1}), 0, (n, i) -> {step})")

    def up(self, leaf_stats: dict[int, np.ndarray], width: int) -> list[np.ndarray]:
        """Sums of all nodes from those of the leaves."""
        out = [np.asarray(leaf_stats.get(i, np.zeros(width)), float) for i in range(len(self.feature))]
        for i in reversed(range(len(out))):
            if self.feature[i] >= 0:
                out[i] = out[self.left[i]] + out[self.right[i]]
        return out

    def prune(self, as_leaf, join=lambda a, b: a + b) -> None:
        """Bottom up: a node becomes a leaf where its cost as one is no more than the joint cost of its children."""
        cost = [0.0] * len(self.feature)
        for i in reversed(range(len(self.feature))):
            cost[i] = as_leaf(i)
            if self.feature[i] >= 0:
                below = join(cost[self.left[i]], cost[self.right[i]])
                if cost[i] <= below + 1e-9:
                    self.feature[i] = -1
                else:
                    cost[i] = below
        self.shake()

    def prune_by_complexity(self, alpha: float, cost) -> None:
        """Weakest links first: a branch goes while its gain for each leaf beyond one is ``alpha`` or less."""
        while True:
            total, leaves, worst = [0.0] * len(self.feature), [1] * len(self.feature), (math.inf, -1)
            for i in reversed(range(len(self.feature))):
                own = cost(i)
                total[i] = own
                if self.feature[i] >= 0:
                    a, b = self.left[i], self.right[i]
                    total[i], leaves[i] = total[a] + total[b], leaves[a] + leaves[b]
                    worst = min(worst, ((own - total[i]) / (leaves[i] - 1), i))
            if worst[0] > alpha:
                break
            self.feature[worst[1]] = -1
            self.shake()

    def shake(self) -> None:
        """Drop the nodes that no path from the root reaches any more."""
        keep = {0}
        for i in range(len(self.feature)):
            if i in keep and self.feature[i] >= 0:
                keep |= {self.left[i], self.right[i]}
        order = sorted(keep)
        new = {old: k for k, old in enumerate(order)}
        for name in ("feature", "bin", "threshold", "depth", "stats"):
            setattr(self, name, [getattr(self, name)[i] for i in order])
        for name in ("left", "right", "missing"):
            setattr(self, name, [new.get(getattr(self, name)[i], 0) if self.feature[new[i]] >= 0 else 0 for i in order])

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    def describe(self, features: list[str], value, node: int = 0) -> str:
        pad = "|   " * self.depth[node]
        if self.feature[node] < 0:
            return f"{pad}{value(node)}\n"
        name, t = features[self.feature[node]], self.threshold[node]
        return f"{pad}{name} < {t:.6g}\n{self.describe(features, value, self.left[node])}{pad}{name} >= {t:.6g}\n{self.describe(features, value, self.right[node])}"


def cuts_of(df: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """Borders of each column's bins in one job: its quantiles and greatest value."""
    shares = [i / max_bins for i in range(1, max_bins + 1)]
    got = one_row(df, [F.percentile_approx(clean(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)])
    return [sorted(set(got.get(f"q{i}") or ())) or [0.0] for i in range(len(features))]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], stats: list[Column]) -> DataFrame:
    """Of each row: ``b``, an array of one byte a column, and the statistics ``s0, s1, ...`` of its label."""
    rows = df.select(*[F.coalesce(clean(c), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(features)], *[s.cast("double").alias(f"s{i}") for i, s in enumerate(stats)])
    if features:
        ends = [[-math.inf, *c, math.inf] for c in cuts]
        rows = Bucketizer(splitsArray=ends, inputCols=[f"x{i}" for i in range(len(features))], outputCols=[f"b{i}" for i in range(len(features))], handleInvalid="keep").transform(rows)
    bins = [F.when(F.isnan(f"x{i}"), MISSING).otherwise(F.col(f"b{i}")).cast("byte") for i in range(len(features))]
    return rows.select(F.array(*bins).cast("array<tinyint>").alias("b"), *[f"s{i}" for i in range(len(stats))])


def _impure(stats: np.ndarray, criterion: str) -> np.ndarray:
    """:func:`impurity` over the last axis of an array."""
    if criterion in ("gini", "entropy", "log_loss", "gain_ratio"):
        n = stats.sum(axis=-1)
        if criterion == "gini":
            return n - (stats * stats).sum(axis=-1) / np.where(n > 0, n, 1)
        return _plogp(n) - _plogp(stats).sum(axis=-1)
    n, s, ss = np.moveaxis(stats, -1, 0)
    if criterion == "sdr":
        return np.sqrt(np.maximum(n * ss - s * s, 0))
    return np.maximum(ss - s * s / np.where(n > 0, n, 1), 0)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1))


def _score_here(cells: pd.DataFrame, width: int, task: str, criterion: str, min_leaf: float) -> list[dict]:
    """The best split of each node from the cells of a small level."""
    cells = cells[cells["bin"] < MISSING]
    nodes, at = np.unique(cells["node"], return_inverse=True)
    if not len(nodes):
        return []
    grid = np.zeros((len(nodes), cells["f"].max() + 1, cells["bin"].max() + 1, width))
    grid[at, cells["f"], cells["bin"]] = cells[[f"s{i}" for i in range(width)]]
    left = grid.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    nl, nr, n = ((x.sum(axis=-1) if task == "class" else x[..., 0]) for x in (left, right, total))
    gain = _impure(total, criterion) - _impure(left, criterion) - _impure(right, criterion)
    gain = np.where((nl >= min_leaf) & (nr >= min_leaf) & (nl > 0) & (nr > 0) & (gain > 1e-9), gain, -1.0)
    score = gain
    if criterion == "gain_ratio":
        bins = gain.argmax(axis=2)
        top = np.take_along_axis(gain, bins[..., None], 2)[..., 0]
        info = np.take_along_axis(_plogp(n) - _plogp(nl) - _plogp(nr), bins[..., None], 2)[..., 0]
        used = top > 0
        mean = np.where(used, top, 0).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
        ratio = np.where(used & (top >= mean[:, None] - 1e-9), top / np.maximum(info, 1e-12), -1.0)
        score = np.full(gain.shape, -1.0)
        np.put_along_axis(score, bins[..., None], ratio[..., None], 2)
    best = score.reshape(len(nodes), -1).argmax(axis=1)
    f, b = np.divmod(best, score.shape[2])
    k = np.arange(len(nodes))
    return [{"node": int(nodes[i]), "f": int(f[i]), "bin": int(b[i]), "gain": float(gain[i, f[i], b[i]]), "left": left[i, f[i], b[i]], "right": right[i, f[i], b[i]]} for i in k if score[i, f[i], b[i]] > 0]


def _best(rows: DataFrame, tree: Tree, is_open: list[bool], cuts: list[list[float]], width: int, task: str, criterion: str, min_leaf: float) -> list:
    """The best split of each open node, as one row."""
    s = [f"s{i}" for i in range(width)]
    at = rows.withColumn("node", tree.route("b", by_bin=True)).where(F.expr(f"get({_array(is_open)}, node) = 1"))
    cells = at.select("node", F.posexplode("b").alias("f", "bin"), *s).groupBy("node", "f", "bin").agg(*[F.sum(c).alias(c) for c in s])
    if sum(is_open) * sum(len(c) + 2 for c in cuts) * width <= SMALL:
        return _score_here(cells.toPandas(), width, task, criterion, min_leaf)
    whole = Window.partitionBy("node", "f")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = cells.select("node", "f", "bin", *[F.sum(c).over(so_far).alias(f"l{c}") for c in s], *[F.sum(F.when(F.col("bin") < MISSING, F.col(c)).otherwise(0.0)).over(whole).alias(f"t{c}") for c in s])
    left = [F.col(f"l{c}") for c in s]
    right = [F.col(f"t{c}") - F.col(f"l{c}") for c in s]
    total = [F.col(f"t{c}") for c in s]
    nl, nr, n = (weight_of(x, task) for x in (left, right, total))
    gain = impurity(total, criterion) - impurity(left, criterion) - impurity(right, criterion)
    found = sides.where(f"bin < {MISSING}").select("node", "f", "bin", gain.alias("gain"), (_xlogx(n) - _xlogx(nl) - _xlogx(nr)).alias("info"), nl.alias("nl"), nr.alias("nr"), F.array(*left).alias("left"), F.array(*right).alias("right"))
    found = found.where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf) & (F.col("gain") > 1e-9))
    if criterion == "gain_ratio":  # the best ratio among columns whose gain is no less than the average
        first = found.groupBy("node", "f").agg(F.max(F.struct("gain", (-F.col("bin")).alias("minus"), "bin", "info", "left", "right")).alias("best")).select("node", "f", "best.*")
        found = first.withColumn("mean", F.avg("gain").over(Window.partitionBy("node"))).where("gain >= mean - 1e-9").withColumn("score", F.expr("gain / greatest(info, 1e-12D)"))
    else:
        found = found.withColumn("score", F.col("gain"))
    best = F.max(F.struct("score", (-F.col("f")).alias("mf"), (-F.col("bin")).alias("mb"), "f", "bin", "gain", "left", "right")).alias("best")
    return found.groupBy("node").agg(best).select("node", "best.*").collect()


def _pure(stats: np.ndarray, task: str) -> bool:
    if task == "class":
        return np.count_nonzero(stats) <= 1
    n, s, ss = stats
    return n <= 0 or ss - s * s / n <= 1e-12 * max(1.0, abs(ss))


def grow(rows: DataFrame, cuts: list[list[float]], width: int, task: str, criterion: str, max_depth: int | None = None, min_leaf: float = 1, min_split: float = 2, min_gain: float = 0.0, stop=lambda stats: False) -> Tree:
    """A tree over :func:`binned` rows.  ``min_gain`` is of impurity in a share of all rows; ``stop`` tells of
    a node's statistics whether it stays a leaf.  An empty table gives a single leaf."""
    root = rows.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(width)]).first()
    tree = Tree(np.array(root, float))
    n_all = float(weight_of(list(tree.stats[0]), task))
    waiting = {0}
    for _ in range(DEPTH if max_depth is None or max_depth < 0 else min(max_depth, 30)):
        waiting = {i for i in waiting if weight_of(list(tree.stats[i]), task) >= min_split and not _pure(tree.stats[i], task) and not stop(tree.stats[i])}
        if not waiting or not cuts:
            break
        found = _best(rows, tree, [i in waiting for i in range(len(tree.feature))], cuts, width, task, criterion, min_leaf)
        waiting = set()
        for r in sorted(found, key=lambda r: r["node"]):
            if r["gain"] < min_gain * n_all:
                continue
            left, right = np.array(r["left"]), np.array(r["right"])
            absent = np.maximum(tree.stats[r["node"]] - left - right, 0) if task == "class" else tree.stats[r["node"]] - left - right
            to_left = weight_of(list(left), task) >= weight_of(list(right), task)
            left, right = (left + absent, right) if to_left else (left, right + absent)
            waiting |= set(tree.split(r["node"], r["f"], r["bin"], cuts[r["f"]][r["bin"]], left, right, bool(to_left)))
    return tree


def upper_errors(errors: float, n: float, confidence: float = 0.25) -> float:
    """Errors to expect in ``n`` rows at the upper end of a one-sided confidence interval, by Wilson's bound; exact where none was seen."""
    if n <= 0:
        return 0.0
    if errors <= 0:
        return n * (1 - confidence ** (1 / n))
    z = NormalDist().inv_cdf(1 - confidence)
    p = min(1.0, errors / n)
    return n * min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


class _Grown:
    """What the tree learners share: fitting with an optional weight column, walking and leaf values."""

    criterion, task = "entropy", "class"

    def _stats(self, df, weight) -> list[Column]:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
        if self.task == "class":
            return [F.when(F.col(self.label) == F.lit(k), w).otherwise(0.0) for k in self.classes]
        y = clean(self.label) - F.lit(self.center)
        return [w, w * y, w * y * y]

    def _prepare(self, df, label, features, weight):
        self._names(df, label, features)
        if self.task == "class":
            self.classes = classes_of(df, label, MOST_CLASSES)
            rows = df.where(F.col(label).isNotNull())
        else:
            rows = df.where(clean(label).isNotNull())
            self.center = float(one_row(rows, [F.avg(clean(label)).alias("m")])["m"] or 0.0)
        self.width = len(self.classes) if self.task == "class" else 3
        bins = min(getattr(self, "max_bins", 64), MOST_BINS)
        self.cuts = cuts_of(rows, self.features, bins)
        return rows, self._stats(rows, weight)

    def _grow_on(self, rows: DataFrame, stats: list[Column], **kw) -> Tree:
        if self.width == 0:
            return Tree(np.zeros(0))
        table = binned(rows, self.features, self.cuts, stats).persist()
        try:
            return grow(table, self.cuts, self.width, self.task, self.criterion, **kw)
        finally:
            table.unpersist()

    def _errors(self, node: int) -> float:
        """Rows that the node would get wrong as a leaf, or its squared error."""
        s = self.tree.stats[node]
        if self.task == "class":
            return float(s.sum() - s.max()) if len(s) else 0.0
        return float(max(0.0, s[2] - s[1] ** 2 / s[0])) if s[0] > 0 else 0.0

    def _leaf(self, df: DataFrame) -> DataFrame:
        x = F.array(*[clean(c) for c in self.features]) if self.features else F.array().cast("array<double>")
        return df.withColumn("_x", x).withColumn("_leaf", self.tree.route("_x"))

    def describe(self) -> str:
        return self.tree.describe(self.features, lambda i: self.classes[int(self.tree.stats[i].argmax())] if self.task == "class" else f"{self._value(i):.6g}")

    def _value(self, node: int) -> float:
        n, s, _ = self.tree.stats[node]
        return self.center + (s / n if n > 0 else 0.0)

    def fit(self, df, label=None, features=None):
        return self._fit_ml(df, label, features)

    def predict(self, df):
        if self.task != "class":
            values = _array([self._value(i) for i in range(len(self.tree.feature))], "double")
            return self._leaf(df).withColumn("prediction", F.expr(f"get({values}, _leaf)")).drop("_x", "_leaf")
        if not self.classes:
            return df.withColumn("prediction", F.lit(None).cast("string"))
        names, out = F.array(*map(F.lit, self.classes)), self._leaf(df)
        best = _array([int(s.argmax()) for s in self.tree.stats])
        out = out.withColumn("prediction", F.get(names, F.expr(f"get({best}, _leaf)")))
        if "probability" not in df.columns:
            shares = ", ".join(_array(s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s)), "double") for s in self.tree.stats)
            out = out.withColumn("probability", F.map_from_arrays(names, F.expr(f"get(array({shares}), _leaf)")))
        return out.drop("_x", "_leaf")


@classifier
class C45TreeClassifier(_Grown, Classifier):
    """Gain-ratio splits among columns of at least average gain, then pessimistic pruning: a branch becomes a leaf
    where the upper confidence limit of its errors as one is no more than that of its leaves together."""

    defaults = {"min_samples_leaf": 2, "confidence_factor": 0.25, "unpruned": False, "max_depth": None, "max_bins": 64, "random_state": None}
    criterion = "gain_ratio"

    def _fit_ml(self, df, label, features, weight=None):
        rows, stats = self._prepare(df, label, features, weight)
        self.tree = self._grow_on(rows, stats, max_depth=self.max_depth, min_leaf=self.min_samples_leaf, min_split=2 * self.min_samples_leaf)
        if not self.unpruned:
            self.tree.prune(lambda i: upper_errors(self._errors(i), float(self.tree.stats[i].sum()), self.confidence_factor))
        return self


class _ReducedError(_Grown):
    """Grows on all but one of ``num_folds`` parts and prunes where the part left out is no worse off.  Rows fall
    into parts by a seeded hash of their columns and label, so equal rows stay together."""

    def _fit_rep(self, df, label, features, weight, folds, prune, **kw):
        rows, stats = self._prepare(df, label, features, weight)
        if not prune or folds < 2:
            self.tree = self._grow_on(rows, stats, **kw)
            return self
        part = F.pmod(F.xxhash64(F.lit(int(self.get_params().get("random_state") or 0)), *[clean(c) for c in self.features], F.col(label)), F.lit(folds)) == 0
        self.tree = self._grow_on(rows.where(~part), stats, **kw)
        sums = self._leaf(rows.where(part)).groupBy("_leaf").agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(stats)]).collect() if self.width else []
        held = self.tree.up({r["_leaf"]: np.array(r[1:], float) for r in sums}, self.width)

        def cost(i: int) -> float:
            s, own = held[i], self.tree.stats[i]
            if self.task == "class":
                return float(s.sum() - s[int(own.argmax())]) if len(s) else 0.0
            m = own[1] / own[0] if own[0] > 0 else 0.0
            return float(s[2] - 2 * m * s[1] + m * m * s[0])

        self.tree.prune(cost)
        return self


@regressor
class C45TreeRegressor(_ReducedError, Regressor):
    """Variance splits with reduced-error pruning on a third of the rows."""

    defaults = {"min_samples_leaf": 2, "max_depth": None, "unpruned": False, "max_bins": 64, "random_state": None}
    criterion, task = "squared_error", "value"

    def _fit_ml(self, df, label, features, weight=None):
        return self._fit_rep(df, label, features, weight, 3, not self.unpruned, max_depth=self.max_depth, min_leaf=self.min_samples_leaf, min_split=2 * self.min_samples_leaf)


_REP = {"max_depth": -1, "min_samples_leaf": 2, "min_variance_prop": 1e-3, "num_folds": 3, "no_pruning": False, "random_state": None, "max_bins": 64}


@classifier
class ReducedErrorPruningTreeClassifier(_ReducedError, Classifier):
    """Entropy splits with reduced-error pruning on one of ``num_folds`` parts."""

    defaults = _REP

    def _fit_ml(self, df, label, features, weight=None):
        return self._fit_rep(df, label, features, weight, self.num_folds, not self.no_pruning, max_depth=self.max_depth, min_leaf=self.min_samples_leaf, min_split=2 * self.min_samples_leaf)


@regressor
class ReducedErrorPruningTreeRegressor(_ReducedError, Regressor):
    """Variance splits, down to ``min_variance_prop`` of the variance of all rows, with reduced-error pruning."""

    defaults = _REP
    criterion, task = "squared_error", "value"

    def _fit_ml(self, df, label, features, weight=None):
        self.floor = None

        def small(s: np.ndarray) -> bool:
            v = s[2] / s[0] - (s[1] / s[0]) ** 2
            self.floor = v * self.min_variance_prop if self.floor is None else self.floor
            return v <= self.floor

        return self._fit_rep(df, label, features, weight, self.num_folds, not self.no_pruning, max_depth=self.max_depth, min_leaf=self.min_samples_leaf, min_split=2 * self.min_samples_leaf, stop=small)


@regressor
class M5ModelTreeRegressor(_Grown, Regressor):
    """Splits by reduction of the standard deviation; every node has a ridge model, all from one aggregate of
    products per leaf.  A branch is pruned where the node's own error times (n + p) / (n - p) is no more than its
    leaves' weighted error, and a leaf's model is smoothed with its parent's by (n * own + 15 * parent) / (n + 15).
    Missing values of a linear form count as the mean."""

    defaults = {"min_samples_leaf": 4, "unpruned": False, "use_unsmoothed": False, "build_regression_tree": False, "max_depth": None, "max_bins": 64, "ridge": 1.0}
    criterion, task = "sdr", "value"

    def _fit_ml(self, df, label, features, weight=None):
        rows, stats = self._prepare(df, label, features, weight)
        floor: list[float] = []

        def flat(s: np.ndarray) -> bool:
            d = math.sqrt(max(0.0, s[2] / s[0] - (s[1] / s[0]) ** 2))
            floor.append(d)
            return d < 0.05 * floor[0]

        self.tree = self._grow_on(rows, stats, max_depth=self.max_depth, min_leaf=self.min_samples_leaf, min_split=2 * self.min_samples_leaf, stop=flat)
        self.means = [float(v or 0.0) for v in one_row(rows, [F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(self.features)]).values()]
        d = 0 if self.build_regression_tree else len(self.features)
        z = [F.lit(1.0), *[F.coalesce(clean(c) - F.lit(m), F.lit(0.0)) for c, m in zip(self.features[:d], self.means[:d], strict=True)], clean(label) - F.lit(self.center)]
        pairs = [(i, j) for i in range(d + 2) for j in range(i, d + 2)]
        wide = self._leaf(rows).select("_leaf", stats[0].alias("_w"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        sums = wide.groupBy("_leaf").agg(*[F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()
        gram = self.tree.up({r["_leaf"]: np.array(r[1:], float) for r in sums}, len(pairs))
        penalty = np.diag([0.0, *[self.ridge] * d])
        models, errors = [], []
        for flat_sums in gram:
            m = np.zeros((d + 2, d + 2))
            for (i, j), v in zip(pairs, flat_sums, strict=True):
                m[i, j] = m[j, i] = v
            a, b, n = m[:-1, :-1], m[:-1, -1], m[0, 0]
            coef = np.linalg.lstsq(a + penalty, b, rcond=None)[0] if n > 0 else np.zeros(d + 1)
            models.append(coef)
            errors.append((math.sqrt(max(0.0, m[-1, -1] - 2 * coef @ b + coef @ a @ coef) / n) if n > 0 else 0.0, n))
        parent = {}
        for i, f in enumerate(self.tree.feature):
            if f >= 0:
                parent[self.tree.left[i]] = parent[self.tree.right[i]] = i
        if not self.use_unsmoothed:
            smooth = [(errors[i][1] * models[i] + 15 * models[parent[i]]) / (errors[i][1] + 15) if i in parent else models[i] for i in range(len(models))]
        else:
            smooth = models
        p = d + 1
        labels = list(range(len(models)))
        if not self.unpruned:
            kept = self.tree.stats
            self.tree.stats = [np.r_[s, k] for s, k in zip(kept, labels, strict=True)]
            self.tree.prune(lambda i: errors[i][0] * errors[i][1] * ((errors[i][1] + p) / (errors[i][1] - p) if errors[i][1] > p else 10.0))
            labels = [int(s[-1]) for s in self.tree.stats]
            self.tree.stats = [s[:-1] for s in self.tree.stats]
        self.models = [smooth[k] for k in labels]
        return self

    def predict(self, df):
        out, d = self._leaf(df), len(self.models[0]) - 1
        names = self.features[:d]
        bias = [self.center + c[0] - float(c[1:] @ np.array(self.means[:d])) for c in self.models]
        form = f"get({_array(bias, 'double')}, _leaf)"
        if d:
            x = F.array(*[F.coalesce(clean(c), F.lit(m)) for c, m in zip(names, self.means, strict=False)])
            out = out.withColumn("_x", x)
            weights = f"get(array({', '.join(_array(c[1:], 'double') for c in self.models)}), _leaf)"
            form = f"aggregate(zip_with(_x, {weights}, (a, b) -> a * b), {form}, (s, v) -> s + v)"
        return out.withColumn("prediction", F.expr(form)).drop("_x", "_leaf")

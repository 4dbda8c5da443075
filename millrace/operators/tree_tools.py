"""Exact trees on blocks of rows that fit in a task, and their description, pruning and flat form.

:mod:`.trees` grows one tree over a whole table from histograms.  Here every midpoint is tried, which needs the rows
in memory: :func:`fit_trees` grows one such tree for each group of a table, in parallel, and :func:`tree_column` turns a
flat tree into an expression, so predictions stay in the JVM.  Missing values go to the side with more rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import _array


@dataclass
class TreeNode:
    """An inner node sends rows with ``x[feature] <= threshold`` to the left.  ``value``: class shares, or the mean."""

    value: np.ndarray
    n: int
    impurity: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: TreeNode | None = None
    right: TreeNode | None = None

    @property
    def is_leaf(self) -> bool:
        return self.left is None

    def make_leaf(self) -> None:
        self.feature, self.left, self.right = -1, None, None


@dataclass
class FlattenedTree:
    """Arrays by node number; a leaf has feature -1.  ``missing`` is the child of rows without a value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing: np.ndarray
    value: np.ndarray


@dataclass
class TreeConfig:
    criterion: str = "gini"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_impurity_decrease: float = 0.0
    max_features: int | float | str | None = None
    n_classes: int = 0
    extra: dict = field(default_factory=dict)


# ---------------------------------------------------------------- criteria


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1e-300)


def _class_impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    p = _shares(np.asarray(counts, float))
    if criterion == "gini":
        return 1 - (p * p).sum(axis=-1)
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0.0).sum(axis=-1)


def classifier_node_impurity(y, criterion: str = "gini", n_classes: int | None = None) -> float:
    y = np.asarray(y, int)
    return float(_class_impurity(np.bincount(y, minlength=n_classes or 0), criterion)) if len(y) else 0.0


def squared_error(y) -> float:
    return float(np.var(y)) if len(y) else 0.0


def friedman_mse(y) -> float:
    """Of a node alone, its variance; splits differ only by how they weigh both sides' means."""
    return squared_error(y)


def absolute_error(y) -> float:
    return float(np.abs(np.asarray(y, float) - np.median(y)).mean()) if len(y) else 0.0


def sdr(y) -> float:
    return math.sqrt(squared_error(y))


_NODE = {"squared_error": squared_error, "mse": squared_error, "friedman_mse": friedman_mse, "absolute_error": absolute_error, "mae": absolute_error, "sdr": sdr}


def regressor_node_impurity(y, criterion: str = "squared_error") -> float:
    return _NODE[criterion](np.asarray(y, float))


def gain_ratio_score(parent_entropy: float, child_entropies, child_sizes, n_total: float) -> float:
    """Information gain over the entropy of the split itself; 0 where that is 0."""
    w = np.asarray(child_sizes, float) / max(n_total, 1e-300)
    info = -(w[w > 0] * np.log2(w[w > 0])).sum()
    return float((parent_entropy - (w * np.asarray(child_entropies, float)).sum()) / info) if info > 0 else 0.0


def compute_max_features(max_features, n_features: int) -> int:
    """How many columns a split sees: sqrt, log2, a count, a share, or all."""
    if max_features is None:
        return n_features
    n = {"sqrt": math.sqrt(n_features), "auto": math.sqrt(n_features), "log2": math.log2(max(n_features, 2))}.get(max_features, max_features)
    n = n * n_features if isinstance(max_features, float) else n
    return int(min(max(1, int(n)), n_features))


# ---------------------------------------------------------------- splits


def _columns(d: int, rng, max_features) -> np.ndarray:
    k = compute_max_features(max_features, d)
    return np.arange(d) if k == d or rng is None else np.sort(rng.permutation(d)[:k])


def _best(X: np.ndarray, stats: np.ndarray, cost, total_cost: float, min_leaf: float, columns) -> tuple[int, float, float]:
    """Feature, threshold and gain of the best midpoint.  ``stats``: a row's additive numbers, the first its weight;
    ``cost`` of sums of them is weight times impurity."""
    best = (-1, 0.0, 0.0)
    for j in columns:
        x = X[:, j]
        use = np.flatnonzero(~np.isnan(x))
        order = use[np.argsort(x[use], kind="stable")]
        v, cum = x[order], stats[order].cumsum(axis=0)
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        low, all_ = cum[at], cum[-1]
        high = all_ - low
        gain = (cost(all_[None])[0] if len(use) < len(x) else total_cost) - cost(low) - cost(high)
        gain[(low[:, 0] < min_leaf) | (high[:, 0] < min_leaf)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best[2] + 1e-12:
            best = (int(j), float((v[at[k]] + v[at[k] + 1]) / 2), float(gain[k]))
    return best


def _class_stats(y: np.ndarray, n_classes: int, weight=None) -> np.ndarray:
    one = np.zeros((len(y), n_classes + 1))
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    one[np.arange(len(y)), y + 1] = w
    one[:, 0] = w
    return one


def _class_cost(criterion: str):
    return lambda s: s[:, 0] * _class_impurity(s[:, 1:], "entropy" if criterion in ("entropy", "gain_ratio", "log_loss") else criterion)


def best_split_classifier(X, y, criterion: str = "gini", n_classes: int | None = None, min_samples_leaf: int = 1, rng=None, max_features=None) -> tuple[int, float, float]:
    """(feature, threshold, decrease of the impurity); feature -1 where nothing helps."""
    X, y = np.asarray(X, float), np.asarray(y, int)
    k = n_classes or int(y.max(initial=0)) + 1
    s, cost = _class_stats(y, k), _class_cost(criterion)
    j, t, g = _best(X, s, cost, float(cost(s.sum(axis=0)[None])[0]), min_samples_leaf, _columns(X.shape[1], rng, max_features))
    return j, t, g / max(len(y), 1)


def _value_cost(s: np.ndarray) -> np.ndarray:
    return s[:, 2] - s[:, 1] ** 2 / np.maximum(s[:, 0], 1e-300)


def _deviation_cost(s: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(s[:, 0] * s[:, 2] - s[:, 1] ** 2, 0))


def best_split_regressor(X, y, criterion: str = "squared_error", min_samples_leaf: int = 1, rng=None, max_features=None) -> tuple[int, float, float]:
    """(feature, threshold, decrease of the impurity).  absolute_error chooses the split by medians, one midpoint at a
    time."""
    X, y = np.asarray(X, float), np.asarray(y, float)
    columns = _columns(X.shape[1], rng, max_features)
    if criterion in ("absolute_error", "mae"):
        best = (-1, 0.0, 0.0)
        whole = absolute_error(y) * len(y)
        for j in columns:
            x = X[:, j]
            v = np.unique(x[~np.isnan(x)])
            for t in (v[1:] + v[:-1]) / 2:
                low, high = y[x <= t], y[x > t]
                if min(len(low), len(high)) >= min_samples_leaf:
                    gain = whole - absolute_error(low) * len(low) - absolute_error(high) * len(high)
                    best = max(best, (int(j), float(t), float(gain)), key=lambda b: b[2])
        return best[0], best[1], best[2] / max(len(y), 1)
    s = np.stack([np.ones(len(y)), y, y * y], axis=1)
    cost = _deviation_cost if criterion == "sdr" else _value_cost
    j, t, g = _best(X, s, cost, float(cost(s.sum(axis=0)[None])[0]), min_samples_leaf, columns)
    return j, t, g / max(len(y), 1)


def best_split_stump(X, y, sample_weight=None) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(feature, threshold, class weights on the left, on the right) of the split with the least weighted error."""
    X, y = np.asarray(X, float), np.asarray(y, int)
    k = int(y.max(initial=0)) + 1
    s = _class_stats(y, k, sample_weight)
    cost = lambda z: z[:, 0] - z[:, 1:].max(axis=1)
    j, t, _ = _best(X, s, cost, float(cost(s.sum(axis=0)[None])[0]), 0, range(X.shape[1]))
    low = X[:, j] <= t if j >= 0 else np.ones(len(y), bool)
    return j, t, s[low, 1:].sum(axis=0), s[~low, 1:].sum(axis=0)


# ---------------------------------------------------------------- growing


def _grow(X, target, value_of, impurity_of, split, config: TreeConfig, depth: int) -> TreeNode:
    node = TreeNode(value_of(target), len(target), impurity_of(target))
    if node.impurity <= 1e-12 or len(target) < config.min_samples_split or (config.max_depth is not None and depth >= config.max_depth):
        return node
    j, t, gain = split(X, target)
    if j < 0 or gain <= config.min_impurity_decrease:
        return node
    x = X[:, j]
    low = x <= t
    missing = np.isnan(x)
    if missing.any():
        low = np.where(missing, low.sum() >= (~low & ~missing).sum(), low)
    node.feature, node.threshold = j, t
    node.left, node.right = (_grow(X[m], target[m], value_of, impurity_of, split, config, depth + 1) for m in (low, ~low))
    return node


def build_classifier_tree(X, y, config: TreeConfig, rng=None, depth: int = 0) -> TreeNode:
    """``y``: class numbers from 0."""
    X, y = np.asarray(X, float), np.asarray(y, int)
    k = config.n_classes or int(y.max(initial=0)) + 1
    return _grow(X, y, lambda t: _shares(np.bincount(t, minlength=k).astype(float)), lambda t: classifier_node_impurity(t, config.criterion, k), lambda a, b: best_split_classifier(a, b, config.criterion, k, config.min_samples_leaf, rng, config.max_features), config, depth)


def build_regressor_tree(X, y, config: TreeConfig, rng=None, depth: int = 0) -> TreeNode:
    X, y = np.asarray(X, float), np.asarray(y, float)
    criterion = config.criterion if config.criterion in _NODE else "squared_error"
    middle = np.median if criterion in ("absolute_error", "mae") else np.mean
    return _grow(X, y, lambda t: np.array([middle(t) if len(t) else 0.0]), lambda t: regressor_node_impurity(t, criterion), lambda a, b: best_split_regressor(a, b, criterion, config.min_samples_leaf, rng, config.max_features), config, depth)


# ---------------------------------------------------------------- walking and pruning


def count_nodes(node: TreeNode | None) -> int:
    return 0 if node is None else 1 if node.is_leaf else 1 + count_nodes(node.left) + count_nodes(node.right)


def max_depth_of(node: TreeNode | None) -> int:
    return 0 if node is None or node.is_leaf else 1 + max(max_depth_of(node.left), max_depth_of(node.right))


def _leaves(node: TreeNode) -> list[TreeNode]:
    return [node] if node.is_leaf else _leaves(node.left) + _leaves(node.right)


def _low(node: TreeNode, X: np.ndarray) -> np.ndarray:
    x = X[:, node.feature]
    return np.where(np.isnan(x), node.left.n >= node.right.n, x <= node.threshold)


def cost_complexity_prune(node: TreeNode, ccp_alpha: float) -> TreeNode:
    """Weakest links first: a branch becomes a leaf while its gain for each further leaf is ``ccp_alpha`` or less.
    Costs are impurities weighed by the share of all rows."""
    total = max(node.n, 1)

    def weakest(k: TreeNode) -> tuple[float, TreeNode | None]:
        if k.is_leaf:
            return math.inf, None
        ends = _leaves(k)
        own = ((k.n * k.impurity - sum(e.n * e.impurity for e in ends)) / total / (len(ends) - 1), k)
        return min((own, weakest(k.left), weakest(k.right)), key=lambda p: p[0])

    while True:
        gain, k = weakest(node)
        if k is None or gain > ccp_alpha:
            return node
        k.make_leaf()


def _reduce(node: TreeNode, X: np.ndarray, y: np.ndarray, error) -> float:
    """Error of the pruned branch on the rows given."""
    own = error(node, y)
    if node.is_leaf:
        return own
    low = _low(node, X)
    below = _reduce(node.left, X[low], y[low], error) + _reduce(node.right, X[~low], y[~low], error)
    if own <= below:
        node.make_leaf()
        return own
    return below


def reduced_error_prune_classifier(node: TreeNode, X_val, y_val, classes=None) -> TreeNode:
    """Bottom up: a branch goes where the leaf in its place errs no more on the rows held out."""
    _reduce(node, np.asarray(X_val, float), np.asarray(y_val, int), lambda k, y: float((y != int(k.value.argmax())).sum()))
    return node


def reduced_error_prune_regressor(node: TreeNode, X_val, y_val) -> TreeNode:
    _reduce(node, np.asarray(X_val, float), np.asarray(y_val, float), lambda k, y: float(((y - k.value[0]) ** 2).sum()))
    return node


def pessimistic_prune(node: TreeNode, X, y, confidence_factor: float = 0.25, classes=None) -> TreeNode:
    """Bottom up: a branch goes where the leaf errs no more than the branch and a share ``confidence_factor`` of the
    rows that reach it."""
    X, y = np.asarray(X, float), np.asarray(y, int)

    def run(k: TreeNode, X, y) -> float:
        own = float((y != int(k.value.argmax())).sum())
        if k.is_leaf:
            return own
        low = _low(k, X)
        below = run(k.left, X[low], y[low]) + run(k.right, X[~low], y[~low])
        if own <= below + confidence_factor * len(y):
            k.make_leaf()
            return own
        return below

    run(node, X, y)
    return node


# ---------------------------------------------------------------- flat trees


def flatten_tree(root: TreeNode, value_width: int | None = None) -> FlattenedTree:
    """Parents before their children."""
    nodes, kids = [root], []
    for k in nodes:
        kids.append((len(nodes), len(nodes) + 1) if not k.is_leaf else (0, 0))
        if not k.is_leaf:
            nodes += [k.left, k.right]
    width = value_width or len(root.value)
    value = np.zeros((len(nodes), width))
    for i, k in enumerate(nodes):
        value[i, : len(k.value)] = k.value
    left, right = (np.array([c[s] for c in kids]) for s in (0, 1))
    missing = np.array([0 if k.is_leaf else c[0] if k.left.n >= k.right.n else c[1] for k, c in zip(nodes, kids, strict=True)])
    return FlattenedTree(np.array([k.feature for k in nodes]), np.array([k.threshold for k in nodes], float), left, right, missing, value)


def _leaf_of(flat: FlattenedTree, X: np.ndarray) -> np.ndarray:
    at = np.zeros(len(X), np.int64)
    while True:
        inner = np.flatnonzero(flat.feature[at] >= 0)
        if not len(inner):
            return at
        k = at[inner]
        x = X[inner, flat.feature[k]]
        at[inner] = np.where(np.isnan(x), flat.missing[k], np.where(x <= flat.threshold[k], flat.left[k], flat.right[k]))


def predict_proba_batch(flat_tree: FlattenedTree, X) -> np.ndarray:
    return flat_tree.value[_leaf_of(flat_tree, np.asarray(X, float))]


def predict_batch(flat_tree: FlattenedTree, X) -> np.ndarray:
    """Class numbers, or means where the tree has one value a leaf."""
    v = predict_proba_batch(flat_tree, X)
    return v[:, 0] if v.shape[1] == 1 else v.argmax(axis=1)


def predict_proba_single_numpy(node: TreeNode, x, n_classes: int | None = None) -> np.ndarray:
    while not node.is_leaf:
        v = x[node.feature]
        node = (node.left if node.left.n >= node.right.n else node.right) if np.isnan(v) else node.left if v <= node.threshold else node.right
    return node.value[:n_classes]


def predict_single_numpy(node: TreeNode, x):
    v = predict_proba_single_numpy(node, x)
    return float(v[0]) if len(v) == 1 else int(v.argmax())


def get_tree_description(node: TreeNode, classes=None, depth: int = 0, task: str = "classification", names=None) -> str:
    """One line a node, indented by depth."""
    pad = "|   " * depth
    if node.is_leaf:
        k = int(node.value.argmax())
        return f"{pad}-> {classes[k] if classes is not None else k} ({node.n})" if task == "classification" else f"{pad}-> {node.value[0]:.6g} ({node.n})"
    name = names[node.feature] if names else f"x[{node.feature}]"
    parts = [(f"{name} <= {node.threshold:.6g}", node.left), (f"{name} > {node.threshold:.6g}", node.right)]
    return "\n".join(f"{pad}{text}\n{get_tree_description(kid, classes, depth + 1, task, names)}" for text, kid in parts)


# ---------------------------------------------------------------- on DataFrames


def tree_column(flat: FlattenedTree, features: list[str], k: int = 0) -> Column:
    """The k-th value of a row's leaf as an expression over numeric columns, of the size of the tree's depth."""
    values = "array(" + ", ".join(f"if(isnan(cast(`{c}` as double)), null, cast(`{c}` as double))" for c in features) + ")"
    x, feature = f"get({values}, get({_array(flat.feature)}, n))", f"get({_array(flat.feature)}, n)"
    step = f"if({feature} < 0, n, if({x} is null, get({_array(flat.missing)}, n), if({x} <= get({_array(flat.threshold, 'double')}, n), get({_array(flat.left)}, n), get({_array(flat.right)}, n))))"
    depth = np.zeros(len(flat.feature), int)
    for i in np.flatnonzero(flat.feature >= 0):
        depth[flat.left[i]] = depth[flat.right[i]] = depth[i] + 1
    leaf = f"aggregate(sequence(1, {max(1, int(depth.max()))}), 0, (n, i) -> {step})"
    return F.expr(f"get({_array(flat.value[:, k], 'double')}, {leaf})")


def fit_trees(df: DataFrame, group: str, features: list[str], label: str, config: TreeConfig, task: str = "value") -> DataFrame:
    """``group, nodes, depth, description``: an exact tree for each group, grown in one task a group, so a group must
    fit in memory.  ``task``: value, or class for labels that are class numbers."""
    build = build_classifier_tree if task == "class" else build_regressor_tree

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf["_y"].notna()]
        root = build(rows[features].to_numpy(float), rows["_y"].to_numpy(float), config) if len(rows) else TreeNode(np.zeros(1), 0)
        text = get_tree_description(root, task="classification" if task == "class" else "value", names=features)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "nodes": [count_nodes(root)], "depth": [max_depth_of(root)], "description": [text]})

    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("group"), *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"))
    return rows.groupBy("group").applyInPandas(run, f"group {kind}, nodes int, depth int, description string")

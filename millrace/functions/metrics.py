"""Metrics as aggregates.

Classification and clustering-agreement metrics come from one ``groupBy`` of label pairs, whose result is of the
order of classes squared; regression metrics are sums of one pass; curves are running totals over distinct scores.
Every function takes ``(df, true column, predicted column)``.
"""

from __future__ import annotations

import math
from enum import Enum
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Params, clean

# ---------------------------------------------------------------- pairs of labels


def pair_counts(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None) -> DataFrame:
    """``true, pred, n``: the sparse contingency table."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(y_true).isNotNull()).groupBy(F.col(y_true).alias("true"), F.col(y_pred).alias("pred")).agg(n.alias("n"))


class _Table:
    def __init__(self, df, y_true, y_pred, weight=None, labels=None):
        rows = [(r["true"], r["pred"], float(r["n"])) for r in pair_counts(df, y_true, y_pred, weight).collect()]
        key = lambda v: (v is None, v)
        self.true = sorted({r[0] for r in rows}, key=key)
        self.labels = list(labels) if labels is not None else sorted({v for r in rows for v in r[:2]}, key=key)
        at = {v: i for i, v in enumerate(self.labels)}
        self.m = np.zeros((len(self.labels), len(self.labels)))
        for t, p, n in rows:
            if t in at and p in at:
                self.m[at[t], at[p]] += n
        self.total = sum(r[2] for r in rows)

    def one(self, pos):
        i = self.labels.index(pos) if pos in self.labels else None
        if i is None:
            return 0.0, 0.0, 0.0, self.m.sum()
        tp = self.m[i, i]
        fp, fn = self.m[:, i].sum() - tp, self.m[i].sum() - tp
        return tp, fp, fn, self.m.sum() - tp - fp - fn


def _div(a: float, b: float, other: float = 0.0) -> float:
    return float(a / b) if b else other


safe_divide = _div


class MetricType(Enum):
    CLASSIFICATION = "classification"
    REGRESSION = "regression"
    CLUSTERING = "clustering"


class AverageType(Enum):
    BINARY = "binary"
    MICRO = "micro"
    MACRO = "macro"
    WEIGHTED = "weighted"
    NONE = "none"


class Metric(Params):
    """A metric as an object: ``compute(df, y_true, y_pred)``, which calling it does too."""

    metric_type = MetricType.CLASSIFICATION
    higher_is_better = True

    def compute(self, df, y_true, y_pred) -> float:
        raise NotImplementedError

    def __call__(self, df, y_true, y_pred) -> float:
        return self.compute(df, y_true, y_pred)


def check_consistent_length(*columns) -> None:
    """Array columns ``(df, column, column, ...)`` of equal lengths in every row, or plain sequences of equal lengths."""
    if columns and isinstance(columns[0], DataFrame):
        df, first, *rest = columns
        odd = reduce(lambda a, b: a | b, [F.size(first) != F.size(c) for c in rest], F.lit(False))
        if not df.where(odd).isEmpty():
            raise ValueError(f"columns {first}, {', '.join(rest)} differ in length")
    elif len({len(c) for c in columns if c is not None}) > 1:
        raise ValueError(f"lengths differ: {[len(c) for c in columns if c is not None]}")


def get_class_labels(df, y_true, y_pred=None) -> list:
    """Sorted distinct labels of one or both columns, without null."""
    rows = df.select(F.col(y_true).alias("l"))
    rows = rows.unionByName(df.select(F.col(y_pred).alias("l"))) if y_pred else rows
    return [r[0] for r in rows.where("l is not null").distinct().orderBy("l").collect()]


def get_num_classes(df, y_true, y_pred=None) -> int:
    rows = df.select(F.col(y_true).alias("l"))
    rows = rows.unionByName(df.select(F.col(y_pred).alias("l"))) if y_pred else rows
    return rows.agg(F.countDistinct("l")).first()[0]


def is_binary(df, y_true, y_pred=None) -> bool:
    return get_num_classes(df, y_true, y_pred) <= 2


def check_classification_targets(df, y_true, y_pred) -> None:
    """Labels of both columns must be comparable and, if numbers, whole."""
    kinds = dict(df.dtypes)
    if (kinds[y_true] == "string") != (kinds[y_pred] == "string"):
        raise ValueError(f"{y_true} is {kinds[y_true]}, {y_pred} is {kinds[y_pred]}")
    for c in (y_true, y_pred):
        if kinds[c] in ("double", "float") and not df.where(F.col(c).isNotNull() & (F.col(c) != F.floor(c))).isEmpty():
            raise ValueError(f"{c} is continuous")


def weighted_sum(df, values, weights) -> float:
    return df.agg(F.sum(clean(values) * clean(weights))).first()[0] or 0.0


def confusion_matrix(df, y_true, y_pred, labels=None, normalize=None) -> np.ndarray:
    m = _Table(df, y_true, y_pred, labels=labels).m
    if normalize == "true":
        return m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    if normalize == "pred":
        return m / np.maximum(m.sum(axis=0, keepdims=True), 1)
    return m / max(m.sum(), 1) if normalize == "all" else m.astype(int)


def accuracy_score(df, y_true, y_pred, normalize=True, sample_weight=None) -> float:
    t = _Table(df, y_true, y_pred, sample_weight)
    right = float(np.trace(t.m))
    return _div(right, t.total) if normalize else right


def zero_one_loss(df, y_true, y_pred, normalize=True) -> float:
    t = _Table(df, y_true, y_pred)
    wrong = t.total - float(np.trace(t.m))
    return _div(wrong, t.total) if normalize else wrong


def hamming_loss(df, y_true, y_pred) -> float:
    return zero_one_loss(df, y_true, y_pred)


def balanced_accuracy_score(df, y_true, y_pred, adjusted=False) -> float:
    t = _Table(df, y_true, y_pred)
    recalls = [t.m[i, i] / t.m[i].sum() for i in range(len(t.labels)) if t.m[i].sum()]
    score, chance = float(np.mean(recalls)) if recalls else 0.0, 1 / max(len(recalls), 1)
    return (score - chance) / (1 - chance) if adjusted and len(recalls) > 1 else score


def precision_recall_fscore_support(df, y_true, y_pred, beta=1.0, labels=None, pos_label=1, average=None, zero_division=0.0):
    """Arrays by label, or their binary, macro, weighted or micro average with the summed support."""
    t = _Table(df, y_true, y_pred, labels=labels)
    tp, pred, true = np.diag(t.m), t.m.sum(axis=0), t.m.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = np.where(pred > 0, tp / np.maximum(pred, 1e-300), zero_division)
        r = np.where(true > 0, tp / np.maximum(true, 1e-300), zero_division)
        f = np.where(p + r > 0, (1 + beta**2) * p * r / np.maximum(beta**2 * p + r, 1e-300), 0.0)
    if average is None:
        return p, r, f, true.astype(int)
    if average == "binary":
        if pos_label not in t.labels:
            return 0.0, 0.0, 0.0, 0
        i = t.labels.index(pos_label)
        return float(p[i]), float(r[i]), float(f[i]), int(true[i])
    if average == "micro":
        x = _div(tp.sum(), t.m.sum())
        return x, x, x, int(true.sum())
    w = true / max(true.sum(), 1) if average == "weighted" else np.full(len(true), 1 / max(len(true), 1))
    return float(p @ w), float(r @ w), float(f @ w), int(true.sum())


def _prf(k):
    def f(df, y_true, y_pred, average="binary", **kw):
        return precision_recall_fscore_support(df, y_true, y_pred, average=average, **kw)[k]

    return f


precision_score, recall_score, f1_score = _prf(0), _prf(1), _prf(2)


def fbeta_score(df, y_true, y_pred, beta=1.0, average="binary", **kw):
    return precision_recall_fscore_support(df, y_true, y_pred, beta=beta, average=average, **kw)[2]


def classification_report(df, y_true, y_pred, labels=None, target_names=None) -> str:
    t = _Table(df, y_true, y_pred, labels=labels)
    p, r, f, s = precision_recall_fscore_support(df, y_true, y_pred, labels=labels)
    names = target_names or [str(x) for x in t.labels]
    lines = [f"{'':>14} {'precision':>10} {'recall':>10} {'f1-score':>10} {'support':>10}"]
    lines += [f"{n:>14} {a:10.4f} {b:10.4f} {c:10.4f} {d:10d}" for n, a, b, c, d in zip(names, p, r, f, s, strict=True)]
    lines.append(f"{'accuracy':>14} {'':>10} {'':>10} {_div(np.trace(t.m), t.m.sum()):10.4f} {int(s.sum()):10d}")
    lines.append(f"{'macro avg':>14} {p.mean():10.4f} {r.mean():10.4f} {f.mean():10.4f} {int(s.sum()):10d}")
    return "\n".join(lines)


def _rate(of):
    def f(df, y_true, y_pred, pos_label=1) -> float:
        return of(*_Table(df, y_true, y_pred).one(pos_label))

    return f


true_positive_rate = sensitivity_score = _rate(lambda tp, fp, fn, tn: _div(tp, tp + fn))
false_positive_rate = _rate(lambda tp, fp, fn, tn: _div(fp, fp + tn))
true_negative_rate = specificity_score = _rate(lambda tp, fp, fn, tn: _div(tn, tn + fp))
false_negative_rate = _rate(lambda tp, fp, fn, tn: _div(fn, tp + fn))
num_true_positives = _rate(lambda tp, fp, fn, tn: int(tp))
num_false_positives = _rate(lambda tp, fp, fn, tn: int(fp))
num_false_negatives = _rate(lambda tp, fp, fn, tn: int(fn))
num_true_negatives = _rate(lambda tp, fp, fn, tn: int(tn))


def matthews_corrcoef(df, y_true, y_pred) -> float:
    """Of two classes; any other number gives 0."""
    t = _Table(df, y_true, y_pred)
    if len(t.labels) != 2:
        return 0.0
    tp, fp, fn, tn = t.one(t.labels[1])
    return _div(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def cohen_kappa_score(df, y_true, y_pred) -> float:
    m = _Table(df, y_true, y_pred).m
    n = m.sum()
    pe = float((m.sum(axis=0) * m.sum(axis=1)).sum()) / max(n * n, 1)
    return _div(np.trace(m) / max(n, 1) - pe, 1 - pe)


# ---------------------------------------------------------------- scores


def running_totals(df: DataFrame, by: str, sums: dict[str, Column], descending: bool = True, buckets: int = 64) -> DataFrame:
    """Distinct values of ``by`` with running totals, without a window over all rows.

    Values fall into buckets between sampled quantiles; totals run within each bucket, and the totals of the
    buckets before (at most ``buckets`` rows, broadcast) are added.
    """
    per = df.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("double").alias(by)).agg(*[e.alias(k) for k, e in sums.items()])
    edges = sorted(set(per.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.001)))
    arr = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    per = per.withColumn("_b", F.size(F.filter(arr, lambda e: e <= F.col(by))))
    sign = -1 if descending else 1
    whole = per.groupBy("_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    before = Window.orderBy(F.col("_b") * sign).rowsBetween(Window.unboundedPreceding, -1)
    offset = whole.select(F.col("_b").alias("_k"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    w = Window.partitionBy("_b").orderBy(F.col(by) * sign).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(offset), F.col("_b") == F.col("_k"))
    return out.select(by, *sums, *[(F.sum(k).over(w) + F.col(f"_o_{k}")).alias(f"cum_{k}") for k in sums])


def _curve(df, y_true, y_score, pos_label) -> DataFrame:
    pos = F.col(y_true) == F.lit(pos_label)
    return running_totals(df.where(F.col(y_true).isNotNull()), y_score, {"pos": F.count_if(pos), "neg": F.count_if(~pos)})


def roc_curve(df, y_true, y_score, pos_label=1) -> DataFrame:
    """``threshold, fpr, tpr``, one row for each distinct score from the highest."""
    c = _curve(df, y_true, y_score, pos_label)
    n = df.where(F.col(y_true).isNotNull()).agg(F.count_if(F.col(y_true) == F.lit(pos_label)), F.count_if(F.col(y_true) != F.lit(pos_label))).first()
    return c.select(F.col(y_score).alias("threshold"), (F.col("cum_neg") / F.lit(max(n[1], 1))).alias("fpr"), (F.col("cum_pos") / F.lit(max(n[0], 1))).alias("tpr")).orderBy(F.desc("threshold"))


def precision_recall_curve(df, y_true, y_score, pos_label=1) -> DataFrame:
    """``threshold, precision, recall``, one row for each distinct score from the highest."""
    c = _curve(df, y_true, y_score, pos_label)
    n = df.where(F.col(y_true) == F.lit(pos_label)).count()
    return c.select(F.col(y_score).alias("threshold"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"), (F.col("cum_pos") / F.lit(max(n, 1))).alias("recall")).orderBy(F.desc("threshold"))


def roc_auc_score(df, y_true, y_score, pos_label=1) -> float:
    """Chance that a positive scores above a negative, ties counting half."""
    c = _curve(df, y_true, y_score, pos_label)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    r = c.agg(area.alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return _div(r["a"] or 0.0, (r["p"] or 0) * (r["n"] or 0))


def average_precision_score(df, y_true, y_score, pos_label=1) -> float:
    c = _curve(df, y_true, y_score, pos_label)
    r = c.agg(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("a"), F.sum("pos").alias("p")).first()
    return _div(r["a"] or 0.0, r["p"] or 0)


def auc(x, y) -> float:
    """Trapezoid rule over given points."""
    return float(np.trapezoid(np.asarray(y, float), np.asarray(x, float)))


def log_loss(df, y_true, probability, eps=1e-15) -> float:
    """``probability``: a map from class to chance, an array indexed by class, or a column with the chance of 1."""
    kind = dict(df.dtypes)[probability]
    p = F.element_at(probability, F.col(y_true)) if kind.startswith("map") else F.element_at(probability, F.col(y_true).cast("int") + 1) if kind.startswith("array") else F.when(F.col(y_true) == 1, F.col(probability)).otherwise(1 - F.col(probability))
    p = F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.log(p))).first()[0]


# ---------------------------------------------------------------- regression


def regression_sums(y_true: str, y_pred: str) -> dict[str, Column]:
    t, p = clean(y_true), clean(y_pred)
    return {"n": F.count(t * p), "mae": F.avg(F.abs(t - p)), "mse": F.avg((t - p) * (t - p)), "var": F.var_pop(F.when(p.isNotNull(), t)), "mean": F.avg(F.when(p.isNotNull(), t)), "corr": F.corr(t, p)}


def _regression(df, y_true, y_pred):
    return df.agg(*[e.alias(k) for k, e in regression_sums(y_true, y_pred).items()]).first().asDict()


def mean_absolute_error(df, y_true, y_pred) -> float:
    return _regression(df, y_true, y_pred)["mae"]


def mean_squared_error(df, y_true, y_pred, squared=True) -> float:
    m = _regression(df, y_true, y_pred)["mse"]
    return m if squared else math.sqrt(m)


def root_mean_squared_error(df, y_true, y_pred) -> float:
    return mean_squared_error(df, y_true, y_pred, squared=False)


def r2_score(df, y_true, y_pred) -> float:
    r = _regression(df, y_true, y_pred)
    return 1 - _div(r["mse"], r["var"])


def relative_absolute_error(df, y_true, y_pred) -> float:
    mean = _regression(df, y_true, y_pred)["mean"]
    t, p = clean(y_true), clean(y_pred)
    r = df.agg(F.sum(F.abs(t - p)).alias("e"), F.sum(F.when(p.isNotNull(), F.abs(t - F.lit(mean)))).alias("d")).first()
    return 100 * _div(r["e"], r["d"])


def root_relative_squared_error(df, y_true, y_pred) -> float:
    r = _regression(df, y_true, y_pred)
    return 100 * math.sqrt(_div(r["mse"], r["var"]))


def correlation_coefficient(df, y_true, y_pred) -> float:
    c = _regression(df, y_true, y_pred)["corr"]
    return 0.0 if c is None or math.isnan(c) else c


# ---------------------------------------------------------------- agreement and information


def _plogp(p: np.ndarray, base: float | None) -> float:
    p = np.asarray(p, float)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / (math.log(base) if base else 1.0))


def _joint(df, a, b):
    rows = [(r["true"], r["pred"], r["n"]) for r in pair_counts(df, a, b).collect()]
    n = sum(r[2] for r in rows) or 1
    pa: dict = {}
    pb: dict = {}
    for x, y, c in rows:
        pa[x] = pa.get(x, 0) + c
        pb[y] = pb.get(y, 0) + c
    return np.array([r[2] for r in rows]) / n, np.array(list(pa.values())) / n, np.array(list(pb.values())) / n, n


def entropy(df, labels, base=None) -> float:
    n = np.array([r["count"] for r in df.groupBy(labels).count().collect()], float)
    return _plogp(n / max(n.sum(), 1), base)


def prior_entropy(df, y_true, base=2) -> float:
    return entropy(df, y_true, base)


def conditional_entropy(df, y_true, given, base=None) -> float:
    """Entropy of ``y_true`` given the other column."""
    j, _, b, _ = _joint(df, y_true, given)
    return _plogp(j, base) - _plogp(b, base)


def mutual_information(df, y_true, y_pred, base=None) -> float:
    j, a, b, _ = _joint(df, y_true, y_pred)
    return max(0.0, _plogp(a, base) + _plogp(b, base) - _plogp(j, base))


def mutual_info_score(df, labels_true, labels_pred) -> float:
    return mutual_information(df, labels_true, labels_pred)


def information_gain(df, y_true, y_pred, base=2) -> float:
    return mutual_information(df, y_true, y_pred, base)


def gain_ratio(df, y_true, y_pred, base=2) -> float:
    j, a, b, _ = _joint(df, y_true, y_pred)
    return _div(_plogp(a, base) + _plogp(b, base) - _plogp(j, base), _plogp(b, base))


def symmetrical_uncertainty(df, y_true, y_pred, base=2) -> float:
    j, a, b, _ = _joint(df, y_true, y_pred)
    return _div(2 * (_plogp(a, base) + _plogp(b, base) - _plogp(j, base)), _plogp(a, base) + _plogp(b, base))


def normalized_mutual_info_score(df, labels_true, labels_pred, average_method="arithmetic") -> float:
    j, a, b, _ = _joint(df, labels_true, labels_pred)
    ha, hb = _plogp(a, None), _plogp(b, None)
    mean = {"arithmetic": (ha + hb) / 2, "geometric": math.sqrt(ha * hb), "min": min(ha, hb), "max": max(ha, hb)}[average_method]
    return _div(ha + hb - _plogp(j, None), mean, 1.0)


def homogeneity_score(df, labels_true, labels_pred) -> float:
    j, a, b, _ = _joint(df, labels_true, labels_pred)
    return _div(_plogp(a, None) + _plogp(b, None) - _plogp(j, None), _plogp(a, None), 1.0)


def completeness_score(df, labels_true, labels_pred) -> float:
    return homogeneity_score(df, labels_pred, labels_true)


def v_measure_score(df, labels_true, labels_pred, beta=1.0) -> float:
    h, c = homogeneity_score(df, labels_true, labels_pred), completeness_score(df, labels_true, labels_pred)
    return _div((1 + beta) * h * c, beta * h + c)


def _pairs(df, a, b):
    j, pa, pb, n = _joint(df, a, b)
    c2 = lambda p: float((p * n * (p * n - 1) / 2).sum())
    return c2(j), c2(pa), c2(pb), n * (n - 1) / 2


def adjusted_rand_score(df, labels_true, labels_pred) -> float:
    j, a, b, n = _pairs(df, labels_true, labels_pred)
    expected = _div(a * b, n)
    return _div(j - expected, (a + b) / 2 - expected, 1.0)


def rand_score(df, labels_true, labels_pred) -> float:
    """Share of pairs on which both agree, pairs kept apart by both included."""
    j, a, b, n = _pairs(df, labels_true, labels_pred)
    return _div(n + 2 * j - a - b, n, 1.0)


def fowlkes_mallows_score(df, labels_true, labels_pred) -> float:
    j, a, b, _ = _pairs(df, labels_true, labels_pred)
    return _div(j, math.sqrt(a * b))


def _distributions(df, p, q):
    """Sums over rows of array columns p and q, clipped at 1e-10."""
    clip = lambda c: F.transform(c, lambda x: F.greatest(x.cast("double"), F.lit(1e-10)))
    return df.select(clip(p).alias("p"), clip(q).alias("q"))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def kullback_leibler_divergence(df, p, q, base=None) -> float:
    k = _distributions(df, p, q)
    return k.agg(F.avg(_sum(F.zip_with("p", "q", lambda a, b: a * F.log(a / b))))).first()[0] / (math.log(base) if base else 1)


def jensen_shannon_divergence(df, p, q, base=None) -> float:
    k = _distributions(df, p, q)
    half = lambda a, b: a * F.log(2 * a / (a + b)) / 2
    return k.agg(F.avg(_sum(F.zip_with("p", "q", lambda a, b: half(a, b) + half(b, a))))).first()[0] / (math.log(base) if base else 1)


def cross_entropy(df, p, q, base=None) -> float:
    k = _distributions(df, p, q)
    return k.agg(F.avg(_sum(F.zip_with("p", "q", lambda a, b: -a * F.log(b))))).first()[0] / (math.log(base) if base else 1)


def scheme_entropy(df, probability, base=2) -> float:
    """Mean entropy of predicted distributions (arrays)."""
    h = _sum(F.transform(probability, lambda x: F.when(x > 0, -x * F.log(x.cast("double"))).otherwise(0.0)))
    return df.agg(F.avg(h)).first()[0] / math.log(base)


def entropy_gain(df, y_true, probability, base=2) -> float:
    return prior_entropy(df, y_true, base) - scheme_entropy(df, probability, base)


def kb_information(df, y_true, probability, base=2) -> float:
    """Mean log ratio of the chance given to the true class (an index into the array) and its share."""
    n = df.count()
    prior = df.groupBy(y_true).agg((F.count(F.lit(1)) / F.lit(max(n, 1))).alias("_prior")).withColumnRenamed(y_true, "_y")
    p = F.greatest(F.element_at(probability, F.col(y_true).cast("int") + 1).cast("double"), F.lit(1e-10))
    return df.join(prior, F.col(y_true) == F.col("_y")).agg(F.avg(F.log(p / F.col("_prior")))).first()[0] / math.log(base)


mean_kb_information = kb_information

# ---------------------------------------------------------------- clusterings of points


def _centers(df, features, labels):
    return df.groupBy(F.col(labels).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(clean(c)).alias(f"_m_{c}") for c in features])


def _to_center(features) -> Column:
    return sum(((clean(c) - F.col(f"_m_{c}")) ** 2 for c in features), F.lit(0.0))


def calinski_harabasz_score(df, features, labels) -> float:
    """Between over within dispersion; one row of centers for each cluster is broadcast."""
    centers = _centers(df, features, labels)
    within = df.join(F.broadcast(centers), F.col(labels) == F.col("_k")).agg(F.sum(_to_center(features))).first()[0]
    c = centers.toPandas()
    n, k, m = c["_n"].to_numpy(float), len(c), c[[f"_m_{f}" for f in features]].to_numpy(float)
    overall = (m * n[:, None]).sum(axis=0) / n.sum()
    between = float((n * ((m - overall) ** 2).sum(axis=1)).sum())
    return _div(between / (k - 1), within / (n.sum() - k)) if k > 1 else 0.0


def davies_bouldin_score(df, features, labels) -> float:
    centers = _centers(df, features, labels)
    spread = df.join(F.broadcast(centers), F.col(labels) == F.col("_k")).groupBy("_k").agg(F.avg(F.sqrt(_to_center(features))).alias("s"))
    c = centers.join(spread, "_k").toPandas()
    m, s = c[[f"_m_{f}" for f in features]].to_numpy(float), c["s"].to_numpy(float)
    if len(c) < 2:
        return 0.0
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    with np.errstate(divide="ignore"):
        return float(np.mean(((s[:, None] + s[None]) / d).max(axis=1)))


def silhouette_samples(df, features, labels, metric="euclidean", id_col="row_id", block_rows=4096) -> DataFrame:
    """``id, silhouette`` of each row: exact, in blocks of rows against all rows.

    Each block (of bounded size) is sent to the partitions, which return a sum of distances for each of its rows and
    each cluster; so n * n distances are computed but at most partitions * block rows * clusters are shuffled.
    """
    from ..operators.neighbors import row_blocks, sums_to_block

    return sums_to_block(df, features, labels, metric, id_col, row_blocks(df, [id_col, labels, *features], block_rows))


def silhouette_score(df, features, labels, metric="euclidean", id_col="row_id") -> float:
    return silhouette_samples(df, features, labels, metric, id_col).agg(F.avg("silhouette")).first()[0]


# ---------------------------------------------------------------- scores of features


def chi2(df, features, y) -> dict[str, float]:
    """Contingency chi-square of each feature's values and the classes."""
    return {f: _chi2_of(_Table(df, f, y).m) for f in features}


def _chi2_of(m: np.ndarray) -> float:
    m = m[m.sum(axis=1) > 0][:, m.sum(axis=0) > 0]
    e = np.outer(m.sum(axis=1), m.sum(axis=0)) / max(m.sum(), 1)
    return float(((m - e) ** 2 / np.maximum(e, 1e-300)).sum())


def f_classif(df, features, y) -> dict[str, float]:
    """ANOVA F of each feature; rows without a value don't count."""
    rows = df.where(F.col(y).isNotNull()).groupBy(y).agg(*[e for i, c in enumerate(features) for e in (F.count(clean(c)).alias(f"n{i}"), F.avg(clean(c)).alias(f"m{i}"), F.var_pop(clean(c)).alias(f"v{i}"))]).toPandas()
    out = {}
    for i, c in enumerate(features):
        n, m, v = (rows[f"{k}{i}"].fillna(0).to_numpy(float) for k in "nmv")
        k, total = (n > 0).sum(), n.sum()
        mean = (n * m).sum() / max(total, 1)
        between, within = (n * (m - mean) ** 2).sum(), (n * v).sum()
        out[c] = math.inf if within == 0 and between > 0 else _div(between / max(k - 1, 1), within / max(total - k, 1))
    return out


def f_regression(df, features, y) -> dict[str, float]:
    r = df.agg(*[F.corr(clean(c), clean(y)).alias(c) for c in features], *[F.count(clean(c) * clean(y)).alias(f"n_{c}") for c in features]).first().asDict()
    sq = {c: 0.0 if r[c] is None or math.isnan(r[c]) else r[c] ** 2 for c in features}
    return {c: math.inf if sq[c] >= 1 else sq[c] / (1 - sq[c]) * (r[f"n_{c}"] - 2) for c in features}


def correlation(df, features, y) -> dict[str, float]:
    r = df.agg(*[F.corr(clean(c), clean(y)).alias(c) for c in features]).first().asDict()
    return {c: 0.0 if v is None or math.isnan(v) else abs(v) for c, v in r.items()}


def oner_score(df, features, y, n_bins=10) -> dict[str, float]:
    """Accuracy of the majority class of each of a feature's equal-width bins."""
    from ..operators.preprocessing import EqualWidthDiscretizer

    out = {}
    binned = EqualWidthDiscretizer(n_bins, features).fit_transform(df)
    for c in features:
        per = pair_counts(binned, c, y).groupBy("true").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
        row = per.agg(F.sum("most"), F.sum("n")).first()
        out[c] = _div(row[0] or 0.0, row[1] or 0)
    return out

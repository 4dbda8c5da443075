"""Learners that see one row or small batch after the other, in parallel by mixing.

Each epoch every partition goes through its own rows, starting from the weights that all share, and the partitions'
weights are averaged by their rows (iterative parameter mixing, or local gradient descent).  An epoch is one job; what
reaches the driver is one set of weights a partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Classifier, Regressor, classifier, clean, one_row, regressor
from .learners import classes_of

#: Rows that a partition turns into a matrix at a time.
BATCH = 4_096


def mixed_epoch(rows: DataFrame, weights: list[np.ndarray], step, seed: int) -> tuple[list[np.ndarray], list[np.ndarray], float, int]:
    """New weights, summed loss and rows of one epoch.  ``step(weights, x, y, rng)`` changes the weights in place over
    a batch and returns its loss and what to average (the weights, or others kept beside them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n, loss, kept = [w.copy() for w in weights], 0, 0.0, None
        rng = np.random.default_rng(seed)
        for pdf in batches:
            x, y = np.stack(pdf["x"].to_list()), pdf["y"].to_numpy(float)
            lost, part = step(own, x, y, rng)
            loss, n = loss + lost, n + len(y)
            kept = [p * len(y) for p in part] if kept is None else [a + p * len(y) for a, p in zip(kept, part, strict=True)]
        if n:
            yield pd.DataFrame({"w": [pickle.dumps(own)], "a": [pickle.dumps([k / n for k in kept])], "n": [n], "loss": [loss]})

    got = rows.mapInPandas(run, "w binary, a binary, n long, loss double").collect()
    total = sum(r["n"] for r in got) or 1
    mean = lambda c: [sum(p * (r["n"] / total) for p, r in zip(ps, got, strict=True)) for ps in zip(*(pickle.loads(bytes(r[c])) for r in got), strict=True)]
    return (mean("w"), mean("a"), sum(r["loss"] for r in got), total) if got else (weights, weights, 0.0, 0)


class _Scaled:
    """Standardized features as an array, missing values as means."""

    def _prepare(self, df: DataFrame, label: str | None, features) -> None:
        self._names(df, label, features)
        s = one_row(df, [e for c in self.features for e in (F.avg(clean(c)).alias(f"m.{c}"), F.stddev_pop(clean(c)).alias(f"s.{c}"))])
        self.means, self.scales = [s[f"m.{c}"] or 0.0 for c in self.features], [s[f"s.{c}"] or 1.0 for c in self.features]

    def _x(self) -> Column:
        return F.array(*[(F.coalesce(clean(c), F.lit(m)) - F.lit(m)) / F.lit(s or 1.0) for c, m, s in zip(self.features, self.means, self.scales, strict=True)])


@classifier
class PerceptronClassifier(_Scaled, Classifier):
    """Rosenblatt's rule with a weight vector for each class: a row that is taken for another class is added to its
    own and taken from the other's.  Ends when an epoch's share of mistakes falls by less than ``tol`` for
    ``patience`` epochs."""

    defaults = {"learning_rate": 1.0, "max_iter": 1000, "tol": 1e-3, "shuffle": True, "random_state": None, "patience": 5}
    averaged = False

    def fit(self, df, label=None, features=None):
        self._prepare(df, label, features)
        self.classes = classes_of(df, label)
        table = F.array(*map(F.lit, self.classes))
        rows = df.where(F.col(label).isNotNull()).select(self._x().alias("x"), (F.array_position(table, F.col(label)) - 1).cast("double").alias("y")).persist()
        w = [np.zeros((max(len(self.classes), 1), len(self.features) + 1))]
        rate, shuffle = self.learning_rate, self.shuffle

        def step(w, x, y, rng):
            x, total, wrong = np.c_[x, np.ones(len(x))], np.zeros_like(w[0]), 0
            for i in rng.permutation(len(x)) if shuffle else range(len(x)):
                k, c = int((w[0] @ x[i]).argmax()), int(y[i])
                if k != c:
                    w[0][c] += rate * x[i]
                    w[0][k] -= rate * x[i]
                    wrong += 1
                total += w[0]
            return wrong, [total / len(x)]

        best, idle, mean = (np.inf, w), 0, None
        for epoch in range(self.max_iter):
            w, average, wrong, n = mixed_epoch(rows, w, step, (self.random_state or 0) + epoch)
            mean = average if mean is None else [(m * epoch + a) / (epoch + 1) for m, a in zip(mean, average, strict=True)]
            idle = 0 if wrong / max(n, 1) < best[0] - self.tol else idle + 1
            best = min(best, (wrong / max(n, 1), w), key=lambda b: b[0])
            if not wrong or idle >= self.patience:
                break
        rows.unpersist()
        self.weights = (mean if self.averaged and mean else best[1])[0]
        return self

    def predict(self, df):
        x = self._x()
        scores = F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w[:-1]]), lambda a, b: a * b), F.lit(float(w[-1])), lambda s, v: s + v) for w in self.weights])
        at = F.array_position(scores, F.array_max(scores)).cast("int")
        return df.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), at) if self.classes else F.lit(None))


@classifier
class AveragedPerceptronClassifier(PerceptronClassifier):
    """The perceptron's weights averaged over all rows seen."""

    defaults = {"learning_rate": 1.0, "max_iter": 5, "shuffle": True, "random_state": None, "tol": 0.0, "patience": 1000}
    averaged = True


@classifier
class VotedPerceptronClassifier(AveragedPerceptronClassifier):
    """Votes of all intermediate perceptrons, by their mean (the averaged perceptron), which keeps one weight vector
    however many there were.  ``exponent`` is 1: linear."""

    defaults = {"max_iter": 1, "exponent": 1.0, "random_state": None}
    learning_rate, shuffle, tol, patience = 1.0, True, 0.0, 1000

    def fit(self, df, label=None, features=None):
        if self.exponent != 1.0:
            raise ValueError("exponent: only 1 (linear)")
        return super().fit(df, label, features)


@regressor
class MultilayerPerceptronRegressor(_Scaled, Regressor):
    """Hidden layers of sigmoids and a linear output, trained by back-propagation in small batches, with momentum and a rate
    of its own for each weight (Adam)."""

    defaults = {"hidden_layers": None, "learning_rate": 0.02, "momentum": 0.9, "max_epochs": 60, "batch_size": 32, "random_state": None}

    def fit(self, df, label=None, features=None):
        self._prepare(df, label, features)
        s = one_row(df, [F.avg(clean(label)).alias("m"), F.stddev_pop(clean(label)).alias("s")])
        self.mean, self.scale = s["m"] or 0.0, s["s"] or 1.0
        rows = df.where(clean(label).isNotNull()).select(self._x().alias("x"), ((clean(label) - F.lit(self.mean)) / F.lit(self.scale)).alias("y")).persist()
        rng = np.random.default_rng(self.random_state or 0)
        sizes = [len(self.features), *(self.hidden_layers or [2 * len(self.features) + 8]), 1]
        w = [a for i, o in zip(sizes, sizes[1:], strict=False) for a in (rng.normal(0, 1 / np.sqrt(i), (i, o)), np.zeros(o))]
        momentum, size = self.momentum, self.batch_size

        def trainer(rate):
            def step(w, x, y, rng):
                speed, spread, lost = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0.0
                for t, at in enumerate(np.array_split(rng.permutation(len(x)), max(1, len(x) // size)), 1):
                    out = forward(w, x[at])
                    e = (out[-1][:, 0] - y[at])[:, None]
                    lost += float((e * e).sum())
                    g = e / len(at)
                    for k in range(len(w) // 2 - 1, -1, -1):
                        grads = out[k].T @ g, g.sum(axis=0)
                        g = g @ w[2 * k].T * out[k] * (1 - out[k]) if k else g
                        for j, d in zip((2 * k, 2 * k + 1), grads, strict=True):
                            speed[j], spread[j] = momentum * speed[j] + (1 - momentum) * d, 0.99 * spread[j] + 0.01 * d * d
                            w[j] -= rate * speed[j] / (1 - momentum**t) / (np.sqrt(spread[j] / (1 - 0.99**t)) + 1e-8)
                return lost, w

            return step

        for epoch in range(self.max_epochs):
            w, _, _, _ = mixed_epoch(rows, w, trainer(self.learning_rate / (1 + 2 * epoch / max(self.max_epochs, 1))), (self.random_state or 0) + epoch)
        rows.unpersist()
        self.weights = w
        return self

    def predict(self, df):
        weights, mean, scale = self.weights, self.mean, self.scale

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(weights[0])))
            return pd.Series(forward(weights, x)[-1][:, 0] * scale + mean, index=rows.index)

        return df.withColumn("prediction", run(self._x()))


def forward(w: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives: the input, sigmoids of the hidden layers, the linear output."""
    out = [x]
    for k in range(0, len(w), 2):
        z = out[-1] @ w[k] + w[k + 1]
        out.append(z if k == len(w) - 2 else 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return out

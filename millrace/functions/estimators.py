"""Densities of one column, from one aggregate, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Params, clean


class Estimator(Params):
    def fit(self, df: DataFrame, column: str):
        raise NotImplementedError

    def probability(self, c: Column) -> Column:
        raise NotImplementedError


class NormalEstimator(Estimator):
    defaults = {"precision": 0.01}

    def fit(self, df, column):
        r = df.agg(F.avg(clean(column)).alias("m"), F.var_pop(clean(column)).alias("v")).first()
        self.mean, self.var = r["m"] or 0.0, max(r["v"] or 0.0, (self.precision or 1e-9) ** 2)
        return self

    def probability(self, c):
        return F.exp(-(c - F.lit(self.mean)) * (c - F.lit(self.mean)) / F.lit(2 * self.var)) / F.lit(math.sqrt(2 * math.pi * self.var))


class KernelEstimator(Estimator):
    """Gaussian kernels on the centers of at most ``cells`` equal-width cells, weighted by their counts."""

    defaults = {"precision": None, "cells": 256}

    def fit(self, df, column):
        x = clean(column)
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_pop(x).alias("s"), F.count(x).alias("n")).first()
        self.n, lo, hi = r["n"], r["lo"] or 0.0, r["hi"] or 0.0
        self.width = max((r["s"] or 0.0) * max(self.n, 1) ** -0.2, self.precision or 1e-6)
        step = (hi - lo) / self.cells or 1.0
        cell = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(self.cells - 1))
        rows = df.where(x.isNotNull()).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m")).collect()
        self.points = [(row["m"], row["n"] / self.n) for row in rows]
        return self

    def probability(self, c):
        out = F.lit(0.0)
        for m, w in self.points:
            out = out + F.lit(w) * F.exp(-(c - F.lit(m)) * (c - F.lit(m)) / F.lit(2 * self.width**2))
        return out / F.lit(self.width * math.sqrt(2 * math.pi))


class DiscreteEstimator(Estimator):
    defaults = {"num_symbols": None, "laplace": True}

    def fit(self, df, column):
        n = {r[0]: r["count"] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().collect()}
        k, total, a = self.num_symbols or len(n), sum(n.values()), 1 if self.laplace else 0
        self.table, self.unseen = {v: (c + a) / (total + a * k) for v, c in n.items()}, a / max(total + a * k, 1)
        return self

    def probability(self, c):
        out = F.lit(float(self.unseen))
        for v, p in self.table.items():
            out = F.when(c == F.lit(v), F.lit(p)).otherwise(out)
        return out


# ---------------------------------------------------------------- impurities of class counts (arrays)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def gini_impurity(counts: Column) -> Column:
    n = _total(counts)
    return F.when(n > 0, 1 - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x) / (n * n)).otherwise(0.0)


def entropy_from_counts(counts: Column) -> Column:
    n = _total(counts)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, -(x / n) * F.log2(x / n)).otherwise(0.0))


def best_split(df: DataFrame, feature: str, label: str, criterion: str = "gini") -> dict:
    """The exact best threshold of a column: class counts by distinct value with running totals over value buckets."""
    from .metrics import running_totals

    classes = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    rows = df.where(F.col(label).isNotNull() & clean(feature).isNotNull())
    sums = {f"c{i}": F.count_if(F.col(label) == F.lit(k)) for i, k in enumerate(classes)}
    cum = running_totals(rows, feature, sums, descending=False)
    all_ = rows.agg(*[e.alias(k) for k, e in sums.items()]).first()
    left = F.array(*[F.col(f"cum_{k}").cast("double") for k in sums])
    right = F.array(*[(F.lit(float(all_[k])) - F.col(f"cum_{k}")) for k in sums])
    f = gini_impurity if criterion == "gini" else entropy_from_counts
    n = sum(all_[k] for k in sums) or 1
    score = (_total(left) * f(left) + _total(right) * f(right)) / F.lit(float(n))
    best = cum.where(_total(right) > 0).select(F.col(feature).alias("threshold"), score.alias("impurity")).orderBy("impurity", "threshold").first()
    return best.asDict() if best else {"threshold": None, "impurity": None}

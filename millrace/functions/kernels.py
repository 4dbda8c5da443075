"""Kernels as Column expressions over two array columns; ``gram`` gives the long table of a small set of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Params, kernel


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _square_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


class Kernel(Params):
    def evaluate(self, a, b) -> Column:
        raise NotImplementedError

    def gram(self, df: DataFrame, id_col: str, vector_col: str, other: DataFrame | None = None) -> DataFrame:
        left = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("_a"))
        right = (other if other is not None else df).select(F.col(id_col).alias("j"), F.col(vector_col).alias("_b"))
        return left.crossJoin(right).select("i", "j", self.evaluate("_a", "_b").alias("k"))


@kernel
class LinearKernel(Kernel):
    def evaluate(self, a, b):
        return dot(a, b)


@kernel
class PolynomialKernel(Kernel):
    defaults = {"degree": 3, "gamma": 1.0, "coef0": None, "lower_order": True}

    def evaluate(self, a, b):
        c = self.coef0 if self.coef0 is not None else 1.0 if self.lower_order else 0.0
        return F.pow(F.lit(float(self.gamma)) * dot(a, b) + F.lit(float(c)), F.lit(float(self.degree)))


@kernel
class NormalizedPolynomialKernel(Kernel):
    defaults = {"degree": 2, "lower_order": True}

    def evaluate(self, a, b):
        k = PolynomialKernel(self.degree, 1.0, None, self.lower_order)
        n = F.sqrt(k.evaluate(a, a) * k.evaluate(b, b))
        return F.when(n > 0, k.evaluate(a, b) / n).otherwise(0.0)


@kernel
class RBFKernel(Kernel):
    defaults = {"gamma": 0.01}

    def evaluate(self, a, b):
        return F.exp(-F.lit(float(self.gamma)) * _square_distance(a, b))


@kernel
class SigmoidKernel(Kernel):
    defaults = {"gamma": 0.01, "coef0": 0.0}

    def evaluate(self, a, b):
        return F.tanh(F.lit(float(self.gamma)) * dot(a, b) + F.lit(float(self.coef0)))


@kernel
class PearsonUniversalKernel(Kernel):
    defaults = {"omega": 1.0, "sigma": 1.0}

    def evaluate(self, a, b):
        scale = 2 * math.sqrt(2 ** (1 / self.omega) - 1) / self.sigma
        return 1 / F.pow(1 + _square_distance(a, b) * F.lit(scale * scale), F.lit(float(self.omega)))


@kernel
class PrecomputedKernel(Kernel):
    """Looks values up in a table ``i, j, k``."""

    defaults = {"kernel_matrix": None}

    def gram(self, df, id_col, vector_col=None, other=None):
        left, right = df.select(F.col(id_col).alias("i")), (other if other is not None else df).select(F.col(id_col).alias("j"))
        return self.kernel_matrix.join(left, "i", "left_semi").join(right, "j", "left_semi").select("i", "j", "k")


@kernel
class StringKernel(Kernel):
    """Decayed common subsequences of two strings, normalized."""

    defaults = {"subsequence_length": 3, "lambda_decay": 0.5, "normalize": True}

    def evaluate(self, a, b):
        n, lam, norm = self.subsequence_length, self.lambda_decay, self.normalize

        def raw(s: str, t: str) -> float:
            run = np.ones((len(s) + 1, len(t) + 1))
            same = np.array([[x == y for y in t] for x in s], bool).reshape(len(s), len(t))
            for k in range(1, n + 1):
                inner = np.where(same, run[:-1, :-1], 0.0) * lam * lam
                if k == n:
                    return float(inner.sum())
                new = np.zeros_like(run)
                for i in range(len(s)):
                    row = 0.0
                    for j in range(len(t)):
                        row = lam * row + inner[i, j]
                        new[i + 1, j + 1] = lam * new[i, j + 1] + row
                run = new
            return 0.0

        @F.pandas_udf("double")
        def f(x: pd.Series, y: pd.Series) -> pd.Series:
            out = []
            for s, t in zip(x.fillna(""), y.fillna(""), strict=True):
                v = raw(s, t)
                d = math.sqrt(raw(s, s) * raw(t, t)) if norm else 1.0
                out.append(v / d if d else 0.0)
            return pd.Series(out)

        return f(a, b)

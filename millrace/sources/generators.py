"""Synthetic tables as projections over ``spark.range``: any number of rows, made where they are used."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Params


@dataclass
class GeneratedData:
    """A generated table with the names of its columns; ``frame`` is lazy."""

    frame: DataFrame
    feature_names: list[str]
    target_name: str | None = None

    @property
    def X(self) -> DataFrame:  # noqa: N802
        return self.frame.select(*self.feature_names)

    @property
    def y(self) -> DataFrame | None:
        return self.frame.select(self.target_name) if self.target_name else None


class DataGenerator(Params):
    """``generate(spark)`` gives a table; ``data(spark)`` the same with its columns told apart."""

    target: str | None = "y"
    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n_samples).withColumnRenamed("id", "row_id")

    def _u(self, i: int):
        return F.rand((self.random_state or 0) * 1009 + i)

    def _n(self, i: int):
        return F.randn((self.random_state or 0) * 1009 + i)

    def generate(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def data(self, spark: SparkSession) -> GeneratedData:
        df = self.generate(spark)
        target = self.target if self.target in df.columns else None
        return GeneratedData(df, [c for c in df.columns if c not in ("row_id", target)], target)


Generator = DataGenerator


class ClassificationGenerator(DataGenerator):
    """Tables whose ``y`` is a class."""


class RegressionGenerator(DataGenerator):
    """Tables whose ``y`` is a number."""


class ClusteringGenerator(DataGenerator):
    """Tables whose ``y`` is the cluster that a row was drawn from."""


class Agrawal(ClassificationGenerator):
    """Loan applicants and a rule of their group."""

    defaults = {"n_samples": 100, "function": 1, "perturbation": 0.05, "random_state": None}

    def generate(self, spark):
        u = self._u
        d = self._rows(spark).select("row_id", (20_000 + u(1) * 130_000).alias("salary"), (10_000 + u(2) * 65_000).alias("_c"), F.floor(20 + u(3) * 61).cast("double").alias("age"), F.floor(u(4) * 5).cast("double").alias("elevel"), F.floor(1 + u(5) * 20).cast("double").alias("car"), F.floor(u(6) * 9).cast("double").alias("zipcode"), u(7).alias("_h"), F.floor(1 + u(8) * 30).cast("double").alias("hyears"), (u(9) * 500_000).alias("loan"))
        d = d.withColumn("commission", F.when(F.col("salary") >= 75_000, 0.0).otherwise(F.col("_c"))).withColumn("hvalue", (9 - F.col("zipcode")) * 100_000 * (0.5 + F.col("_h"))).drop("_c", "_h")
        s, a, e, c = F.col("salary"), F.col("age"), F.col("elevel"), F.col("commission")
        young, mid = a < 40, (a >= 40) & (a < 60)
        income = 0.67 * (s + c)
        equity = F.when(F.col("hyears") >= 20, 0.1 * F.col("hvalue") * (F.col("hyears") - 20)).otherwise(0.0)
        by_age = lambda f, g, h: F.when(young, f).when(mid, g).otherwise(h)
        rules = {
            1: young | (a >= 60),
            2: by_age(s.between(50_000, 100_000), s.between(75_000, 125_000), s.between(25_000, 75_000)),
            3: by_age(e.isin(0, 1), e.isin(1, 2, 3), e.isin(2, 3, 4)),
            4: by_age(F.when(e.isin(0, 1), s.between(25_000, 75_000)).otherwise(s.between(50_000, 100_000)), F.when(e.isin(1, 2, 3), s.between(50_000, 100_000)).otherwise(s.between(75_000, 125_000)), F.when(e.isin(2, 3, 4), s.between(50_000, 100_000)).otherwise(s.between(25_000, 75_000))),
            5: by_age(F.when(s.between(50_000, 100_000), F.col("loan").between(100_000, 300_000)).otherwise(F.col("loan").between(200_000, 400_000)), F.when(s.between(75_000, 125_000), F.col("loan").between(200_000, 400_000)).otherwise(F.col("loan").between(300_000, 500_000)), F.when(s.between(25_000, 75_000), F.col("loan").between(300_000, 500_000)).otherwise(F.col("loan").between(100_000, 300_000))),
            6: by_age((s + c).between(50_000, 100_000), (s + c).between(75_000, 125_000), (s + c).between(25_000, 75_000)),
            7: income - 0.2 * F.col("loan") - 20_000 > 0,
            8: income - 5_000 * e - 20_000 > 0,
            9: income - 5_000 * e - 0.2 * F.col("loan") - 10_000 > 0,
            10: income - 5_000 * e + 0.2 * equity - 10_000 > 0,
        }
        d = d.withColumn("y", F.when(rules[self.function], 0).otherwise(1))
        jitter = {c: F.col(c) * (1 + (self._u(20 + i) * 2 - 1) * self.perturbation) for i, c in enumerate(("salary", "commission", "loan", "hvalue"))}
        return d.withColumns(jitter) if self.perturbation else d


class Hyperplane(ClassificationGenerator):
    defaults = {"n_samples": 100, "n_features": 10, "n_drift_features": 0, "noise": 0.0, "random_state": None}

    def generate(self, spark):
        w = np.random.default_rng(self.random_state).uniform(-1, 1, self.n_features)
        d = self._rows(spark).select("row_id", *[self._u(i).alias(f"f{i}") for i in range(self.n_features)])
        side = sum((F.col(f"f{i}") * float(v) for i, v in enumerate(w)), F.lit(0.0)) >= F.lit(float(w.sum() / 2))
        return d.withColumn("y", F.when(self._u(999) < self.noise, ~side).otherwise(side).cast("int"))


class LED(ClassificationGenerator):
    """Digits on seven noisy segments, with bits that mean nothing."""

    defaults = {"n_samples": 100, "noise": 0.1, "n_irrelevant": 17, "random_state": None}
    # The segments of the digits 0 to 9.
    SEGMENTS = ("1110111", "0010010", "1011101", "1011011", "0111010", "1101011", "1101111", "1010010", "1111111", "1111011")

    def generate(self, spark):
        d = self._rows(spark).withColumn("y", F.floor(self._u(0) * 10).cast("int"))
        rows = F.array(*map(F.lit, self.SEGMENTS))
        bit = lambda i: F.substring(F.element_at(rows, F.col("y") + 1), i + 1, 1).cast("int")
        d = d.withColumns({f"s{i}": F.when(self._u(1 + i) < self.noise, 1 - bit(i)).otherwise(bit(i)) for i in range(7)})
        return d.withColumns({f"r{i}": (self._u(50 + i) < 0.5).cast("int") for i in range(self.n_irrelevant)})


class RandomRBF(ClassificationGenerator):
    """Rows around weighted centroids, each of a class, at a normal distance in a random direction."""

    defaults = {"n_samples": 100, "n_features": 10, "n_classes": 2, "n_centroids": 50, "random_state": None}

    def generate(self, spark):
        rng = np.random.default_rng(self.random_state)
        w = rng.uniform(size=self.n_centroids).cumsum()
        rows = [(i, int(rng.integers(self.n_classes)), float(rng.uniform()), *map(float, rng.uniform(size=self.n_features))) for i in range(self.n_centroids)]
        centers = spark.createDataFrame(rows, "_k int, y int, _s double, " + ", ".join(f"_m{i} double" for i in range(self.n_features)))
        pick = F.size(F.filter(F.array(*[F.lit(float(v / w[-1])) for v in w[:-1]]), lambda e: e <= F.col("_u")))
        d = self._rows(spark).withColumn("_u", self._u(0)).withColumn("_c", pick).join(F.broadcast(centers), F.col("_c") == F.col("_k"))
        d = d.withColumns({f"_d{i}": self._n(1 + i) for i in range(self.n_features)}).withColumn("_r", self._n(500) * F.col("_s"))
        size = F.sqrt(sum((F.col(f"_d{i}") ** 2 for i in range(self.n_features)), F.lit(1e-300)))
        return d.select("row_id", *[(F.col(f"_m{i}") + F.col(f"_d{i}") / size * F.col("_r")).alias(f"f{i}") for i in range(self.n_features)], "y")


class Blobs(ClusteringGenerator):
    defaults = {"n_samples": 100, "n_features": 2, "n_clusters": 3, "cluster_std": 1.0, "centers": None, "center_box": (-10.0, 10.0), "shuffle": True, "random_state": None}

    def generate(self, spark):
        c = self.centers if self.centers is not None else np.random.default_rng(self.random_state).uniform(*self.center_box, (self.n_clusters, self.n_features))
        c = np.asarray(c, float)
        d = self._rows(spark).withColumn("y", F.pmod(F.xxhash64("row_id") if self.shuffle else F.col("row_id"), F.lit(len(c))).cast("int"))
        at = lambda i: F.element_at(F.array(*[F.lit(float(v)) for v in c[:, i]]), F.col("y") + 1)
        return d.select("row_id", *[(at(i) + self._n(i) * self.cluster_std).alias(f"f{i}") for i in range(c.shape[1])], "y")


class Circles(ClusteringGenerator):
    defaults = {"n_samples": 100, "noise": 0.05, "factor": 0.5, "shuffle": True, "random_state": None}

    def generate(self, spark):
        d = self._rows(spark).withColumn("y", (F.col("row_id") % 2).cast("int")).withColumn("_t", self._u(0) * 2 * math.pi)
        r = F.when(F.col("y") == 1, F.lit(float(self.factor))).otherwise(1.0)
        return d.select("row_id", (r * F.cos("_t") + self._n(1) * self.noise).alias("f0"), (r * F.sin("_t") + self._n(2) * self.noise).alias("f1"), "y")


class Moons(ClusteringGenerator):
    defaults = {"n_samples": 100, "noise": 0.1, "shuffle": True, "random_state": None}

    def generate(self, spark):
        d = self._rows(spark).withColumn("y", (F.col("row_id") % 2).cast("int")).withColumn("_t", self._u(0) * math.pi)
        low = F.col("y") == 1
        x = F.when(low, 1 - F.cos("_t")).otherwise(F.cos("_t"))
        y = F.when(low, 0.5 - F.sin("_t")).otherwise(F.sin("_t"))
        return d.select("row_id", (x + self._n(1) * self.noise).alias("f0"), (y + self._n(2) * self.noise).alias("f1"), "y")


class SwissRoll(ClusteringGenerator):
    defaults = {"n_samples": 100, "noise": 0.0, "hole": False, "random_state": None}

    def generate(self, spark):
        d = self._rows(spark).withColumn("t", 1.5 * math.pi * (1 + 2 * self._u(0))).withColumn("_h", 21 * self._u(1))
        if self.hole:
            d = d.withColumn("_h", F.when((F.col("t") > 7) & (F.col("t") < 10) & F.col("_h").between(7, 14), F.col("_h") / 3).otherwise(F.col("_h")))
        return d.select("row_id", (F.col("t") * F.cos("t") + self._n(2) * self.noise).alias("f0"), (F.col("_h") + self._n(3) * self.noise).alias("f1"), (F.col("t") * F.sin("t") + self._n(4) * self.noise).alias("f2"), F.col("t").alias("y"))


class Friedman(RegressionGenerator):
    defaults = {"n_samples": 100, "n_features": 10, "function": 1, "noise": 0.0, "random_state": None}

    def generate(self, spark):
        n = max(self.n_features, 5 if self.function == 1 else 4)
        d = self._rows(spark).select("row_id", *[self._u(i).alias(f"f{i}") for i in range(n)])
        x = [F.col(f"f{i}") for i in range(n)]
        if self.function != 1:
            d = d.withColumns({"f0": x[0] * 100, "f1": (40 + 520 * x[1]) * math.pi, "f3": 1 + 10 * x[3]})
        inner = x[1] * x[2] - 1 / (x[1] * x[3])
        y = {1: 10 * F.sin(math.pi * x[0] * x[1]) + 20 * (x[2] - 0.5) ** 2 + 10 * x[3] + 5 * x[4] if n > 4 else None, 2: F.sqrt(x[0] ** 2 + inner**2), 3: F.atan(inner / x[0])}[self.function]
        return d.withColumn("y", y + self._n(900) * self.noise)


class MexicanHat(RegressionGenerator):
    defaults = {"n_samples": 100, "noise": 0.0, "low": -5.0, "high": 5.0, "random_state": None}

    def generate(self, spark):
        d = self._rows(spark).withColumn("f0", self.low + self._u(0) * (self.high - self.low))
        return d.withColumn("y", (1 - F.col("f0") ** 2) * F.exp(-(F.col("f0") ** 2) / 2) + self._n(1) * self.noise)


class Sine(RegressionGenerator):
    defaults = {"n_samples": 100, "noise": 0.0, "random_state": None}

    def generate(self, spark):
        d = self._rows(spark).withColumn("f0", self._u(0) * 2 * math.pi)
        return d.withColumn("y", F.sin("f0") + self._n(1) * self.noise)

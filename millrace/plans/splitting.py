"""Splitters as fold columns.

A fold is a function of the row's id (its md5 with the seed) and of nothing else where sizes may vary by chance;
``exact`` splitters rank rows by that hash or in order, in buckets, which costs one shuffle (:func:`ranked`).  ``split(df)`` yields (train, test) pairs of
lazy filters.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Params, splitter
from ..operators.sampling import uniform
from .graph import cut


def order_key(id_col: str, seed: int | None) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed or 0)), F.col(id_col).cast("string")))


def fold_column(id_col: str, k: int, seed: int = 0) -> Column:
    """Fold 0..k-1 of a row by its hash: no shuffle."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(k)).cast("int")


BUCKETS = 64


def ranked(df: DataFrame, order: list[Column], key: Column, within: str | None = None) -> DataFrame:
    """``df`` with ``_rank``, from 0, in the order of ``order`` (of each value of ``within``), and ``_n``, how many rows
    there are.

    No window sees all rows: ``key``, a number that rises with the order, deals rows to buckets between its sampled
    quantiles; rows are numbered within a bucket, and the counts of the buckets before are added.
    """
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    edges = sorted({float(e) for e in df.agg(F.percentile_approx(key, shares)).first()[0] or ()})

    def bucket(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(key > F.lit(edges[mid]), bucket(mid + 1, hi)).otherwise(bucket(lo, mid))

    rows = df.withColumns({"_b": bucket(0, len(edges)), "_in": F.col(within) if within else F.lit(0)})
    before = Window.partitionBy("_in").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy("_in", "_b").agg(F.count(F.lit(1)).alias("_c"))
    n = n.select(F.col("_in").alias("_in2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy("_in")).alias("_n"))
    n = cut(n)  # written, so that a split joined with another one of the same table is planned well
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_in", "_b").orderBy(*order)))
    out = rows.join(n, F.col("_in").eqNullSafe(F.col("_in2")) & (F.col("_b") == F.col("_b2")))
    return out.select(*df.columns, (F.col("_o") + F.col("_r") - 1).alias("_rank"), "_n")


def rising(df: DataFrame, col: str) -> Column:
    """A number that rises with a column: itself, or of a text the first seven bytes."""
    if dict(df.dtypes)[col] == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    kind = dict(df.dtypes)[col]
    return F.col(col).cast("timestamp").cast("double") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(col).cast("double")


def hash_place(hashed: Column) -> Column:
    """The first 52 bits of a hash in hexadecimal digits, as a number."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double")


class BaseSplitter(Params):
    def folds(self, df: DataFrame, y: str | None = None) -> DataFrame:
        """``df`` with ``fold``."""
        raise NotImplementedError

    def split(self, df: DataFrame, y: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        rows = self.folds(df, y)
        for f in range(self.n_splits):
            yield rows.where(F.col("fold") != f).drop("fold"), rows.where(F.col("fold") == f).drop("fold")


@splitter
class KFold(BaseSplitter):
    """Blocks of equal size of the rows in order of id, or of its hash when shuffled; the first get the rest."""

    defaults = {"n_splits": 5, "shuffle": False, "random_state": None, "id_col": "row_id"}

    def _by(self):
        return [order_key(self.id_col, self.random_state), F.col(self.id_col)] if self.shuffle else [F.col(self.id_col)]

    def folds(self, df, y=None, within=None):
        key = hash_place(self._by()[0]) if self.shuffle else rising(df, self.id_col)
        rows, k = ranked(df, self._by(), key, within), F.lit(self.n_splits)
        small, rest = F.floor(F.col("_n") / k), F.col("_n") % k
        wide = rest * (small + 1)
        fold = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (small + 1))).otherwise(rest + F.floor((F.col("_rank") - wide) / F.greatest(small, F.lit(1))))
        return rows.withColumn("fold", fold.cast("int")).drop("_rank", "_n")


@splitter
class StratifiedKFold(KFold):
    """Folds of each class of ``y``."""

    def folds(self, df, y=None):
        return super().folds(df, y, y)


@splitter
class HashKFold(KFold):
    """Folds by hash alone: sizes vary by chance, and no rows move.  The one for large tables."""

    def folds(self, df, y=None):
        return df.withColumn("fold", fold_column(self.id_col, self.n_splits, self.random_state or 0))


class _Repeated(BaseSplitter):
    inner: type = KFold
    defaults = {"n_splits": 5, "n_repeats": 10, "random_state": None, "id_col": "row_id"}

    def split(self, df, y=None):
        for r in range(self.n_repeats):
            yield from self.inner(self.n_splits, True, (self.random_state or 0) + r, self.id_col).split(df, y)


@splitter
class RepeatedKFold(_Repeated):
    pass


@splitter
class RepeatedStratifiedKFold(_Repeated):
    inner = StratifiedKFold


@splitter
class GroupKFold(BaseSplitter):
    """The i-th group in order goes to fold i mod k."""

    defaults = {"n_splits": 5, "group_col": "group"}

    def folds(self, df, y=None):
        g = df.select(F.col(self.group_col).alias("_g")).where("_g is not null").distinct()
        g = ranked(g, [F.col("_g")], rising(g, "_g")).select("_g", F.pmod("_rank", F.lit(self.n_splits)).cast("int").alias("fold"))
        return df.join(g, F.col(self.group_col) == F.col("_g")).drop("_g")


@splitter
class StratifiedGroupKFold(GroupKFold):
    """Groups, ordered by their main class and size, are dealt in turn."""

    defaults = {"n_splits": 5, "shuffle": False, "random_state": None, "group_col": "group"}

    def folds(self, df, y=None):
        n = df.groupBy(F.col(self.group_col).alias("_g"), F.col(y).alias("_y")).count()
        g = n.groupBy("_g").agg(F.max(F.struct("count", "_y"))["_y"].alias("_y"), F.sum("count").alias("_n"))
        g = g.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("_y").orderBy(F.desc("_n"), "_g")) - 1, F.lit(self.n_splits))).select("_g", "fold")
        return df.join(g, F.col(self.group_col) == F.col("_g")).drop("_g")


def holdout(df: DataFrame, test_size: float = 0.25, stratify: str | None = None, id_col: str = "row_id", seed: int | None = 0, shuffle: bool = True) -> DataFrame:
    """``df`` with ``is_test``: exactly int(n * share) rows (of each class max(1, that))."""
    by = [order_key(id_col, seed), F.col(id_col)] if shuffle else [F.col(id_col).desc()]
    rows = ranked(df, by, hash_place(by[0]) if shuffle else -rising(df, id_col), stratify)
    take = F.floor(F.col("_n") * F.lit(test_size)) if isinstance(test_size, float) else F.lit(test_size)
    take = F.greatest(take, F.lit(1)) if stratify else take
    return rows.withColumn("is_test", F.col("_rank") < take).drop("_rank", "_n")


def train_test_split(df, test_size=0.25, train_size=None, shuffle=True, stratify=None, random_state=None, id_col="row_id"):
    rows = holdout(df, 1 - train_size if train_size is not None and test_size is None else test_size, stratify, id_col, random_state, shuffle)
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


@splitter
class HoldoutSplit(BaseSplitter):
    defaults = {"test_size": 0.3, "shuffle": True, "random_state": None, "id_col": "row_id"}

    def split(self, df, y=None):
        yield train_test_split(df, self.test_size, shuffle=self.shuffle, random_state=self.random_state, id_col=self.id_col)


@splitter
class StratifiedHoldoutSplit(HoldoutSplit):
    def split(self, df, y=None):
        yield train_test_split(df, self.test_size, shuffle=self.shuffle, stratify=y, random_state=self.random_state, id_col=self.id_col)


@splitter
class ShuffleSplit(BaseSplitter):
    defaults = {"n_splits": 10, "test_size": 0.1, "train_size": None, "random_state": None, "id_col": "row_id"}
    stratified = False

    def split(self, df, y=None):
        for i in range(self.n_splits):
            yield train_test_split(df, self.test_size, stratify=y if self.stratified else None, random_state=(self.random_state or 0) + i, id_col=self.id_col)


@splitter
class StratifiedShuffleSplit(ShuffleSplit):
    stratified = True


@splitter
class LeavePOut(BaseSplitter):
    defaults = {"p": 2, "id_col": "row_id"}

    def split(self, df, y=None):
        ids = [r[0] for r in df.select(self.id_col).orderBy(self.id_col).limit(10_001).collect()]
        if len(ids) > 10_000:
            raise ValueError("leave-out splits are for small tables")
        for out in itertools.combinations(ids, self.p):
            inside = F.col(self.id_col).isin(*out)
            yield df.where(~inside), df.where(inside)


@splitter
class LeaveOneOut(LeavePOut):
    defaults = {"id_col": "row_id"}
    p = 1


@splitter
class BootstrapSplit(BaseSplitter):
    """Each row comes a Poisson number of times into training; rows that never do are the test rows."""

    defaults = {"n_iterations": 100, "sample_size": 1.0, "random_state": None, "id_col": "row_id"}

    def split(self, df, y=None):
        for i in range(self.n_iterations):
            u, p, cum, times = uniform(self.id_col, (self.random_state or 0) + i), 2.718281828459045 ** -self.sample_size, 0.0, F.lit(0)
            for k in range(12):
                cum += p
                times = times + (u >= cum).cast("int")
                p *= self.sample_size / (k + 1)
            rows = df.withColumn("_n", times)
            yield rows.where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i"), rows.where("_n = 0").drop("_n")


@splitter
class TimeSeriesSplit(BaseSplitter):
    """Growing training windows, a gap, then the next block in time order."""

    defaults = {"n_splits": 5, "test_size": None, "gap": 0, "max_train_size": None, "order_by": "t"}

    def split(self, df, y=None):
        n = df.count()
        size = self.test_size or n // (self.n_splits + 1)
        rows = ranked(df, [F.col(self.order_by)], rising(df, self.order_by)).drop("_n").withColumnRenamed("_rank", "_i")
        for f in range(self.n_splits):
            start = n - (self.n_splits - f) * size
            end = start - self.gap
            low = max(0, end - self.max_train_size) if self.max_train_size else 0
            yield rows.where(F.col("_i").between(low, end - 1)).drop("_i"), rows.where(F.col("_i").between(start, start + size - 1)).drop("_i")

"""Projections: scaling, imputation, encoding, discretization, outliers, lags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..base import Filter, SupervisedTransformer, Transformer, clean, filter_method, numeric_columns, one_row, transformer


def _lookup(c: Column, table: dict, default: Column) -> Column:
    """A value from a small map in the plan."""
    if not table:
        return default
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), c), default)


def numbered(rows: DataFrame, c: str) -> DataFrame:
    """``_kept, _code``: the values of a sorted table, numbered from 0 in its order where they are."""
    kept = T.StructType([T.StructField("_kept", rows.schema[c].dataType), T.StructField("_code", T.DoubleType())])
    return rows.sparkSession.createDataFrame(rows.select(c).rdd.zipWithIndex().map(lambda x: (x[0][0], float(x[1]))), kept)


class _Columns(Transformer):
    """Keeps numbers for each column from one aggregate; ``_stats`` names them and ``_apply`` uses them."""

    def _stats(self, c: str) -> dict[str, Column]:
        return {}

    def _apply(self, c: str, s: dict) -> Column:
        raise NotImplementedError

    def fit(self, df: DataFrame, y: str | None = None):
        self.names = numeric_columns(df, self.columns, skip=(y,))
        row = one_row(df, [e.alias(f"{i}.{k}") for i, c in enumerate(self.names) for k, e in self._stats(c).items()])
        self.stats = {c: {k: row[f"{i}.{k}"] for k in self._stats(c)} for i, c in enumerate(self.names)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._apply(c, self.stats[c]) for c in self.names})


@transformer
class CenterScaler(_Columns):
    """Subtracts the mean."""

    defaults = {"columns": None}

    def _stats(self, c):
        return {"mean": F.avg(clean(c))}

    def _apply(self, c, s):
        return clean(c) - F.lit(s["mean"])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) + F.lit(self.stats[c]["mean"]) for c in self.names})


@transformer
class MinMaxScaler(_Columns):
    """(x - min) / range * scale + translation; a range of 0 counts as 1."""

    defaults = {"scale": 1.0, "translation": 0.0, "columns": None}

    def _stats(self, c):
        return {"min": F.min(clean(c)), "max": F.max(clean(c))}

    @staticmethod
    def _range(s):
        return ((s["max"] or 0) - (s["min"] or 0)) or 1.0

    def _apply(self, c, s):
        return (clean(c) - F.lit(s["min"])) / F.lit(self._range(s)) * F.lit(float(self.scale)) + F.lit(float(self.translation))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.translation) / self.scale * self._range(s) + s["min"] for c, s in self.stats.items()})


@transformer
class StandardScaler(_Columns):
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""

    defaults = {"with_mean": True, "with_std": True, "columns": None}

    def _stats(self, c):
        return {"mean": F.avg(clean(c)), "std": F.stddev_pop(clean(c))}

    def _apply(self, c, s):
        x = clean(c) - F.lit(s["mean"]) if self.with_mean else clean(c)
        return x / F.lit(s["std"] or 1.0) if self.with_std else x

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit((s["std"] or 1.0) if self.with_std else 1.0) + F.lit(s["mean"] if self.with_mean else 0.0) for c, s in self.stats.items()})


@transformer
class SimpleImputer(_Columns):
    """mean, median, most_frequent (the smallest of ties) or constant; a column without any value becomes 0."""

    defaults = {"strategy": "mean", "fill_value": None, "columns": None}

    def _stats(self, c):
        kinds = {"mean": F.avg(clean(c)), "median": F.median(clean(c)), "most_frequent": F.mode(clean(c), True), "constant": F.lit(self.fill_value)}
        if self.strategy not in kinds:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        return {"fill": F.first(kinds["constant"]) if self.strategy == "constant" else kinds[self.strategy]}

    def _apply(self, c, s):
        fill = self.fill_value if self.strategy == "constant" else s["fill"]
        return F.coalesce(clean(c), F.lit(0.0 if fill is None else float(fill)))


class _Categories(Transformer):
    """Keeps a bounded table of a column's categories."""

    #: A column with more categories than this is no nominal one.
    max_categories = 100_000

    def _text_columns(self, df: DataFrame, y):
        if self.columns is not None:
            return numeric_columns(df, self.columns)
        return [c for c, t in df.dtypes if t == "string" and c != y]

    def _order(self, df: DataFrame, c: str) -> list:
        """Categories, sorted."""
        got = [r[0] for r in df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(self.max_categories + 1).collect()]
        if len(got) > self.max_categories:
            raise ValueError(f"{c} has more than {self.max_categories} categories")
        return got


@transformer
class OneHotEncoder(_Categories):
    """A 0/1 column ``{col}_{category}`` for each category in order; unseen values give zeros only."""

    defaults = {"categories": None, "drop": None, "columns": None}

    def fit(self, df, y=None):
        self.names = self._text_columns(df, y)
        self.seen = {c: list(self.categories[c]) if self.categories and c in self.categories else self._order(df, c) for c in self.names}
        for c, cats in self.seen.items():
            if self.drop == "first" or self.drop == "if_binary" and len(cats) == 2:
                self.seen[c] = cats[1:]
        return self

    def transform(self, df):
        new = {f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c in self.names for v in self.seen[c]}
        return df.withColumns(new).drop(*self.names)


@transformer
class OrdinalEncoder(_Categories):
    """Codes by first appearance in the order of ``order_by`` (else sorted) or in the given order; unseen -1.

    The codes of more than ``max_categories`` categories stay a table that is joined.
    """

    defaults = {"categories": None, "columns": None, "order_by": None}

    def fit(self, df, y=None):
        self.names = self._text_columns(df, y)
        self.codes, self.tables = {}, {}
        for c in self.names:
            if self.categories and c in self.categories:
                self.codes[c] = {v: float(i) for i, v in enumerate(self.categories[c])}
                continue
            if self.order_by:
                first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct(*[F.col(o) for o in ([self.order_by] if isinstance(self.order_by, str) else self.order_by)])).alias("o"))
                rows = first.orderBy("o", c).select(c)
            else:
                rows = df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().orderBy(c)
            cats = [r[0] for r in rows.limit(self.max_categories + 1).collect()]
            if len(cats) > self.max_categories:
                self.tables[c] = numbered(rows, c)
            else:
                self.codes[c] = {v: float(i) for i, v in enumerate(cats)}
        return self

    def transform(self, df):
        for c, table in self.tables.items():
            df = df.join(table, F.col(c) == F.col("_kept"), "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(-1.0)))).drop("_kept", "_code")
        return df.withColumns({c: F.when(F.col(c).isNotNull(), _lookup(F.col(c), codes, F.lit(-1.0))) for c, codes in self.codes.items()})


@transformer
class LabelEncoder(OrdinalEncoder):
    """As OrdinalEncoder, for label columns."""


@transformer
class RareCategoryEncoder(_Categories):
    """Values that occur fewer than ``min_frequency`` times (below 1: that share of rows) become ``merged_value``."""

    defaults = {"min_frequency": 5, "columns": None, "merged_value": -1}

    def fit(self, df, y=None):
        self.names = self._text_columns(df, y)
        n = df.count() if 0 < self.min_frequency < 1 else 0
        least = int(self.min_frequency * n) if n else self.min_frequency
        self.frequent = {c: df.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= least).select(c) for c in self.names}
        return self

    def transform(self, df):
        for c in self.names:
            kept = self.frequent[c].withColumnRenamed(c, "_kept").distinct()
            df = df.join(kept, F.col(c) == F.col("_kept"), "left").withColumn(c, F.when(F.col(c).isNull() | F.col("_kept").isNotNull(), F.col(c)).otherwise(F.lit(str(self.merged_value)).cast(dict(df.dtypes)[c]))).drop("_kept")
        return df


def digitize(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x: bins closed on the left."""
    total = F.lit(0)
    for e in edges:
        total = total + (x >= F.lit(float(e))).cast("int")
    return total


class _Edges(_Columns):
    def _edges(self, s: dict) -> list[float]:
        raise NotImplementedError

    def _apply(self, c, s):
        return digitize(clean(c), self._edges(s)).cast("double")


@transformer
class EqualWidthDiscretizer(_Edges):
    """Bins of equal width between minimum and maximum."""

    defaults = {"n_bins": 10, "columns": None}

    def _stats(self, c):
        return {"min": F.min(clean(c)), "max": F.max(clean(c))}

    def _edges(self, s):
        lo, hi = s["min"] or 0.0, s["max"] or 0.0
        return [lo + (hi - lo) * i / self.n_bins for i in range(1, self.n_bins)]


@transformer
class QuantileDiscretizer(_Edges):
    """Bins of equal counts between exact percentiles; ``approximate`` uses a sketch of bounded size instead."""

    defaults = {"n_bins": 10, "columns": None, "approximate": False}

    def _stats(self, c):
        at = [i / self.n_bins for i in range(self.n_bins + 1)]
        return {"q": F.percentile_approx(clean(c), at, 100_000) if self.approximate else F.percentile(clean(c), F.array(*map(F.lit, at)))}

    def _edges(self, s):
        edges = sorted(set(s["q"] or ()))
        return edges[1:-1] if len(edges) > 2 else []


@transformer
class MDLDiscretizer(SupervisedTransformer):
    """Recursive cuts of greatest information gain with ``min_instances`` rows on both sides.

    Candidate cuts come from class counts by distinct value, or by ``max_values`` quantile cells of a column that
    has more; so the driver holds at most so many rows of counts for each column.
    """

    defaults = {"min_instances": 10, "columns": None, "max_values": 10_000}

    def fit(self, df, y=None):
        import numpy as np

        self.names = numeric_columns(df, self.columns, skip=(y,))
        self.cuts = {}
        for c in self.names:
            rows = df.select(clean(c).alias("x"), F.col(y).alias("y")).dropna()
            if rows.select("x").distinct().count() > self.max_values:
                edges = one_row(rows, [F.percentile_approx("x", [i / self.max_values for i in range(1, self.max_values)], 1_000_000).alias("q")])["q"]
                arr = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
                rows = rows.withColumn("x", F.element_at(F.filter(arr, lambda e: e <= F.col("x")), -1))
            table = rows.groupBy("x").pivot("y").count().fillna(0).orderBy("x").toPandas()
            x, n = table["x"].to_numpy(float), table.drop(columns="x").to_numpy(float)
            cuts: list[float] = []

            def entropy(k):
                p = k / np.maximum(k.sum(axis=-1, keepdims=True), 1)
                return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)

            stack = [(0, len(x))]
            while stack:
                lo, hi = stack.pop()
                if hi - lo < 2:
                    continue
                left = n[lo:hi].cumsum(axis=0)
                total = left[-1]
                a, b = left[:-1], total - left[:-1]
                gain = entropy(total) - (a.sum(1) * entropy(a) + b.sum(1) * entropy(b)) / total.sum()
                gain[(a.sum(1) < self.min_instances) | (b.sum(1) < self.min_instances)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-12:
                    cuts.append((x[lo + k] + x[lo + k + 1]) / 2)
                    stack += [(lo, lo + k + 1), (lo + k + 1, hi)]
            self.cuts[c] = sorted(cuts)
        return self

    def transform(self, df):
        return df.withColumns({c: digitize(clean(c), self.cuts[c]).cast("double") for c in self.names})


@transformer
class ValueClipper(_Columns):
    """Clips to fixed bounds or to exact percentiles (low, high in 0..100)."""

    defaults = {"lower": None, "upper": None, "percentile": None, "columns": None}

    def _stats(self, c):
        if self.percentile is None:
            return {"n": F.count(F.lit(1))}
        lo, hi = self.percentile if isinstance(self.percentile, (tuple, list)) else (100 - self.percentile, self.percentile)
        return {"q": F.percentile(clean(c), F.array(F.lit(min(lo, hi) / 100), F.lit(max(lo, hi) / 100)))}

    def _apply(self, c, s):
        lo, hi = s["q"] or (None, None) if "q" in s else (self.lower, self.upper)
        x = clean(c)
        low = F.greatest(x, F.lit(float(lo))) if lo is not None else x
        high = F.least(low, F.lit(float(hi))) if hi is not None else low
        return F.when(x.isNotNull(), high)


@filter_method
class IQROutlierDetector(_Columns, Filter):
    """Values beyond quartiles -+ factor * range are clipped, made null, or their rows removed."""

    defaults = {"factor": 1.5, "action": "clip", "columns": None}

    def _stats(self, c):
        return {"q": F.percentile(clean(c), F.array(F.lit(0.25), F.lit(0.75)))}

    def bounds(self, s):
        q1, q3 = s["q"] or (0.0, 0.0)
        return q1 - self.factor * (q3 - q1), q3 + self.factor * (q3 - q1)

    def _apply(self, c, s):
        lo, hi = self.bounds(s)
        x = clean(c)
        inside = x.between(lo, hi)
        return F.when(inside, x) if self.action == "nan" else F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))

    def transform(self, df):
        if self.action != "remove":
            return super().transform(df)
        for c in self.names:
            df = df.where(clean(c).isNull() | clean(c).between(*self.bounds(self.stats[c])))
        return df


class _Shift(Transformer):
    """Values ``lag`` rows away (negative: earlier rows) within ``partition_by`` in the order of ``order_by``."""

    defaults = {"lag": -1, "columns": None, "fill_with_missing": True, "invert_selection": False, "order_by": None, "partition_by": None}

    def _expr(self, c: str, moved: Column) -> Column:
        raise NotImplementedError

    def transform(self, df):
        by = [self.partition_by] if isinstance(self.partition_by, str) else list(self.partition_by or ())
        order = [self.order_by] if isinstance(self.order_by, str) else list(self.order_by or ())
        if not order:
            raise ValueError("order_by is needed: rows have no order of their own")
        names = numeric_columns(df, None if self.invert_selection else self.columns, skip=(*by, *order))
        if self.invert_selection:
            names = [c for c in names if c not in numeric_columns(df, self.columns or [])]
        w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)
        move = lambda c: F.lag(clean(c), -self.lag).over(w) if self.lag < 0 else F.lead(clean(c), self.lag).over(w)
        out = df.withColumns({self._name(c): self._expr(c, move(c)) for c in names} | ({} if self.fill_with_missing else {"_there": (F.lag(F.lit(1), -self.lag) if self.lag < 0 else F.lead(F.lit(1), self.lag)).over(w)}))
        return out if self.fill_with_missing else out.where("_there = 1").drop("_there")


@transformer
class LagTransformer(_Shift):
    """Adds ``x-1``: the value one row earlier (or ``x+1`` for leads)."""

    def _name(self, c):
        return f"{c}{self.lag:+d}"

    def _expr(self, c, moved):
        return moved


@transformer
class DifferenceTransformer(_Shift):
    """Replaces values by their difference to the row ``lag`` away; null if either is missing."""

    def _name(self, c):
        return c

    def _expr(self, c, moved):
        return clean(c) - moved

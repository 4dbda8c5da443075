"""Distances and neighbour joins.

The exact k-nearest join reads the query side in blocks of bounded size; each block is sent to the partitions of the
reference side, which return their k best for each query, and these few are merged.  So neither side is collected,
no pair of rows is ever a row, and the reference side is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..base import Classifier, Params, Regressor, Transformer, classifier, clean, numeric_columns, regressor, transformer

# ---------------------------------------------------------------- distances as expressions


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _zip(a, b, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a, b) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def chebyshev_distance(a, b) -> Column:
    return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a, b) -> Column:
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - _sum(_zip(a, b, lambda x, y: x * y)) / n).otherwise(1.0)


def minkowski_distance(a, b, p: float = 2) -> Column:
    return F.pow(_sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


DISTANCES = {"euclidean": euclidean_distance, "manhattan": manhattan_distance, "chebyshev": chebyshev_distance, "cosine": cosine_distance, "minkowski": minkowski_distance}


def get_distance_function(name: str):
    return DISTANCES[name]


def matrix_distance(x: np.ndarray, y: np.ndarray, metric: str = "euclidean", p: float = 2) -> np.ndarray:
    """Distances of two small blocks of rows."""
    if metric == "euclidean":
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        near = d < 1e-6 * ((x * x).sum(1)[:, None] + 1e-300)
        d = np.sqrt(np.maximum(d, 0))
        i, j = np.nonzero(near)  # cancellation: again from the differences
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            d[a, b] = np.sqrt(((x[a] - y[b]) ** 2).sum(1))
        return d
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
        return np.where(n > 0, 1 - x @ y.T / np.where(n > 0, n, 1), 1.0)
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        d = np.abs(y - row)
        out[i] = d.sum(1) if metric == "manhattan" else d.max(1) if metric == "chebyshev" else (d**p).sum(1) ** (1 / p)
    return out


def pairwise_distances(df: DataFrame, other: DataFrame | None, id_col: str, vector_col: str, metric: str = "euclidean", **kw) -> DataFrame:
    """``i, j, distance`` of all pairs of two tables, or of i < j of one.  For small tables: it has n * m rows."""
    a = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("_a"))
    b = (other if other is not None else df).select(F.col(id_col).alias("j"), F.col(vector_col).alias("_b"))
    pairs = a.join(b, F.col("i") < F.col("j")) if other is None else a.crossJoin(b)
    return pairs.select("i", "j", DISTANCES[metric]("_a", "_b", **kw).alias("distance"))


cdist = pairwise_distances


def _of_metric(metric: str):
    def pairwise(df: DataFrame, other: DataFrame | None, id_col: str, vector_col: str, **kw) -> DataFrame:
        return pairwise_distances(df, other, id_col, vector_col, metric, **kw)

    pairwise.__doc__ = f"``i, j, distance`` of all pairs by {metric} distance; see :func:`pairwise_distances`."
    return pairwise


euclidean_pairwise = _of_metric("euclidean")
manhattan_pairwise = _of_metric("manhattan")
chebyshev_pairwise = _of_metric("chebyshev")
cosine_pairwise = _of_metric("cosine")
minkowski_pairwise = _of_metric("minkowski")


def pdist(df, id_col, vector_col, metric="euclidean"):
    return pairwise_distances(df, None, id_col, vector_col, metric)


# ---------------------------------------------------------------- blocks


def row_blocks(df: DataFrame, columns: list[str], rows: int = 4096) -> Iterator[pd.DataFrame]:
    """A table in blocks of rows, as it comes to the driver one partition at a time."""
    held: list = []
    for r in df.select(*columns).toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r))
        if len(held) == rows:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    if len(features) == 1 and len(pdf) and isinstance(pdf[features[0]].iloc[0], (list, np.ndarray)):
        return np.stack([np.asarray(v, float) for v in pdf[features[0]]])
    return pdf[features].to_numpy(float)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, features: list[str] | str, id_col: str = "row_id", metric: str = "euclidean", exclude_self: bool = False, carry: list[str] = (), block_rows: int = 4096) -> DataFrame:
    """``query, neighbor, distance, rank`` and the columns ``carry`` of the neighbour; ties go to the smaller id.

    ``features``: numeric columns, or one array column.
    """
    feats = [features] if isinstance(features, str) else list(features)
    ref = refs.select(F.col(id_col).alias("_id"), *[c for c in dict.fromkeys([*feats, *carry]) if c != id_col])
    key = ref.schema["_id"].dataType.simpleString()
    extra = "".join(f", `{c}` {refs.schema[c].dataType.simpleString()}" for c in carry)
    spark, parts = queries.sparkSession, []

    def best_of(held):
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            top: list[pd.DataFrame] = []
            for pdf in batches:
                pdf = pdf.dropna(subset=feats).reset_index(drop=True)
                if not len(pdf):
                    continue
                d = matrix_distance(q, _matrix(pdf, feats), metric)
                if exclude_self:
                    d[ids[:, None] == pdf["_id"].to_numpy()[None]] = np.inf
                m = min(k, d.shape[1])
                order = np.lexsort((np.broadcast_to(pdf["_id"].to_numpy(), d.shape), d), axis=1)[:, :m]
                rows = np.repeat(np.arange(len(ids)), m)
                part = pdf.iloc[order.ravel()][["_id", *carry]].reset_index(drop=True)
                part.insert(0, "_q", ids[rows])
                part.insert(2, "_d", d[rows, order.ravel()])
                top.append(part[np.isfinite(part["_d"])])
                if len(top) > 8:
                    top = [pd.concat(top).sort_values(["_q", "_d", "_id"]).groupby("_q").head(k)]
            if top:
                yield pd.concat(top).sort_values(["_q", "_d", "_id"]).groupby("_q").head(k)

        return best

    for block in row_blocks(queries.dropna(subset=feats), [id_col, *[f for f in feats if f != id_col]], block_rows):
        held = spark.sparkContext.broadcast((block[id_col].to_numpy(), _matrix(block, feats)))
        parts.append(ref.mapInPandas(best_of(held), f"_q {key}, _id {key}, _d double{extra}"))
    if not parts:
        return spark.createDataFrame([], f"query {key}, neighbor {key}, distance double, rank int{extra}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("_q").orderBy("_d", "_id"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("_q").alias("query"), F.col("_id").alias("neighbor"), F.col("_d").alias("distance"), "rank", *carry)


def sums_to_block(df, features, labels, metric, id_col, blocks) -> DataFrame:
    """Silhouettes: of each row of each block, summed distances to every cluster, gathered from the partitions."""
    spark, parts = df.sparkSession, []
    ref = df.select(F.col(labels).alias("_k"), *features)

    def of(held):
        def run(batches):
            ids, own, q = held.value
            sums: dict = {}
            for pdf in batches:
                for lab, part in pdf.groupby("_k"):
                    d = matrix_distance(q, _matrix(part, features), metric)
                    s = sums.setdefault(lab, [np.zeros(len(ids)), 0])
                    s[0] += d.sum(axis=1)
                    s[1] += len(part)
            for lab, (s, n) in sums.items():
                yield pd.DataFrame({"id": ids, "own": own, "other": lab, "s": s, "n": n})

        return run

    kind, key = df.schema[labels].dataType.simpleString(), df.schema[id_col].dataType.simpleString()
    for b in blocks:
        held = spark.sparkContext.broadcast((b[id_col].to_numpy(), b[labels].to_numpy(), _matrix(b, features)))
        parts.append(ref.mapInPandas(of(held), f"id {key}, own {kind}, other {kind}, s double, n long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    per = out.groupBy("id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = F.max(F.when((F.col("own") == F.col("other")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    b = F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n")))
    per = per.groupBy("id").agg(a.alias("a"), b.alias("b"))
    return per.select(F.col("id").alias(id_col), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


class NearestNeighborSearch(Params):
    """``build(refs)``, then ``query(queries)``; all kinds give the exact neighbours."""

    defaults = {"k": 5, "metric": "euclidean", "id_col": "row_id"}

    def build(self, refs: DataFrame, features):
        self.refs, self.features = refs, features
        return self

    def query(self, queries: DataFrame, k: int | None = None, **kw) -> DataFrame:
        return knn_join(queries, self.refs, k or self.k, self.features, self.id_col, self.metric, **kw)


LinearNNSearch = NearestNeighborSearch


class KDTree(NearestNeighborSearch):
    defaults = NearestNeighborSearch.defaults | {"leaf_size": 10}


class BallTree(KDTree):
    pass


class _Neighbours:
    def _fit(self, df, label, features):
        self._names(df, label, features)
        self.train = df.select(self.id_col, *self.features, F.col(label).alias("_label")).where(F.col("_label").isNotNull())
        return self

    def _near(self, df):
        near = knn_join(df, self.train, self.k, self.features, self.id_col, self.metric, carry=["_label"])
        d = F.col("distance") ** 2 if self.squared else F.col("distance")
        w = {"uniform": F.lit(1.0), "inverse": F.when(d > 0, 1 / d).otherwise(1e10), "similarity": 1 / (1 + d)}[self.distance_weighting]
        return near.withColumn("_w", w)


_KNN = {"k": 1, "distance_weighting": "uniform", "search_algorithm": "brute", "metric": "euclidean", "squared": False, "id_col": "row_id"}


@classifier
class KNearestNeighborsClassifier(_Neighbours, Classifier):
    """Weighted vote of the k nearest rows; ties go to the smaller class."""

    defaults = _KNN

    def fit(self, df, label=None, features=None):
        return self._fit(df, label, features)

    def predict(self, df):
        votes = self._near(df).groupBy("query", "_label").agg(F.sum("_w").alias("v"))
        best = votes.groupBy("query").agg(F.min(F.struct(-F.col("v"), "_label"))["_label"].alias("prediction"), F.map_from_entries(F.collect_list(F.struct("_label", "v"))).alias("_votes"))
        total = F.aggregate(F.map_values("_votes"), F.lit(0.0), lambda a, x: a + x)
        best = best.withColumn("probability", F.transform_values("_votes", lambda k, v: v / total)).drop("_votes")
        return df.join(best, F.col(self.id_col) == F.col("query"), "left").drop("query")


@regressor
class KNearestNeighborsRegressor(_Neighbours, Regressor):
    """Weighted mean of the k nearest rows."""

    defaults = _KNN

    def fit(self, df, label=None, features=None):
        return self._fit(df, label, features)

    def predict(self, df):
        mean = self._near(df).groupBy("query").agg((F.sum(F.col("_w") * F.col("_label")) / F.sum("_w")).alias("prediction"))
        return df.join(mean, F.col(self.id_col) == F.col("query"), "left").drop("query")


@transformer
class KNNImputer(Transformer):
    """Fills a column from the k rows nearest in the other columns, by mean or by inverse distance.

    Other columns are filled with their means for the distance; so each column is one neighbour join of the rows
    that lack it against those that have it.
    """

    defaults = {"n_neighbors": 5, "weights": "uniform", "columns": None, "id_col": "row_id"}

    def fit(self, df, y=None):
        self.names = [c for c in numeric_columns(df, self.columns, skip=(y, self.id_col))]
        row = df.agg(*[F.avg(clean(c)).alias(c) for c in self.names]).first().asDict()
        self.means = {c: v or 0.0 for c, v in row.items()}
        self.train = df.select(self.id_col, *[clean(c).alias(c) for c in self.names])
        return self

    def transform(self, df):
        out = df.withColumns({c: clean(c) for c in self.names})
        for c in self.names:
            rest = [x for x in self.names if x != c]
            fill = {x: F.coalesce(clean(x), F.lit(self.means[x])) for x in rest}
            if not rest or out.where(F.col(c).isNull()).isEmpty():
                out = out.fillna({c: self.means[c]})
                continue
            near = knn_join(df.where(clean(c).isNull()).withColumns(fill), self.train.where(F.col(c).isNotNull()).withColumns(fill), self.n_neighbors, rest, self.id_col, carry=[c])
            w = F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-10))
            got = near.groupBy("query").agg((F.sum(w * F.col(c)) / F.sum(w)).alias("_fill"))
            out = out.join(got, F.col(self.id_col) == F.col("query"), "left").withColumn(c, F.coalesce(c, "_fill", F.lit(self.means[c]))).drop("query", "_fill")
        return out

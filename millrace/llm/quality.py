"""Operator 5: quality classifier over random-indexing word vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, table
from .toxicity import crc_fold, sample_labelled

#: Labelled rows that are fitted on at most (in expectation); the sample is a seeded hash of the id.
MAX_TRAIN = 20_000
#: Hash buckets of words and numbers of a vector: the table of vectors is BUCKETS * DIM numbers whatever the corpus.
BUCKETS, DIM, WINDOW = 8_192, 32, 2
THRESHOLD = 0.3
_RUN = re.compile(r"(.)\1+", re.S)
_ASCII = str.maketrans({**{c: "a" for c in map(chr, range(97, 123))}, **{c: "A" for c in map(chr, range(65, 91))}, **{c: "0" for c in "0123456789"}})
#: Words whose buckets a cache keeps; beyond, it starts anew.
CACHED = 500_000
_LOW = BUCKETS.bit_length() - 1


def _bucket(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 23) % BUCKETS


class _Words(dict):
    """Of a word: the bucket of its letters (upper bits) and of its shape (runs of classes of characters; lower bits)."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, w: str) -> int:
        if len(self) > CACHED:
            self.clear()
            self.shapes.clear()
        raw = w.translate(_ASCII)
        if not w.isascii():
            raw = "".join("a" if c.islower() else "A" if c.isupper() else c for c in raw)
        if (shape := self.shapes.get(raw, -1)) < 0:
            shape = self.shapes[raw] = _bucket("s" + _RUN.sub(r"\1", raw))
        letters = w if w.isalpha() else "".join(filter(str.isalpha, w))
        out = self[w] = _bucket("w" + letters.lower()) << _LOW | shape
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text's words and of their shapes."""
        found = (text or "").split()
        both = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return both >> _LOW, both & BUCKETS - 1


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse index vectors: of each bucket the places of one +1 and one -1; the last row, of a gap, is empty."""
    rng = np.random.default_rng(99)
    plus = rng.integers(0, DIM, BUCKETS)
    minus = (plus + rng.integers(1, DIM, BUCKETS)) % DIM
    return np.r_[plus, DIM], np.r_[minus, DIM]


def _add_contexts(total: np.ndarray, ids: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> None:
    """Add to each word's vector the index vectors of its neighbours; ids has gaps (BUCKETS) between texts."""
    for gap in range(1, WINDOW + 1):
        for a, b in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
            base = a * (DIM + 1)
            total += np.bincount(base + plus[b], minlength=len(total))
            total -= np.bincount(base + minus[b], minlength=len(total))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors (BUCKETS, DIM) from the contexts of all words of all texts, each of unit length.

    Each task sums over its rows and gives a row for each bucket that it met; these are summed by bucket.
    """

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plus, minus = _index_vectors()
        words, total = _Words(), np.zeros((BUCKETS + 1) * (DIM + 1))
        gap = np.full(WINDOW, BUCKETS)
        for pdf in batches:
            seq: list[np.ndarray] = []
            held = 0
            for t in pdf["t"]:
                letters, shapes = words.of(t)
                seq += [letters, gap, shapes, gap]
                held += 2 * len(letters)
                if held > 200_000:
                    _add_contexts(total, np.concatenate(seq), plus, minus)
                    seq, held = [], 0
            if seq:
                _add_contexts(total, np.concatenate(seq), plus, minus)
        rows = total.reshape(BUCKETS + 1, DIM + 1)[:BUCKETS, :DIM]
        met = np.flatnonzero(np.abs(rows).sum(axis=1))
        yield pd.DataFrame({"b": met, **{f"c{i}": rows[met, i] for i in range(DIM)}})

    cols = [f"c{i}" for i in range(DIM)]
    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(contexts, "b int, " + ", ".join(f"{c} double" for c in cols))
    pdf = parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(pdf):
        x = pdf[cols].to_numpy()
        out[pdf["b"].to_numpy()] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def pooled(text: str | None, vectors: np.ndarray, words: _Words) -> np.ndarray:
    """Of a whole text: mean vector of its words, of their shapes, and its length and share of distinct words as
    soft steps.  No words give zeros."""
    letters, shapes = words.of(text)
    out = np.zeros(2 * DIM + 16, np.float32)
    if n := len(letters):
        out[:DIM] = vectors.take(letters, axis=0).mean(axis=0)
        out[DIM : 2 * DIM] = vectors.take(shapes, axis=0).mean(axis=0)
        distinct = len(np.unique(letters)) / n
        out[2 * DIM : 2 * DIM + 8] = np.clip(np.log2(n + 1) - np.arange(0, 16, 2), -1, 1)
        out[2 * DIM + 8 :] = np.clip((distinct - np.arange(8) / 8) * 8, -1, 1)
    return out


@dataclass
class Network:
    """Two layers with a temperature: sigmoid((tanh(x A + a) B + b) / t)."""

    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, ab, b, bb = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + ab) @ b + bb

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 8) -> Network:
        """Adam on the log loss over four fifths of the rows; the temperature is the one with the least log loss on
        the rest."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        cal, fit = order[: len(x) // 5], order[len(x) // 5 :]
        mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z = (x - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(())]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[rows] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
                dh = np.outer(e, p[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[rows].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ e + decay * p[2], e.sum())):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, scale, (p[0], p[1], p[2], float(p[3])))
        if len(cal):
            s = net.logit(x[cal])

            def loss(t: float) -> float:
                return float(np.mean(np.logaddexp(0, s / t) - y[cal] * s / t))

            net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return net


def _pool_column(vectors: Shipped):
    @F.pandas_udf("array<float>")
    def f(texts: pd.Series) -> pd.Series:
        words, held = _Words(), vectors.value
        return texts.map(lambda t: pooled(t, held, words), na_action=None)

    return f


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts) -> np.ndarray:
        words = _Words()
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.score(np.stack([pooled(t, self.vectors, words) for t in texts])) if len(texts) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, id_col: str = "doc_id") -> Model:
    """Word vectors from all texts, and a network on the pooled vectors of a bounded sample of labelled ones.

    Without labelled rows every score is 0.5.
    """
    vectors = word_vectors(docs)
    rows = sample_labelled(docs, labels, label_col, max_train, id_col)
    pdf = rows.select("id", "label", _pool_column(Shipped(docs.sparkSession, vectors))("text").alias("x")).toPandas().sort_values(["id", "label"])
    if len(pdf) < 5:
        return Model(vectors, None)
    x = np.stack(pdf["x"].to_list()).astype(np.float64)
    return Model(vectors, Network.fit(x, pdf["label"].to_numpy(float)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "_score") -> DataFrame:
    """Add the chance that a text is of quality 1; null and empty texts are pooled to zeros and scored as such.
    All rows and columns are kept."""
    held = Shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts.to_list()), index=texts.index)

    return docs.withColumn(out_col, score(F.col(text_col)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality, fitted on labelled documents outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_fold("doc_id", 5) != 0))
    held = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    return with_score(docs, model).select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))

"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shipped, free_prefix, table

#: Labelled rows that are fitted on at most (in expectation); the sample is a seeded hash of the id.
MAX_TRAIN = 12_000
#: Feature numbers that the fitting task holds at most, 4 bytes each, and what a document counts beside its own.
MAX_FEATURES, ROW_COST = 24_000_000, 64
BITS = 18
#: Letters of a word's stem, so that forms of one word share a feature.
STEM = 5
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


#: Words whose hash a cache keeps; beyond, it starts anew.
CACHED = 1 << 16


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11)
        return h


def features(text: str | None, words: _Words, bits: int = BITS) -> np.ndarray:
    """Distinct hashed features of a whole text: words, their stems, pairs of neighbours, and pairs with one word between."""
    found = _WORD.findall((text or "").lower())
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F * gap & (1 << 64) - 1) ^ h[gap:]) * np.uint64(0x165667B19E3779F9))
    stems = {"^" + w[:STEM] for w in found}
    parts.append(np.fromiter(map(words.__getitem__, stems), dtype=np.uint64, count=len(stems)) * np.uint64(0x9E3779B97F4A7C15))
    flags = np.zeros(1 << bits, bool) if len(h) > 20_000 else None
    at = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)
    if flags is not None:
        flags[at] = True
        return np.flatnonzero(flags).astype(np.int32)
    return np.unique(at)


@dataclass
class Ftrl:
    """Weights that are not zero, their places, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0, epochs: int = 4, seed: int = 5) -> Ftrl:
        """FTRL-proximal: each coordinate has a rate of its own, alpha / (beta + root of its squared gradients), and
        is zero while its gradients' sum stays within l1.  A document's features count 1 each."""
        z, n = np.zeros(1 << bits), np.zeros(1 << bits)
        zb = nb = bias = 0.0
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                x, y = rows[k], labels[k]
                zx, nx = z[x], n[x]
                w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
                g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
                sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
                z[x] = zx + g - sigma * w
                n[x] = nx + g * g
                zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * bias
                nb += g * g
                bias = -zb / ((beta + np.sqrt(nb)) / alpha)
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
        at = np.flatnonzero(w)
        return Ftrl(at.astype(np.int32), w[at].astype(np.float32), float(bias), bits)

    def score(self, texts) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.weight
        words = _Words()
        s = np.array([dense[features(t, words, self.bits)].sum(dtype=np.float64) for t in texts], float) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(s, -30, 30)))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of an id's text, modulo ``folds``; null for null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", seed: int = 3) -> DataFrame:
    """``id, text, label`` of about ``most`` labelled documents at most, chosen by a seeded hash of the id.

    The labelled ids that are chosen are at most so many numbers, which is what makes their broadcast safe.  An id
    labelled twice counts once, with its larger label; null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    chosen = known.select(F.col(id_col).alias("id"), F.col("_label").cast("double").alias("label"))
    return docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(chosen), "id").select("id", "text", "label")


def _train(bits: int, most: int):
    """For mapInPandas over one partition in a seeded order: the fitted weights, as one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[np.ndarray] = []
        labels: list[float] = []
        held = 0
        for pdf in batches:
            for x, y in zip(pdf["x"], pdf["label"], strict=True):
                if held <= most:
                    rows.append(np.frombuffer(x, np.int32).copy())
                    labels.append(y)
                    held += len(rows[-1]) + ROW_COST
        if rows:
            m = Ftrl.fit(rows, np.array(labels), bits)
            yield pd.DataFrame({"at": [m.at.tobytes()], "weight": [m.weight.tobytes()], "bias": [m.bias]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_train: int = MAX_TRAIN, id_col: str = "doc_id", bits: int = BITS, max_features: int = MAX_FEATURES) -> Ftrl:
    """Fit on a bounded sample of labelled documents, in one task.

    Features are made where the documents are read.  FTRL is sequential, so the sampled documents' feature numbers
    meet in one partition, in a seeded hash order; its task holds ``max_features`` of them (4 bytes each) and
    ROW_COST for a document at most, so what it takes is a random sample whatever the lengths of texts.  Only the
    weights that are not zero reach the driver.  Rows that repeat a text count once for each label.  Without
    labelled rows every score is that of the intercept -3.
    """

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        words = _Words()
        return texts.map(lambda t: features(t, words, bits).tobytes(), na_action=None)

    rows = sample_labelled(docs, labels, label_col, max_train, id_col)
    once = rows.groupBy(F.xxhash64("text").alias("_t"), "label").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    drawn = once.select(F.xxhash64(F.lit(13), "id").alias("u"), "id", "label", hashed("text").alias("x"))
    one = drawn.repartition(1).sortWithinPartitions("u", "id", "label").select("label", "x")
    got = one.mapInPandas(_train(bits, max_features), "at binary, weight binary, bias double").first()
    if got is None:
        return Ftrl(np.zeros(0, np.int32), np.zeros(0, np.float32), -3.0, bits)
    return Ftrl(np.frombuffer(got["at"], np.int32), np.frombuffer(got["weight"], np.float32), got["bias"], bits)


def with_score(docs: DataFrame, model: Ftrl, text_col: str = "text", out_col: str = "_score") -> DataFrame:
    """Add the chance that a text is toxic.  Null and empty texts have no features: their score is that of the
    intercept.  All rows and columns are kept, but for one named ``out_col``, which is replaced."""
    held = Shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts), index=texts.index)

    return docs.withColumn(out_col, score(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: Ftrl, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; every column is kept, whatever its name."""
    score = free_prefix(docs, "score") + "score"
    return with_score(docs, model, out_col=score).where(F.col(score) < threshold).drop(score)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, fitted on labelled documents outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_fold("doc_id", 4) != 2))
    out = with_score(docs, model)
    held = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))

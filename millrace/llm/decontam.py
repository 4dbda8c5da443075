"""Operator 8: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Shipped, cut, free_prefix, table

#: Masks over consecutive words: a 1 is read, a 0 is ignored.  Substituted words at the 0s leave the hash alone.
#: Each reads 7 words; between them they meet any pattern of up to 2 substitutions in 13 words.
SEEDS = ("1111111", "110110111", "1101010111", "1011100111")
#: A hit counts if in the MIN_WORDS aligned words around it (or the whole item, if it is shorter) at least this
#: share are equal.
MIN_WORDS, MIN_MATCH = 13, 0.8
#: Words of a benchmark that is sent whole: some 150 bytes each on the driver and in each Python worker.  Larger ones
#: are joined.
BLOCK_WORDS = 500_000
_BITS = 22


#: Words whose hash a cache keeps; beyond, it starts anew.
CACHED = 1 << 16


class _Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w, 7)
        return h


def word_hashes(text: str | None, cache: _Words) -> np.ndarray:
    words = ALNUM.findall((text or "").encode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def seed_hashes(w: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of len(mask) words over the words that the mask reads."""
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def masks_of(n_words: int, seeds=SEEDS, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH) -> list[str]:
    """Masks under which an item of so many words is sought.

    An item shorter than ``min_words`` may differ in so many words that only a run of its share of the rest is
    equal for sure, so it has such runs too; one shorter than every mask must stand whole.
    """
    if n_words < min(map(len, seeds)):
        return ["1" * n_words] if n_words else []
    out = [m for m in seeds if len(m) <= n_words]
    if n_words < min_words:
        differ = int(n_words - min_match * n_words + 1e-9)
        out.append("1" * max(1, n_words // (differ + 1)))
    return list(dict.fromkeys(out))


def overlap(w: np.ndarray, x: np.ndarray, shift: int, whole: bool, min_words: int, min_match: float) -> tuple[int, int, float] | None:
    """First word, words and share of equal words of the longest stretch of a text ``w`` that agrees with an item
    ``x`` put at ``shift``; None if no ``min_words`` (or the whole item) agree in a share of ``min_match``."""
    lo, hi = max(0, shift), min(len(w), shift + len(x))
    need = min(min_words, len(x))
    if hi - lo < need:
        return None
    same = w[lo:hi] == x[lo - shift : hi - shift]
    cum = np.r_[0, np.cumsum(same)]
    ok = np.flatnonzero(cum[need:] - cum[:-need] >= (1.0 if whole else min_match) * need - 1e-9)
    if not len(ok):
        return None
    a, b = int(ok[0]), int(ok[-1]) + need
    while not same[a]:
        a += 1
    while not same[b - 1]:
        b -= 1
    return lo + a, b - a, float((cum[b] - cum[a]) / (b - a))


def _order(hit: tuple) -> tuple:
    return (hit[0] is None, hit[0] or 0, *hit[1:])


class Index:
    """Spaced-seed hashes of the items of a small benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], seeds=SEEDS, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH):
        cache = _Words()
        self.shortest, self.min_words, self.min_match = min(map(len, seeds)), min_words, min_match
        self.items = [(i, w) for i, t in items if len(w := word_hashes(t, cache))]
        self.tables = []
        of: dict[str, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            for m in masks_of(len(w), seeds, min_words, min_match):
                of.setdefault(m, []).append(k)
        for mask, members in of.items():
            rows = [(seed_hashes(self.items[k][1], mask), k) for k in members]
            h = np.concatenate([r for r, _ in rows])
            k = np.concatenate([np.full(len(r), k, np.int64) for r, k in rows])
            p = np.concatenate([np.arange(len(r)) for r, _ in rows])
            order = np.argsort(h, kind="stable")
            h = h[order]
            seen = np.zeros(1 << _BITS, bool)
            seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((mask, h, k[order], p[order], seen))

    def find(self, w: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, share of equal words) of every overlap, one for each item and alignment."""
        out: dict[tuple[int, int], tuple[int, int, int, float] | None] = {}
        for mask, h, k, p, seen in self.tables:
            own = seed_hashes(w, mask)
            at = np.flatnonzero(seen[(own >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(h, own[at]), np.searchsorted(h, own[at], side="right")
            for a, s, e in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for j in range(s, e):
                    item, shift = int(k[j]), a - int(p[j])
                    if (item, shift) not in out:
                        i, x = self.items[item]
                        found = overlap(w, x, shift, len(x) < self.shortest, self.min_words, self.min_match)
                        out[item, shift] = found and (i, *found)
        return sorted((x for x in out.values() if x), key=_order)


def _finder(index):
    @F.pandas_udf(_HIT)
    def find(texts: pd.Series) -> pd.Series:
        cache, ix = _Words(), index.value
        return pd.Series([_named(ix.find(word_hashes(t, cache))) for t in texts], index=texts.index, dtype=object)

    return find


def _named(hits: list[tuple]) -> list[dict]:
    return [{"item_id": i, "start": a, "n_words": n, "matched": m} for i, a, n, m in hits]


_HIT = "array<struct<item_id:long,start:int,n_words:int,matched:double>>"
#: Bits of the filter that is sent to the executors for a large benchmark: 32 MB at most, whatever its size.
FILTER_BITS = 28
_SEED = "array<struct<mask:int,h:long,at:int,near:array<long>>>"


def _seeder(masks: list[str], of: dict[int, list[int]] | None, near: int, seen=None):
    """A pandas UDF: each window of a text under each mask, with its hash, place and the words ``near`` it on both
    sides (0 beyond the text).  ``of``: masks for a number of words (of items); ``seen``: only windows whose hash
    may be an item's."""

    @F.pandas_udf(_SEED)
    def f(texts: pd.Series) -> pd.Series:
        cache, bits = _Words(), None if seen is None else seen.value

        def one(t: str | None) -> list[dict]:
            w = word_hashes(t, cache)
            pad = np.r_[np.zeros(near, np.uint64), w, np.zeros(near, np.uint64)].view(np.int64)
            out = []
            for m in range(len(masks)) if of is None else of.get(len(w), of[-1]) if len(w) else ():
                h = seed_hashes(w, masks[m])
                at = np.arange(len(h))
                if bits is not None:
                    slot = h >> np.uint64(64 - bits[0])
                    at = np.flatnonzero(bits[1][(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                size = len(masks[m]) + 2 * near
                out += [{"mask": m, "h": int(h[a].view(np.int64)), "at": int(a), "near": pad[a : a + size]} for a in at.tolist()]
            return out

        return pd.Series([one(t) for t in texts], index=texts.index, dtype=object)

    return f


def _joined(docs: DataFrame, items: DataFrame, text: Column, seeds, min_words: int, min_match: float) -> DataFrame:
    """``_k1, _k2`` (hashes that stand for a text) and ``found``, the items that overlap it with their alignment and
    words, by a join of both sides' window hashes.

    A filter of bounded size drops the windows of texts that no item can have.  Hits are verified on the words
    around them, as rows; only what agrees is gathered by text.  Copies of a text are sought once.
    """
    spark, shortest = docs.sparkSession, min(map(len, seeds))
    of = {n: masks_of(n, seeds, min_words, min_match) for n in range(1, min_words)}
    masks = list(dict.fromkeys([*seeds, *(m for ms in of.values() for m in ms)]))
    by_size = {n: [masks.index(m) for m in ms] for n, ms in of.items()} | {-1: [masks.index(m) for m in seeds]}
    near = min_words - 1
    length = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    item = items.withColumn("n", length)
    theirs = cut(item.select("item", "n", F.explode(_seeder(masks, by_size, near)("text")).alias("s")).select("item", "n", "s.*"))
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, theirs.count()))), 16, FILTER_BITS))
    slot = F.shiftrightunsigned("h", 64 - bits)
    got = theirs.groupBy(F.shiftrightunsigned(slot, 3).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(h, {64 - bits}) & 7 as int))")).alias("b")).toPandas()
    field = np.zeros(1 << bits - 3, np.uint8)
    field[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    seen = Shipped(spark, (bits, field))
    ours = docs.select(*_text_key(text), F.explode(_seeder(masks, None, near, seen)(text)).alias("s")).select("_k1", "_k2", "s.*").distinct()
    same = F.zip_with("near", "theirs", lambda a, b: F.when((a == 0) | (b == 0), F.lit(-1_000)).otherwise((a == b).cast("int")))
    need = F.least(F.lit(min_words), F.col("n"))
    enough = F.when(F.col("n") < shortest, need).otherwise(need * min_match - 1e-9)
    sums = F.transform(F.sequence(F.lit(1), F.size("same") - need + 1), lambda i: F.aggregate(F.slice("same", i, need), F.lit(0), lambda s, x: s + x))
    pairs = ours.join(theirs.select("item", "n", "mask", "h", F.col("at").alias("p"), F.col("near").alias("theirs")), ["mask", "h"])
    agreed = pairs.withColumn("same", same).where(F.exists(sums, lambda s: s >= enough))
    agreed = agreed.select("_k1", "_k2", "item", (F.col("at") - F.col("p")).alias("shift")).distinct()
    return agreed.join(items, "item").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("item_id", "text", "shift")).alias("found"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("_k1"), F.xxhash64(F.lit(2), text).alias("_k2")]


def _stretches(shortest: int, min_words: int, min_match: float):
    @F.pandas_udf(_HIT)
    def f(texts: pd.Series, ids: pd.Series, words: pd.Series, shifts: pd.Series) -> pd.Series:
        cache = _Words()

        def one(t, i, x, s) -> list[dict]:
            if i is None:
                return []
            w, hits = word_hashes(t, cache), []
            for item, other, shift in zip(i, x, s, strict=True):
                v = word_hashes(other, cache)
                if found := overlap(w, v, int(shift), len(v) < shortest, min_words, min_match):
                    hits.append((None if pd.isna(item) else int(item), *found))
            return _named(sorted(hits, key=_order))

        return pd.Series([one(*row) for row in zip(texts, ids, words, shifts, strict=True)], index=texts.index, dtype=object)

    return f


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "_hits", block_words: int = BLOCK_WORDS, seeds=SEEDS, min_words: int = MIN_WORDS, min_match: float = MIN_MATCH) -> DataFrame:
    """Add ``_hits``: overlaps with benchmark items, each with its item, first word, words and share of equal words.

    Words are runs of ASCII letters, digits and non-ASCII characters with A-Z lower-cased.  Every window of
    both sides is hashed under each mask; equal hashes are hits, and around a hit the aligned words are
    compared: it counts if some ``min_words`` of them (the whole item, if shorter) agree in a share of
    ``min_match``, which a substituted word does not prevent.  Items shorter than ``min_words`` are also
    sought by runs of words short enough that one is equal in every allowed overlap; items shorter than every
    mask must stand whole.  Items without an id are sought too and reported with a null id; items that repeat id
    and text count once, and items of different ids with one text are all reported.

    A benchmark of up to ``block_words`` words is sent to the executors and held against all rows where they are
    read, so rows are never shuffled.  A larger one is joined with the texts' windows by their hashes, with the
    same result: what is sent then is a filter of 2 ** FILTER_BITS bits at most.  Null or empty texts and items
    have no overlaps; an empty benchmark finds none; all rows and columns are kept, but for one named
    ``out_col``, which is replaced.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    n = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = n if n <= block_words else items.agg(F.sum(F.size(F.split("text", r"[^\w\x{80}-\x{10FFFF}]+")))).first()[0]
    if n <= block_words:
        rows = [(r["item_id"], r["text"]) for r in items.collect()]
        index = Shipped(docs.sparkSession, Index(rows, seeds, min_words, min_match))
        return docs.withColumn(out_col, _finder(index)(F.col(text_col)))
    found = _joined(docs, cut(items.withColumn("item", F.monotonically_increasing_id())), F.col(text_col), seeds, min_words, min_match)
    p = free_prefix(docs, "k1", "k2", "found")
    k1, k2, col = p + "k1", p + "k2", p + "found"
    found = found.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("found").alias(col))
    a, b = _text_key(F.col(text_col))
    tied = docs.withColumns({p + "a": a, p + "b": b}).join(found, (F.col(p + "a") == F.col(k1)) & (F.col(p + "b") == F.col(k2)), "left")
    hits = _stretches(min(map(len, seeds)), min_words, min_match)(F.col(text_col), F.col(col)["item_id"], F.col(col)["text"], F.col(col)["shift"])
    return tied.withColumn(out_col, hits).drop(p + "a", p + "b", k1, k2, col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """``docs`` without rows that overlap a benchmark item, all columns kept; see :func:`with_hits`."""
    hits = free_prefix(docs, "hits") + "hits"
    return with_hits(docs, benchmark, out_col=hits, **rules).where(F.size(hits) == 0).drop(hits)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each document that overlaps benchmark items, with the items, overlaps and longest overlap."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_hits").where(F.size("_hits") > 0)
    return hit.select(
        "doc_id",
        F.array_sort(F.array_distinct("_hits.item_id")).alias("item_ids"),
        F.size("_hits").alias("n_overlaps"),
        F.array_max("_hits.n_words").alias("longest"),
        F.array_max("_hits.matched").alias("matched"),
    )

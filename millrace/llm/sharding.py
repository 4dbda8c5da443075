"""Operator 9: sharding by sampled splitters."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, table

#: Ranges for each shard and rows of a range, so that a range is a small part of a shard and of a task's memory.
RANGES_PER_SHARD, ROWS_PER_RANGE = 64, 2_000_000
#: Sampled keys for each range.
OVERSAMPLE = 24


#: Columns that :func:`shard` adds, without their prefix.
NEW = ("size", "shard", "slot")


def _keys(size: Column, group: Column, id_col: str, seed: int) -> list[Column]:
    """Size, group key and a place within the group; the low bits of the place are random, so even rows that
    repeat a document whole can be divided."""
    salt = (F.rand(seed) * (1 << 20)).cast("long")
    place = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit(-(1 << 20))).bitwiseOR(salt)
    return [size.cast("long").alias("_size"), group.alias("_h1"), place.alias("_h2")]


def splitters(narrow: DataFrame, n_ranges: int, seed: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Start keys (h1, h2) of the ranges after the first, ascending.

    A row is drawn with a chance in proportion to half its share of all bytes plus half its share of all rows,
    so about OVERSAMPLE * n_ranges keys reach the driver whatever the size of the table.  A quantile that falls
    within a group moves to the group's start; a group with several quantiles is a heavy one: it gets a range
    border on both sides and the quantiles' places within.  Then the ranges are measured; those over twice their
    share, which the sample has missed, are sampled again by themselves and subdivided, in ``rounds`` rounds at
    most (a range of one row can't be divided).
    """
    total, count = narrow.agg(F.sum("_size"), F.count("*")).first()
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not count:
        return none
    weight = F.col("_size") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / count)
    drawn = F.least(F.lit(1.0), weight * F.lit(float(OVERSAMPLE * n_ranges)))
    k1, k2 = none
    over: list[int] | None = None
    for k in range(rounds):
        rows = narrow.withColumn("_w", weight).withColumn("_p", drawn)
        if over is not None:
            rows = rows.withColumn("_range", _range_of(k1, k2)("_h1", "_h2")).where(F.col("_range").isin(over))
        got = rows.where(F.rand(seed + 1 + k) < F.col("_p"))
        borders = set(zip(k1.tolist(), k2.tolist(), strict=True))
        part = F.col("_range") if over is not None else F.lit(0).alias("_range")
        for _, pdf in got.select(part, "_h1", "_h2", (F.col("_w") / F.col("_p")).alias("_v")).toPandas().groupby("_range"):
            borders |= _borders(pdf, n_ranges)
        if len(borders) == len(k1):
            break
        keys = sorted(borders)
        k1, k2 = np.array([b[0] for b in keys], np.int64), np.array([b[1] for b in keys], np.int64)
        per = narrow.groupBy(_range_of(k1, k2)("_h1", "_h2").alias("_range")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
        over = [r["_range"] for r in per.where((F.col("w") > 2.0 / n_ranges) & (F.col("n") > 1)).select("_range").collect()]
        if not over:
            break
    return k1, k2


def _borders(pdf: pd.DataFrame, n_ranges: int) -> set[tuple[int, int]]:
    """Quantile borders of a sample (``_h1, _h2`` and the weight ``_v`` that each row stands for), a share of
    1 / n_ranges apart."""
    pdf = pdf.sort_values(["_h1", "_h2"])
    cum = pdf["_v"].cumsum().to_numpy()
    n = max(1, round(cum[-1] * n_ranges))
    at = np.unique(np.searchsorted(cum, cum[-1] * np.arange(1, n) / n))
    h1, h2 = pdf["_h1"].to_numpy()[at], pdf["_h2"].to_numpy()[at]
    low, borders = np.iinfo(np.int64).min, set()
    groups, times = np.unique(h1, return_counts=True)
    heavy = set(groups[times > 1].tolist())
    for a, b in zip(h1.tolist(), h2.tolist(), strict=True):
        borders.add((a, low))
        if a in heavy:
            borders.add((a, b))
            if a < np.iinfo(np.int64).max:
                borders.add((a + 1, low))
    return borders


def _range_of(k1: np.ndarray, k2: np.ndarray):
    """A pandas UDF: the number of the range of a key (h1, h2)."""
    first = np.unique(k1)
    begin, end = np.searchsorted(k1, first), np.searchsorted(k1, first, side="right")

    @F.pandas_udf("int")
    def f(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(np.int64), h2.to_numpy(np.int64)
        out = np.searchsorted(k1, a, side="left")
        if len(first):
            g = np.minimum(np.searchsorted(first, a), len(first) - 1)
            for i in np.unique(g[first[g] == a]):
                rows = (g == i) & (a == first[i])
                out[rows] = begin[i] + np.searchsorted(k2[begin[i] : end[i]], b[rows], side="right")
        return pd.Series(out.astype(np.int32))

    return f


def assign(ranges: pd.DataFrame, k1: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each range.  Ranges of one heavy group are one unit, which is divided only if it is larger than
    a shard's share of all bytes; the largest units are placed first, each in the shard with the fewest bytes."""
    size, rng = ranges["bytes"].to_numpy(), ranges["range"].to_numpy()
    share = size.sum() / n_shards
    start = np.concatenate([[np.iinfo(np.int64).min], k1]) if len(k1) else np.zeros(1, np.int64)
    units: dict[tuple, list[int]] = {}
    group_bytes: dict[int, int] = {}
    low = {}
    for i, r in enumerate(rng):
        key = (int(start[r]), bool(r and np.count_nonzero(k1 == start[r]) > 1))
        low[i] = key
        if key[1]:
            group_bytes[key[0]] = group_bytes.get(key[0], 0) + int(size[i])
    for i in range(len(rng)):
        g, heavy = low[i]
        units.setdefault((g,) if heavy and group_bytes[g] <= share else (g, i), []).append(i)
    heap = [(0, s) for s in range(n_shards)]
    out = np.zeros(len(rng), np.int32)
    for rows in sorted(units.values(), key=lambda x: (-int(size[x].sum()), x[0])):
        have, s = heapq.heappop(heap)
        out[rows] = s
        heapq.heappush(heap, (have + int(size[rows].sum()), s))
    return out


def shard(docs: DataFrame, n_shards: int = 8, size: Column | None = None, group: Column | None = None, id_col: str = "doc_id", seed: int = 29, prefix: str = "_") -> DataFrame:
    """Put rows into ``n_shards`` shards of near equal bytes; add ``_size, _shard, _slot`` (``prefix`` replaces the
    underscore; a column of ``docs`` that has the name of a new one is replaced by it).

    Rows are keyed by a hash of their group (by default equal texts) and their place in it.  Size-weighted
    samples of the keys give quantile borders of many ranges for each shard; ranges are measured exactly and
    dealt to shards, so rows of a group meet in one shard unless the group alone exceeds a shard's share, when
    its ranges are divided among shards.  A slot numbers a shard's rows without gaps from 0: rows are numbered
    within each range, and a range starts where the one before it in its shard ends; so no task orders more than
    a range.  A null text has no bytes, and all null texts are a group, the same as empty ones.  An empty table
    gives no rows.  Rows that repeat a document take slots of their own; rows without an id are placed like others.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else None
    size = F.octet_length(text) + 1 if size is None else size
    group = F.xxhash64(F.lit(seed), text) if group is None else F.xxhash64(F.lit(seed), group)
    new = [(prefix + c).lower() for c in NEW]
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() not in new}
    rows = cut(docs.select(*[F.col(c).alias(k) for c, k in names.items()], *_keys(size, group, id_col, seed), F.col(id_col).alias("_id")))
    narrow = rows.select("_size", "_h1", "_h2")
    n = narrow.count()
    k1, k2 = splitters(narrow, max(n_shards * RANGES_PER_SHARD, n // ROWS_PER_RANGE), seed)
    rows = rows.withColumn("_range", _range_of(k1, k2)("_h1", "_h2"))
    per = rows.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).toPandas()
    per = per.rename(columns={"_range": "range"}).sort_values("range").reset_index(drop=True)
    per["shard"] = assign(per, k1, n_shards) if len(per) else pd.Series(dtype="int32")
    per["start"] = per.groupby("shard")["n"].cumsum() - per["n"]
    most = int(per["range"].max()) + 1 if len(per) else 1
    to, start = np.zeros(most, np.int32), np.zeros(most, np.int64)
    to[per["range"]], start[per["range"]] = per["shard"], per["start"]
    deal = docs.sparkSession.createDataFrame(per.astype({"range": "int32", "shard": "int32", "start": "int64"})[["range", "shard", "start"]], "_range int, _shard int, _start long")
    order = Window.partitionBy("_range").orderBy("_h1", "_h2", F.asc_nulls_last("_id"))
    rows = rows.withColumn("_row", F.row_number().over(order)).join(F.broadcast(deal), "_range")
    added = F.col("_size"), F.col("_shard"), F.col("_start") + F.col("_row") - 1
    return rows.select(*[F.col(k).alias(c) for c, k in names.items()], *[v.alias(prefix + c) for c, v in zip(NEW, added, strict=True)])


def sharded(docs: DataFrame, n_shards: int = 8, **rules) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; all other columns are kept, whatever their names."""
    prefix = free_prefix(docs, *NEW)
    out = shard(docs.drop("shard", "slot"), n_shards, prefix=prefix, **rules)
    return out.withColumnsRenamed({prefix + "shard": "shard", prefix + "slot": "slot"}).drop(prefix + "size")


def op9_shard(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of near equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"))
    out = shard(docs, 8, size=F.col("size"), group=F.col("_text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

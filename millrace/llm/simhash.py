"""Operator 2: SimHash near-dedup by a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, bounds, by_groups, connected_components, cut, free_prefix, table

#: Fingerprints that share a block are joined in one task if they are at most so many; larger groups are divided.
GROUP_LIMIT = 1_000
#: Node pairs that a traversal takes at a time; what waits is some of these per level, 48 bytes a pair.
FRONTIER = 1 << 15
SHINGLES_AT_A_TIME = 1 << 14
_ALL = (1 << 64) - 1


def simhash(text: str | None, width: int = 3, seed: int = 42, words64: int = 1) -> list[int]:
    """SimHash of a whole text in ``words64`` signed 64-bit numbers.

    Words are runs of other than ASCII white space with A-Z lower-cased; shingles of ``width`` words, repeats
    included, count with their XXH64, and for further numbers with this hash mixed anew.  A bit is set if it is
    in over half of them.  Fewer words make one shingle; no words (null or blank) give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * words64
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True)) if len(words) >= width else iter([b" ".join(words)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    out = []
    for k in range(words64):
        ones = np.zeros(64, np.int64)
        for i in range(0, n, SHINGLES_AT_A_TIME):
            part = h[i : i + SHINGLES_AT_A_TIME] if not k else _mixed(h[i : i + SHINGLES_AT_A_TIME], k)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        x = int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash: the finalizer of splitmix64."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & _ALL)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash_column(width: int, seed: int = 42, words64: int = 1):
    @F.pandas_udf("array<long>")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(partial(simhash, width=width, seed=seed, words64=words64))

    return f


def trie_links(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], walked: np.ndarray, errors: int) -> np.ndarray:
    """For each fingerprint one that the links found lead to.

    ``x``: rows of one or more unsigned 64-bit numbers.  ``pairs``: ranges of rows ``(from, to, from, to)`` to be
    held against each other, or a range against itself; rows ascend within a range, which makes it an implicit
    binary trie: a node is a range of rows whose upper bits agree, and its children part where the next bit turns
    to 1.  ``walked``: upper bits in which all rows of a pair of ranges agree.  Pairs of nodes go down together,
    with the bits in which they differ so far, and go no further once these exceed ``errors``.  A pair of single
    rows is compared at once.  Pairs found are merged right away, so a dense group never holds its square.
    """
    x = x.reshape(len(x), -1)
    n, depth = len(x), 64 * x.shape[1]
    forest = Forest(n)
    merge = forest.merge
    ones = np.zeros((depth, n + 1), np.int32)
    for d in range(depth):
        np.cumsum((x[:, d >> 6] >> np.uint64(63 - (d & 63))) & np.uint64(1), out=ones[d, 1:])
    stack = [(*pairs, np.zeros(len(walked), np.int64), walked)]
    while stack:
        alo, ahi, blo, bhi, diff, d = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [tuple(v[:half] for v in (alo, ahi, blo, bhi, diff, d)), tuple(v[half:] for v in (alo, ahi, blo, bhi, diff, d))]
            continue
        one = (ahi - alo == 1) & (bhi - blo == 1)
        if one.any():
            i, j = alo[one], blo[one]
            near = (i != j) & (np.bitwise_count(x[i] ^ x[j]).sum(axis=1) <= errors)
            merge(i[near], j[near])
            alo, ahi, blo, bhi, diff, d = (v[~one] for v in (alo, ahi, blo, bhi, diff, d))
        live = d < depth
        if not live.all():  # equal all the way down: every row of the one links to every row of the other
            for p, q, r, s in zip(alo[~live], ahi[~live], blo[~live], bhi[~live], strict=True):
                both = np.unique(np.r_[p:q, r:s])
                merge(both, np.full(len(both), both[0]))
            alo, ahi, blo, bhi, diff, d = (v[live] for v in (alo, ahi, blo, bhi, diff, d))
        if not len(alo):
            continue
        amid = ahi - (ones[d, ahi] - ones[d, alo])
        bmid = bhi - (ones[d, bhi] - ones[d, blo])
        same = (alo == blo) & (ahi == bhi)
        below = [(alo, amid, blo, bmid, diff, same | True), (amid, ahi, bmid, bhi, diff, same | True), (alo, amid, bmid, bhi, diff + 1, same | True), (amid, ahi, blo, bmid, diff + 1, ~same)]
        parts = []
        for p, q, r, s, e, use in below:
            ok = use & (q > p) & (s > r) & (e <= errors)
            parts.append((p[ok], q[ok], r[ok], s[ok], e[ok], d[ok] + 1))
        stack.append(tuple(np.concatenate(v) for v in zip(*parts, strict=True)))
    return forest.root


def _linked(node: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    own = root != np.arange(len(root))
    return pd.DataFrame({"a": node[own], "b": node[root[own]]})


def _block_links(errors: int):
    """Links of rows that agree in ``bits`` upper bits of ``x``, their groups being equal in path and g."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["path", "g", "x"])
        lo, hi = bounds([pdf["path"].to_numpy(), pdf["g"].to_numpy()])
        x, walked = pdf["x"].to_numpy(np.int64).view(np.uint64), pdf["bits"].to_numpy(np.int64)
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        return _linked(pdf["node"].to_numpy(), trie_links(x, (lo, hi, lo, hi), walked[lo], errors))

    return links


def _cell_links(n_words: int, errors: int):
    """Links of rows that share a cell: within a block (i = j), or between the blocks i and j."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [pdf[f"f{k}"].to_numpy(np.int64).view(np.uint64) for k in range(n_words)]
        keys = [pdf[c].to_numpy() for c in ("cell", "i", "j", "blk")]
        order = np.lexsort([*words[::-1], *keys[::-1]])
        keys, x = [k[order] for k in keys], np.stack([w[order] for w in words], axis=1)
        lo, hi = bounds(keys)
        self = keys[1][lo] == keys[2][lo]
        cross = np.flatnonzero(~self[:-1] & ~self[1:] & (keys[3][lo[:-1]] == keys[1][lo[:-1]]) & (keys[0][lo[:-1]] == keys[0][lo[1:]]) & (keys[1][lo[:-1]] == keys[1][lo[1:]]) & (keys[2][lo[:-1]] == keys[2][lo[1:]]))
        own = np.flatnonzero(self & (hi - lo > 1))
        pairs = tuple(np.r_[u[own], v] for u, v in zip((lo, hi, lo, hi), (lo[cross], hi[cross], lo[cross + 1], hi[cross + 1]), strict=True))
        return _linked(pdf["node"].to_numpy()[order], trie_links(x, pairs, np.zeros(len(pairs[0]), np.int64), errors))

    return links


def _turned(total: int, parts: int) -> F.Column:
    """``parts`` copies of a row: of the total - bits lower bits of x, each of so many blocks in turn comes first."""
    out = []
    for i in range(parts):
        width = f"cast(ceil(({total} - bits) / {parts}) as int)"
        by = f"least({i} * {width}, {total} - bits)"
        mask = f"if({total} - bits = 64, -1L, shiftleft(1L, {total} - bits) - 1L)"
        up = f"shiftleft(x & {mask}, {by})"
        down = f"if({by} = 0, 0L, shiftrightunsigned(x & {mask}, {total} - bits - {by}))"
        x = f"(({up} | {down}) & {mask}) | (x & ~{mask})"
        out.append(f"named_struct('path', concat(path, '.{i}'), 'x', {x}, 'bits', bits + greatest(0, least({width}, {total} - bits - {by})))")
    return F.explode(F.array(*map(F.expr, out)))


def near_links(prints: DataFrame, errors: int = 2, group_limit: int = GROUP_LIMIT, max_depth: int = 8) -> DataFrame:
    """Links ``a, b`` between rows of ``prints`` (``node`` and a fingerprint ``f0``) that differ in ``errors`` or
    fewer bits.

    The bits are cut into errors + 1 blocks; two linked rows agree in one of them.  For
    each block there is a trie that starts with it, walked down the block along equal nodes only, which is what
    rows are dealt by, and below it along node pairs within the error budget.  Where more than ``group_limit``
    rows share a block, the rest of their bits is cut again in the same way, so a hot group becomes many; no
    link is lost.  Of each group a forest of its links is returned, from which the components follow; copies
    and dense groups don't give their square.
    """
    parts, table_bits, kept = errors + 1, 64, ["node"]
    rows = prints.select("node", F.lit("").alias("path"), F.col("f0").alias("x"), F.lit(0).alias("bits"))
    done: list[DataFrame] = []
    for depth in range(max_depth):
        rows = rows.select(*kept, _turned(table_bits, parts).alias("t")).select(*kept, "t.*")
        rows = rows.withColumn("g", F.expr(f"shiftrightunsigned(x, {table_bits} - bits)"))
        n_hot = 0
        if depth < max_depth - 1:
            hot = cut(rows.groupBy("path", "g").count().where(F.col("count") > group_limit).select("path", "g"))
            n_hot = hot.count()
        if not n_hot:
            done.append(rows)
            break
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        done.append(rows.join(hot, ["path", "g"], "left_anti").select(*rows.columns))
        rows = rows.join(hot, ["path", "g"], "left_semi").where(f"bits < {table_bits}").select(*kept, "path", "x", "bits")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    dealt = every.repartition("path", "g").sortWithinPartitions("path", "g", "x")
    return dealt.mapInPandas(by_groups(_block_links(errors), ["path", "g"]), "a long, b long")


#: Of a wide fingerprint's cells: rows that share one on average, and the chance that a pair at the threshold meets in
#: none of the tables.
CELL_ROWS, MISSED = 128, 0.03
#: Chance that a bit of a pair at the threshold differs, with a margin; see NEAR.
BIT_DIFFERS = 0.16
#: Rows of a cell that are held against each other at once; larger cells are cut into blocks.
CELL_LIMIT = 1_024


def cell_plan(n: int) -> tuple[int, int]:
    """Bits that make a cell, and tables of such cells, for ``n`` fingerprints: cells hold CELL_ROWS on average
    whatever n, and tables grow as n to the power -log2(1 - BIT_DIFFERS), that is 0.25."""
    width = max(0, math.ceil(math.log2(max(1, n) / CELL_ROWS)))
    chance = (1 - BIT_DIFFERS) ** width
    return width, 1 if chance == 1 else math.ceil(math.log(MISSED) / math.log1p(-chance))


def _cells(n_words: int, width: int, tables: int):
    """For mapInPandas: each row once for each table, with its cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(31)
        places = [rng.permutation(64 * n_words)[:width] for _ in range(tables)]
        for pdf in batches:
            x = np.ascontiguousarray(pdf[[f"f{k}" for k in range(n_words)]].to_numpy(np.int64))
            bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
            for t, at in enumerate(places):
                cell = bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64)) if width else np.zeros(len(pdf), np.int64)
                yield pdf.assign(cell=cell | np.int64(t << 44))

    return run


def wide_links(prints: DataFrame, errors: int, limit: int = CELL_LIMIT) -> DataFrame:
    """Links ``a, b`` between rows of ``prints`` (``node`` and the fingerprint's numbers ``f0, f1, ...``) that differ
    in ``errors`` or fewer bits of all, where these are so many that no block of bits must agree.

    Each table deals rows to cells by some of their bits, drawn anew; see :func:`cell_plan`.  Within a cell all
    pairs are sought by the trie join over all bits, so what is missed are pairs that share no cell: a share of
    MISSED at the threshold, fewer above it.  A cell of more than ``limit`` rows is mostly one family of near copies.
    Its rows are first held against one of them, those left against one of these, and so on, which joins
    most of a family in linear work; then such a cell is cut into blocks, and only blocks that may have links
    between different components are held against each other.  Nothing is dropped: of many rows without
    components all pairs of blocks are searched.
    """
    words = [c for c in prints.columns if c != "node"]
    n = prints.count()
    width, tables = cell_plan(n)
    schema = f"node long, {', '.join(f'{w} long' for w in words)}, cell long"
    deal = _cells(len(words), width, tables)
    rows = prints.mapInPandas(deal, schema)
    cross = by_groups(_cell_links(len(words), errors), ["cell", "i", "j"])

    def searched(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInPandas(cross, "a long, b long")

    one = [F.lit(0).alias(c) for c in ("i", "j", "blk")]
    thin = 16 if n > 64 * limit else 1  # a sample shows which cells are large; it decides nothing but how they are cut
    seen = prints.where(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(thin)) == 0).mapInPandas(deal, schema)
    hot = cut(seen.groupBy("cell").count().where(F.col("count") * thin > limit).select("cell"))
    n_hot = hot.count()
    if not n_hot:
        return searched(rows.select("node", *words, "cell", *one))
    hot = F.broadcast(hot) if n_hot <= 100_000 else hot
    alone = rows.join(hot, "cell", "left_anti").select("node", *words, "cell", *one)
    inside, stars = _stars(cut(rows.join(hot, "cell", "left_semi").select("cell", "node", *words)), words, errors, limit)
    sizes = inside.groupBy("cell", "kind").count()
    large = sizes.where(F.col("count") > limit)
    small = sizes.where(F.col("count") <= limit).groupBy("cell").agg(F.sum("count").alias("count"))
    several = F.ceil(F.col("count") / limit).cast("int").alias("parts")
    kinds = cut(large.select("cell", F.col("kind").alias("of"), several).unionByName(small.select("cell", F.lit(None).cast("long").alias("of"), several)))
    every = kinds.select("cell", "of", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"))
    every = cut(every.withColumn("blk", F.row_number().over(Window.partitionBy("cell").orderBy("of", "b"))))
    every = F.broadcast(every) if every.count() <= 100_000 else every
    own = inside.alias("r").join(kinds.where("of is not null").select("cell", "of").alias("k"), (F.col("r.cell") == F.col("k.cell")) & (F.col("r.kind") == F.col("k.of")), "left").select("r.cell", "node", *words, "of")
    mine = own.alias("r").join(every.alias("e"), (F.col("r.cell") == F.col("e.cell")) & F.col("r.of").eqNullSafe(F.col("e.of")) & (F.pmod(F.xxhash64("r.node"), F.col("e.parts")) == F.col("e.b")))
    mine = mine.select("r.cell", "node", *words, "r.of", "blk")
    apart = F.col("r.of").isNull() | ~F.col("r.of").eqNullSafe(F.col("e.of"))
    met = mine.alias("r").join(every.alias("e"), (F.col("r.cell") == F.col("e.cell")) & apart)
    met = met.select("node", *words, "r.cell", F.least("r.blk", "e.blk").alias("i"), F.greatest("r.blk", "e.blk").alias("j"), "r.blk")
    return searched(alone).unionByName(searched(met)).unionByName(stars)


def _stars(inside: DataFrame, words: list[str], errors: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large cells with ``kind``, a row of the cell that they link to or their own node, and these links.

    A cell's rows are held against its smallest node, then those left against the smallest of them, until
    ``limit`` are left or PIVOTS rounds are over.
    """
    left, done = inside, []
    for _ in range(PIVOTS):
        low = cut(left.groupBy("cell").agg(F.min(F.struct("node", *words)).alias("low"), F.count("*").alias("m")).where(F.col("m") > limit).select("cell", "low"))
        n = low.count()
        if not n:
            break
        tied = left.join(F.broadcast(low) if n <= 100_000 else low, "cell", "left")
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col("low")[w])) for w in words), F.lit(0))
        tied = cut(tied.withColumn("kind", F.when(differ <= errors, F.col("low.node"))).select(*inside.columns, "kind"))
        done.append(tied.where("kind is not null"))
        left = tied.where("kind is null").drop("kind")
    every = left.withColumn("kind", F.col("node"))
    for d in done:
        every = every.unionByName(d)
    return every, every.where("node <> kind").select(F.col("node").alias("a"), F.col("kind").alias("b")).distinct()


#: Rounds in which a large cell's rows are held against one of them.
PIVOTS = 6


#: Of the pipeline: 5-word shingles and similarity 0.8.  Shingle sets of Jaccard similarity J have cosine
#: 2J / (1 + J), and a SimHash bit differs with chance acos(cosine) / pi: 0.15 at J = 0.8, 39 of 256 bits, with a
#: deviation of 5.7.  A pair at 0.8 differs in 47 bits or fewer with chance 0.93 and meets in a cell with 0.97.
NEAR = {"width": 5, "words64": 4, "errors": 47}


def near_duplicates(docs: DataFrame, width: int = 5, errors: int = 47, words64: int = 4, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, _text`` (a hash of the text), ``fingerprint`` (array of signed
    numbers), ``component_id`` and ``first`` (struct of the component's first document: ``missing, id, text``).

    Documents with the same fingerprint are one class; classes link if they differ in ``errors`` bits or fewer, see
    :func:`near_links` (``words64`` = 1: every link is found) and :func:`wide_links`, and components
    are everything reachable.  ``component_id`` is the smallest id, null only where no member has one; the first
    document is the one with that id and, among repeated ids, the smallest text hash.  Null and blank texts have
    fingerprint 0.  An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col)
    words = [f"f{k}" for k in range(words64)]
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), text).alias("_text"), simhash_column(width, seed, words64)(text).alias("_fp"))
    own = cut(own.select("doc_id", "_text", *[F.col("_fp")[k].alias(c) for k, c in enumerate(words)]))
    node = F.col("f0") if words64 == 1 else F.monotonically_increasing_id()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("_text").alias("text")))
    prints = cut(own.groupBy(*words).agg(first.alias("first")).withColumn("node", node))
    comp = connected_components(near_links(prints.select("node", "f0"), errors) if words64 == 1 else wide_links(prints.select("node", *words), errors))
    tied = prints.join(comp, "node", "left").select(*words, "first", F.coalesce("component", "node").alias("c"))
    best = tied.groupBy("c").agg(F.min("first").alias("first"))
    named = tied.select(*words, "c").join(best, "c").select(*words, "first")
    found = own.join(named, words)
    return found.select("doc_id", "_text", F.array(*words).alias("fingerprint"), F.col("first.id").alias("component_id"), "first")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, **near) -> DataFrame:
    """``docs`` with one document of each component, its first; of rows that repeat its id and text, one.
    Further parameters go to :func:`near_duplicates`."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, seed=seed, **near)
    p = free_prefix(docs, "keep_id", "keep_text", "keyed")
    lead = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("_text") == F.col("first.text"))
    keep = found.where(lead).select(F.col("doc_id").alias(p + "keep_id"), F.col("_text").alias(p + "keep_text")).distinct()
    rows = docs.withColumn(p + "keyed", F.xxhash64(F.lit(seed), F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(p + "keep_id")) & (F.col(p + "keyed") == F.col(p + "keep_text"))
    return rows.join(keep, same, "left_semi").dropDuplicates([id_col, p + "keyed"]).drop(p + "keyed")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its component at 2 or fewer differing bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, words64=1, errors=2)
    hexed = F.lower(F.lpad(F.hex(F.col("fingerprint")[0]), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")

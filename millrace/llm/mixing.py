"""Operator 1: mixing sources to target weights (native)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, table, word_count

#: A source's documents fall into 2 ** bits buckets by seeded hash, and those of its boundary bucket into as
#: many again; bits are chosen so that a boundary sub-bucket, which is put in order in one task, holds about
#: LEAST_ROWS to 4 * LEAST_ROWS rows, and are MAX_BITS at most.
LEAST_ROWS, MAX_BITS = 512, 12


def water_fill(sizes: DataFrame, share: float = 1.5, weights: Sequence[float] | DataFrame = (3, 1, 2), max_epochs: float = 2.0) -> DataFrame:
    """Capped water-filling over a table ``source, source_size`` with one row per source.

    ``weights``: numbers that repeat over the sources in code point order (null last), or a DataFrame
    ``source, weight`` (sources it lacks weigh 0).  All targets add up to ``share`` times all sizes as far
    as the caps of ``max_epochs`` times a source's size permit.  With sources ordered by cap / weight, the
    water level after the first k are clamped is (total - their caps) / (the rest's weights); the level
    that holds is the one at the first source that it does not fill (of equal ratios the first, whose level is
    the highest).  That equals clamping and resharing
    until none is above its cap.  An empty table gives an empty table; sources of size 0 get 0.
    """
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_ws"), F.col("weight").cast("double").alias("weight"))
        t = sizes.join(w, F.col("source").eqNullSafe(F.col("_ws")), "left").drop("_ws").fillna(0.0, ["weight"])
    else:
        cycle = F.array(*[F.lit(float(x)) for x in weights])
        place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
        t = sizes.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    all_rows = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        t.withColumn("_ratio", ratio)
        .withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("_level", F.when(F.col("_rest") > 0, (F.col("_total") - F.col("_before")) / F.col("_rest")))
        .withColumn("_hold", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", (-F.col("_level")).alias("_low")))).over(all_rows)["_low"])
    )
    full = F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0.0))
    target = F.when(F.col("_hold").isNull(), full).otherwise(F.least(full, F.col("weight") * -F.col("_hold")))
    return t.select(*sizes.columns, "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def _place(id_col: str, seed: int, text: Column | None) -> Column:
    """A seeded place of a row among its source's rows; rows without an id are placed by their text."""
    other = F.xxhash64(F.lit(seed), text) if text is not None else F.lit(seed).cast("long")
    return F.when(F.col(id_col).isNull(), other).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))


def _bucket(level: int) -> Column:
    return F.expr(f"if(bits = 0, 0, cast(shiftrightunsigned(shiftleft(_u, {level} * bits), 64 - bits) as int))")


def _boundary(rows: DataFrame, level: int) -> DataFrame:
    """Of each source, the bucket in which the words still wanted run out, and those wanted within it."""
    sums = rows.groupBy("source", "wanted", _bucket(level).alias("_b")).agg(F.sum("_size").alias("_s"))
    w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_cum", F.sum("_s").over(w)).where(F.col("_cum") > F.col("wanted"))
    first = sums.groupBy("source").agg(F.min(F.struct("_b", (F.col("wanted") - F.col("_cum") + F.col("_s")).alias("left"))).alias("x"))
    return first.select("source", F.col("x._b").alias("edge"), F.col("x.left").alias("left"))


#: Per-source plans of up to this many rows (some 100 bytes each) are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= MAX_BROADCAST_SOURCES else plan


def _plan(narrow: DataFrame, share: float, weights, max_epochs: float) -> DataFrame:
    """Of each source: whole repetitions, and where the words of the fractional one run out."""
    per = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n"))
    bits = F.least(F.lit(MAX_BITS), F.greatest(F.lit(0), F.floor(F.log2(F.col("_n") / LEAST_ROWS) / 2))).cast("int")
    per = per.withColumn("bits", bits).drop("_n")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0))
    plan = water_fill(per, share, weights, max_epochs).withColumn("_whole", rate)
    plan = cut(plan.withColumn("wanted", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))))
    for level in (0, 1):
        wants = plan.select(F.col("source").alias("_k"), "bits", "wanted") if level == 0 else plan.select(F.col("source").alias("_k"), "bits", F.col("left0").alias("wanted"), "edge0")
        rows = narrow.join(_small(wants), F.col("source").eqNullSafe(F.col("_k"))).drop("_k")
        if level:
            rows = rows.where(_bucket(0) == F.col("edge0"))
        edge = _boundary(rows, level).select(F.col("source").alias("_k"), F.col("edge").alias(f"edge{level}"), F.col("left").alias(f"left{level}"))
        plan = cut(plan.join(edge, F.col("source").eqNullSafe(F.col("_k")), "left").drop("_k"))
    return plan.select(F.col("source").alias("_k"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "bits", "wanted", "edge0", "edge1", "left1")


def _mixed(docs: DataFrame, size: Column, plan: DataFrame, id_col: str, most: int) -> DataFrame:
    rows = docs.join(_small(plan), F.col("_src").eqNullSafe(F.col("_k"))).drop("_k")
    b0, b1 = _bucket(0), _bucket(1)
    at_edge = F.coalesce((b0 == F.col("edge0")) & (b1 == F.col("edge1")), F.lit(False))
    before = F.coalesce((b0 < F.col("edge0")) | ((b0 == F.col("edge0")) & (b1 < F.col("edge1"))), F.col("wanted") > 0)
    inner = rows.where(~at_edge).withColumn("_size", size).withColumn("_more", before.cast("int"))
    order = Window.partitionBy("_src").orderBy("_u", F.asc_nulls_last(id_col), "_size")
    whole = Window.partitionBy("_src")
    outer = rows.where(at_edge).withColumn("_size", size).withColumn("_nth", F.row_number().over(order))
    outer = outer.withColumn("_cum", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    outer = outer.withColumn("_fits", F.col("_cum") <= F.col("left1"))
    outer = outer.withColumn("_gap", F.col("left1") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_cum"))).over(whole), F.lit(0)))
    miss = F.abs(F.col("_gap") - F.col("_size"))
    last = F.min(F.when(~F.col("_fits") & (miss < F.col("_gap")), F.struct(miss.alias("miss"), "_nth"))).over(whole)
    outer = outer.withColumn("_more", (F.col("_fits") | F.coalesce(last["_nth"] == F.col("_nth"), F.lit(False))).cast("int"))
    outer = outer.drop("_nth", "_cum", "_fits", "_gap")
    out = inner.unionByName(outer).withColumn("_reps", F.least(F.col("_whole") + F.col("_more"), F.lit(most)).cast("int"))
    return out.drop("_whole", "_more", "bits", "wanted", "edge0", "edge1", "left1", "_src", "_u")


def mix(
    docs: DataFrame,
    size: Column | None = None,
    share: float = 1.5,
    weights: Sequence[float] | DataFrame = (3, 1, 2),
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    prefix: str = "_",
) -> DataFrame:
    """Repeat documents so that each source gives its target of words; see :func:`water_fill`.

    A source with rate target / size repeats every document floor(rate) times; of the rest it takes
    documents in a seeded hash order while they fit, then the one that fills the gap best.  The order is
    never built for a large source: words are summed by hash bucket, buckets before the boundary are taken
    whole, and only documents of the boundary bucket's boundary sub-bucket are put in order.
    Returns all columns of ``docs`` and ``_size, _source_size, _target, _reps`` (times a document is used,
    0 included, ``max_epochs`` rounded up at most, empty documents too).  Reruns agree; rows equal in id and size
    are exchangeable.  ``prefix`` replaces the underscore of the new columns; a column of ``docs`` that has the
    name of a new one is replaced by it.

    ``size``: words of a row, by default of its column ``text``.  A null source is a source of its own, a
    null text has 0 words, an empty table gives no rows, extra columns are kept whatever their names.
    """
    new = [prefix + c for c in NEW]
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c.lower() not in new}
    size = word_count("text") if size is None else size
    text = F.col("text") if "text" in docs.columns else None
    own = [F.coalesce(size, F.lit(0)).cast("long").alias("_s"), _place(id_col, seed, text).alias("_u")]
    narrow = cut(docs.select(F.col(source_col).alias("source"), own[0].alias("_size"), own[1]))
    plan = _plan(narrow, share, weights, max_epochs)
    held = docs.select(*[F.col(c).alias(k) for c, k in names.items()], F.col(source_col).alias("_src"), F.col(id_col).alias("_key"), *own)
    out = _mixed(held, F.col("_s"), plan, "_key", math.ceil(max_epochs))
    return out.select(*[F.col(k).alias(c) for c, k in names.items()], *[F.col("_" + c).alias(prefix + c) for c in NEW])


#: Columns that :func:`mix` adds, without their prefix.
NEW = ("size", "source_size", "target", "reps")


def repeat(mixed: DataFrame, prefix: str = "_") -> DataFrame:
    """One row for each repetition, without the columns of :func:`mix`; documents that are not used go."""
    new = [prefix + c for c in NEW]
    keep = [c for c in mixed.columns if c not in new]
    reps = F.col(prefix + "reps")
    copies = free_prefix(mixed, "copy") + "copy"
    return mixed.where(reps > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), reps))).select(*keep)


def mixed_rows(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` uses it; all columns are kept, whatever their names."""
    prefix = free_prefix(docs, *NEW)
    return repeat(mix(docs, prefix=prefix, **rules), prefix)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents with their words and the words that the mix takes of them."""
    rows = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size")))
    return mix(rows, size=F.col("size")).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_reps")).alias("taken"), "source", F.col("_reps").alias("repetitions")
    )

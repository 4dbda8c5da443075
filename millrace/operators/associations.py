"""Frequent item sets and association rules over baskets (arrays of items)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Params, associator


class FrequentItemset(NamedTuple):
    items: tuple
    support: float
    count: int


class AssociationRule(NamedTuple):
    antecedent: tuple
    consequent: tuple
    support: float
    confidence: float
    lift: float
    leverage: float
    conviction: float
    jaccard: float
    cosine: float
    kulczynski: float


class Associator(Params):
    """``fit(df, items)`` gives ``itemsets`` (items, count, support) and ``rules`` as DataFrames.

    Item sets are grown by parallel FP-growth: baskets are regrouped by item suffix, so no task sees all of them.
    A rule for each non-empty proper part of an item set is a row; its counts come from two joins with the sets.
    """

    defaults = {"min_support": 0.1, "min_confidence": 0.8, "max_itemset_size": None, "metric": "confidence", "min_metric": None}

    def fit(self, df: DataFrame, items: str = "items"):
        baskets = df.select(F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items"))
        self.n = baskets.count()
        least = max(1, math.ceil(self.min_support * self.n - 1e-9))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(self.n, 1), minConfidence=1.0).fit(baskets)
        sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("count"))
        if self.max_itemset_size:
            sets = sets.where(F.size("items") <= self.max_itemset_size)
        self.itemsets = sets.withColumn("support", F.col("count") / F.lit(max(self.n, 1)))
        return self

    def top_itemsets(self, n: int = 100) -> list[FrequentItemset]:
        """The ``n`` most frequent sets as records."""
        rows = self.itemsets.orderBy(F.desc("count"), F.size("items"), F.col("items").cast("string")).limit(n).collect()
        return [FrequentItemset(tuple(r["items"]), r["support"], r["count"]) for r in rows]

    def top_rules(self, n: int = 100, by: str = "confidence") -> list[AssociationRule]:
        """The ``n`` best rules by a measure as records."""
        rows = self.rules.orderBy(F.desc(by), F.desc("count"), F.col("antecedent").cast("string"), F.col("consequent").cast("string")).limit(n).collect()
        return [AssociationRule(tuple(r["antecedent"]), tuple(r["consequent"]), *[r[f] for f in AssociationRule._fields[2:]]) for r in rows]

    @property
    def rules(self) -> DataFrame:
        kind = self.itemsets.schema["items"].dataType.simpleString()

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(list(a), [x for x in s if x not in a], n) for s, n in zip(pdf["items"], pdf["count"], strict=True) for k in range(1, len(s)) for a in itertools.combinations(list(s), k)]
                yield pd.DataFrame(rows, columns=["antecedent", "consequent", "count"])

        rules = self.itemsets.where(F.size("items") > 1).select("items", "count").mapInPandas(parts, f"antecedent {kind}, consequent {kind}, count long")
        a = self.itemsets.select(F.col("items").alias("antecedent"), F.col("count").alias("_a"))
        c = self.itemsets.select(F.col("items").alias("consequent"), F.col("count").alias("_c"))
        n = F.lit(float(max(self.n, 1)))
        s, sa, sc = F.col("count") / n, F.col("_a") / n, F.col("_c") / n
        conf = F.col("count") / F.col("_a")
        out = rules.join(a, "antecedent").join(c, "consequent").select(
            "antecedent", "consequent", "count", s.alias("support"), conf.alias("confidence"), (conf / sc).alias("lift"), (s - sa * sc).alias("leverage"),
            F.when(conf < 1, (1 - sc) / (1 - conf)).otherwise(F.lit(float("inf"))).alias("conviction"), (s / (sa + sc - s)).alias("jaccard"), (s / F.sqrt(sa * sc)).alias("cosine"), ((conf + F.col("count") / F.col("_c")) / 2).alias("kulczynski"),
        )
        return out.where(F.col(self.metric) >= F.lit(float(self.min_metric if self.min_metric is not None else self.min_confidence)))


@associator
class AprioriAssociator(Associator):
    """Sets of two at most are counted level by level: frequent items, then pairs of these within the baskets, which
    spares growing larger sets.  A basket's pairs are its square, so this is for baskets of up to ``PAIRED`` frequent items;
    with longer ones, and for larger sets, FP-growth does the counting."""

    PAIRED = 200

    def fit(self, df, items="items"):
        if self.max_itemset_size is None or self.max_itemset_size > 2:
            return super().fit(df, items)
        baskets = df.select(F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items"))
        self.n = baskets.count()
        least = max(1, math.ceil(self.min_support * self.n - 1e-9))
        one = baskets.select(F.explode("items").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
        sets = one.select(F.array("x").alias("items"), "count")
        if self.max_itemset_size == 2:
            keyed = baskets.withColumn("o", F.monotonically_increasing_id())
            kept = keyed.select("o", F.explode("items").alias("x")).join(one.select("x"), "x").groupBy("o").agg(F.array_sort(F.collect_list("x")).alias("items"))
            if (kept.agg(F.max(F.size("items"))).first()[0] or 0) > self.PAIRED:
                return super().fit(df, items)
            ends = F.transform("items", lambda x, i: F.transform(F.filter("items", lambda y: y > x), lambda y: F.array(x, y)))
            two = kept.select(F.explode(F.flatten(ends)).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
            sets = sets.unionByName(two)
        self.itemsets = sets.withColumn("support", F.col("count") / F.lit(max(self.n, 1)))
        return self


@associator
class ECLATAssociator(Associator):
    pass


@associator
class FPGrowthAssociator(Associator):
    defaults = {"min_support": 0.1, "min_confidence": 0.8, "max_itemset_size": None}
    metric, min_metric = "confidence", None

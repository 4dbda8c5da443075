"""Helpers shared by the operators: text splitting, models sent to executors, merging of links."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Forest, connected_components, cut

__all__ = ["ALNUM", "WORD", "Forest", "Shipped", "bounds", "by_groups", "connected_components", "cut", "free_prefix", "table", "word_count"]

#: Words of the size, shingle and quality contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the license and overlap operators, on UTF-8 bytes: ASCII letters, digits, any non-ASCII.
ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | F.Column) -> F.Column:
    """Number of white-space separated words; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def free_prefix(df: DataFrame, *names: str) -> str:
    """Underscores that, put before each of ``names``, give names that no column of ``df`` has in any case."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix


class Shipped:
    """An object of proven size, sent to the executors by value, so they need no copy of this package."""

    def __init__(self, spark: SparkSession, obj):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    @property
    def value(self):
        return pickle.loads(self.held.value)


def bounds(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and end rows of runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    lo = np.flatnonzero(new)
    return lo, np.r_[lo[1:], n].astype(np.int64)


def by_groups(links, keys: list[str], rows_at_a_time: int = 1 << 15):
    """For mapInPandas over rows sorted by ``keys``: ``links`` of whole groups at a time, about so many rows and the
    rest of the group that they end in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            for at in range(0, len(pdf), rows_at_a_time):
                held.append(pdf.iloc[at : at + rows_at_a_time])
                rows += len(held[-1])
                if rows < rows_at_a_time:
                    continue
                end = held[-1].iloc[-1]
                last = np.logical_and.reduce([held[-1][k].to_numpy() == end[k] for k in keys])
                if last.all():  # the last group fills the whole piece: what came before may end here, or not
                    continue
                out = pd.concat([*held[:-1], held[-1][~last]], ignore_index=True)
                held = [held[-1][last]]
                rows = len(held[0])
                yield links(out)
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run

"""Lineage cuts and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links of a node beyond which its rows are joined by broadcast and stay spread over tasks; there are MAX_HUBS of such
#: nodes at most, as the limit rises with the number of links.
HUB, MAX_HUBS = 1_000, 100_000
#: Links that one task may merge: 80 MB at most with 32-letter names of nodes.  More are merged in rounds.
ONE_TASK = 500_000


class Forest:
    """Merges numbered rows along links; ``root`` of a row is the smallest row that it is linked to so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes and components of all links of one partition."""
    held = [pdf for pdf in batches if len(pdf)]
    if held:
        pdf = pd.concat(held, ignore_index=True)
        code, nodes = pd.factorize(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), sort=True)
        forest = Forest(len(nodes))
        forest.merge(code[: len(pdf)], code[len(pdf) :])
        yield pd.DataFrame({"node": nodes, "component": nodes[forest.root]})


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.  Where none is set a private one serves local sessions; on a
    cluster its files would be lost with a machine, so there one has to be named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`cut` returned and nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _with_low(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v) with ``m`` of ``low`` (u, m, n): by broadcast for the hubs, so that their rows need not meet in a
    task, by shuffle for all others."""
    hubs = low.where(F.col("n") > max(HUB, 2 * n // MAX_HUBS)).select("u", "m")
    if not hubs.take(1):
        return rows.join(low.select("u", "m"), "u")
    hubs = F.broadcast(cut(hubs))
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(low.select("u", "m"), "u"))


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Component label (smallest node) of every node that has an edge.

    ``edges`` has two columns of one orderable type, read as undirected links.  Up to ``one_task`` links are merged in
    one task, which spares the rounds; the labels are the same.  More are merged by alternating the
    large-star and small-star rewrites: each round is a partial aggregate per node and an equi-join
    back, in which the rows of hubs stay where they are.
    Every round is written to the checkpoint folder, and the one before it is deleted; nothing is gathered on the
    driver but two numbers that tell whether a round changed the links.

    Nulls and self-links are ignored.  Returns ``node, component``.
    """
    a, b = edges.columns[:2]
    e = cut(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen, n = None, e.count()
    if n <= one_task:
        kind = e.schema["u"].dataType.simpleString()
        return cut(e.repartition(1).mapInPandas(_merged, f"node {kind}, component {kind}"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(_with_low(both.where("v > u"), low, n).where("m < v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = _with_low(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e, before = cut(small), e
        discard(large)
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    child = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return child.unionByName(child.select(F.col("component").alias("node"), "component").distinct())

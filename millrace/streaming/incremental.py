"""Structured Streaming: windowed aggregates with watermarks, and learners updated by ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts, sums and means by window and key; rows later than ``late`` are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap longer than ``gap``."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class IncrementalLearner:
    """Updates a learner that has ``partial_fit`` (or a clusterer with ``update``) on every batch of a stream."""

    def __init__(self, learner, label: str | None = None, features: list[str] | None = None):
        self.learner, self.label, self.features, self.batches = learner, label, features, 0

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        if not self.batches:
            self.learner.fit(batch, self.label, self.features)
        elif hasattr(self.learner, "partial_fit"):
            self.learner.partial_fit(batch)
        else:
            self.learner.update(batch)
        self.batches += 1

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        w = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (w.trigger(**trigger) if trigger else w).start()


def running_statistics(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and deviation by key, kept as state and updated with every batch."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))

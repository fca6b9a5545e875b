"""Structured Streaming forms of the change operators (X2 and the hand-over of its batches)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(batch: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each path of a batch."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, "r.*")


def debounced(stream: DataFrame, key: str, seq: str, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds"):
    """A query that hands the latest event of each path of every micro-batch to ``apply``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda df, i: apply(latest(df, key, seq), i)).start()


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Quiet gaps as session windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))

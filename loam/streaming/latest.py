"""File versions as a stream: the latest version of each path, and its diagnostics, kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_versions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(path, content, ts) stream to the newest version of each path in each window of ``delay``.

    State holds one row per path and open window; the watermark drops it when the window closes.
    """
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", delay), "path")
    newest = windowed.agg(F.max(F.struct("ts", "content")).alias("v"))
    return newest.select("path", "v.content", "v.ts")


def upsert_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch's rows, the newest of each path, to ``apply``; the checkpoint makes reruns exact."""

    def batch(rows: DataFrame, epoch: int) -> None:
        newest = rows.groupBy("path").agg(F.max(F.struct("ts", "content")).alias("v")).select("path", "v.content", "v.ts")
        apply(newest, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

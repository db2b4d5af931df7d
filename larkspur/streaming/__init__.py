"""Frames over streams: the same expressions on Structured Streaming, with event-time windows that close by a watermark.

A frame of :func:`scan_stream` is lazy like any other; filters, projections, joins with tables and grouped aggregates work on it. What needs all rows (sorting, row numbers,
windows without time) is refused by Spark when the stream starts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..expr import as_expr, flat, quoted
from ..frame import LazyFrame
from ..session import active


def scan_stream(path: str, schema: Any, *, format: str = "parquet", files_per_batch: int | None = None, **options: Any) -> LazyFrame:  # noqa: A002
    """A frame of the files of a folder and those that come. A stream's schema has to be given."""
    reader = active().readStream.format(format).schema(schema).options(**options)
    return LazyFrame((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path))


def group_by_window(frame: LazyFrame, time: str, every: str, *keys: str, late: str, slide: str | None = None) -> WindowedGroups:
    """Groups of event-time windows of a width, as "10 minutes", and keys. Rows later than ``late`` behind the latest seen are dropped, and by then a window is final."""
    return WindowedGroups(frame, time, every, keys, late, slide)


class WindowedGroups:
    def __init__(self, frame: LazyFrame, time: str, every: str, keys: tuple[str, ...], late: str, slide: str | None) -> None:
        self._df = frame.to_spark().withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, late)
        self._by = [F.window(quoted(time), every, slide or every).alias("window"), *map(quoted, keys)]
        self._keys = keys

    def agg(self, *aggs: Any) -> LazyFrame:
        """(window_start, window_end, keys, aggregates), of windows of streams once they are final."""
        from ..expr import Scope

        outputs = [c.alias(n) for e in flat(aggs) for n, c in as_expr(e, True).build(Scope(self._df))]
        out = self._df.groupBy(*self._by).agg(*outputs)
        rest = [c for c in out.columns if c != "window"]
        return LazyFrame(out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *map(quoted, rest)))


def drop_repeats(frame: LazyFrame, *keys: str, time: str, late: str) -> LazyFrame:
    """The first row of each key, with a state that is bounded by the watermark."""
    df = frame.to_spark().withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, late)
    return LazyFrame(df.dropDuplicatesWithinWatermark(list(keys)))


def sink_stream(frame: LazyFrame, path: str, checkpoint: str, *, format: str = "parquet", every: str | None = None) -> StreamingQuery:  # noqa: A002
    """Write a frame as it grows. Without ``every`` all that is there is processed, in as many batches as the source makes, and the query ends."""
    writer = frame.to_spark().writeStream.format(format).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)

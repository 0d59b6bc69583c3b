"""Streams by event time: sliding and session windows, repeated rows dropped within the watermark, late rows counted.

Frames may be streams or tables; on a table the watermark does nothing, so both give the same rows but for late ones. A row
is late by the watermark that the batch before its own began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unique_rows(rows: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """``rows`` (ts, ...) once for each value of ``keys``, as far as the watermark remembers; rows before it are dropped."""
    marked = rows.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else marked.dropDuplicates(keys)


def sliding_counts(rows: DataFrame, width: str, slide: str, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """(start, end, severity, n) of each window of ``width`` that begins every ``slide``; rows that repeat ``keys`` count once."""
    marked = unique_rows(rows, keys, late) if keys else rows.withWatermark("ts", late)
    counted = marked.groupBy(F.window("ts", width, slide), "severity").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "severity", "n")


def session_counts(rows: DataFrame, gap: str, late: str = "10 minutes", by: str = "entity") -> DataFrame:
    """(start, end, entity, n): each entity's runs of rows with less than ``gap`` between neighbours; end is ``gap`` after the last."""
    counted = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def written(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What is there of a stream of closed windows, written below ``out``; a restart goes on from ``checkpoint``."""
    return counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress that the query still knows. Those that reach a
    window are counted after they were grouped, those that ``unique_rows`` drops one by one."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

"""Text files as numbered lines, whatever their size.

Spark cuts a large file into splits; a line belongs to the split that its first byte is in. Splits count their lines, a
running sum over a file's splits, a row for each, says how many lines stand before a split, and a line's number is that
and its place in its split. No task reads a whole file, and no line is shuffled: only a row for each split meets others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.config import MAX_ROWS, algorithm
from siftline.sources.lines import js_trim
from siftline.staging import staged


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): every line of the files below ``path``, empty ones too, without its "\\n"; a "\\r" at its end stays.

    block is the first byte of the line's split.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _numbered(lines: DataFrame, number: str) -> DataFrame:
    """``lines`` (of ``split_lines``, maybe fewer) with their number from 0 on in their file, in place of block.

    A task reads its splits one after another, so Spark's own rising id, taken from what is kept, tells a line's place in
    its split. Lines are written once, since places must agree when they are read again.
    """
    placed = staged(lines.withColumn("place", F.monotonically_increasing_id()))
    splits = placed.groupBy("file", "block").agg(F.count("*").alias("held"), F.min("place").alias("first"))
    # one row for each split
    before = F.sum("held").over(Window.partitionBy("file").orderBy("block")) - F.col("held")
    offsets = staged(splits.select("file", "block", (before - F.col("first")).alias("offset")))
    return placed.join(offsets, ["file", "block"]).select("file", (F.col("place") + F.col("offset")).alias(number), "line")


def _jobs(lines: DataFrame) -> DataFrame:
    return lines.withColumn("job_id", F.xxhash64("file"))


def engine_file_lines(spark: SparkSession, path: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(job_id, row_id, line, file) of files as the engine sees payloads: every line but empty ones, ``max_rows`` of each file
    at most. A file without such lines has no row; job ids follow the files' paths."""
    kept = _numbered(split_lines(spark, path).where("line <> ''"), "row_id")
    return _jobs(kept.where(F.col("row_id") < max_rows)).select("job_id", "row_id", "line", "file")


def profiler_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, line_index, line, file) of files as the profiler sees payloads: trimmed lines that aren't blank."""
    trimmed = split_lines(spark, path).withColumn("line", js_trim("line")).where("line <> ''")
    return _jobs(_numbered(trimmed, "line_index")).select("job_id", "line_index", "line", "file")


def file_jobs(lines: DataFrame, name: str = "dbscan") -> DataFrame:
    """(job_id, algorithm, file): a row for each file of numbered lines."""
    return lines.select("job_id", "file").distinct().select("job_id", F.lit(algorithm(name)).alias("algorithm"), "file")

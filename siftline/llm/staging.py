"""What the corpus operators share in reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.wordkeys import slices
from siftline.staging import checkpoint_dir, shuffle_width, staged, unstage

__all__ = ["byte_batches", "checkpoint_dir", "documents", "fresh", "shuffle_width", "staged", "text_bytes", "unstage"]

#: Bytes of texts that Python works on at once; Spark's own limit of a batch is 64 MB.
BATCH_BYTES = 8 << 20


def byte_batches(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose texts hold BATCH_BYTES at most, or one row where a single text is longer."""
    for a, b in slices(batch.column(column), BATCH_BYTES):
        yield batch.slice(a, b - a)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, for columns of our own beside theirs."""
    taken = {c.lower() for t in tables for c in t.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, which set how many fragments a job is cut into."""
    return docs.select(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

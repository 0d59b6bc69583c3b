"""Labelled rows that the classifiers learn from, and their scores' common form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import byte_batches, staged

#: A score from which a document is predicted to be of label 1.
CUT = 0.7


def held_out(parts: int, kept_back: int) -> F.Column:
    """Whether crc32(doc_id as text) mod ``parts`` is ``kept_back``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == kept_back, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, kept_back: int, most: int, most_bytes: int) -> DataFrame:
    """(text, label) of labelled documents outside the part held out: those of least hash of the doc_id, ``most`` at
    most, whose texts together hold ``most_bytes`` at most.

    Null labels and ids are left out; of several labels of a document the largest holds, of several texts the one
    of least hash. Both bounds hold for rows, so the sample may be sent to the driver whole.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(parts, kept_back))
    rows = rows.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = rows.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").alias("id"), text.alias("text"))
    # bounded by ``most``, so it can go to every executor
    found = texts.join(F.broadcast(chosen), "id").groupBy("place", "id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    sample = staged(found.select("place", "id", "label", "least.text"))
    size = sample.select("place", "id", F.octet_length("text").alias("bytes")).toPandas().sort_values(["place", "id"])
    over = np.flatnonzero(size["bytes"].to_numpy().cumsum() > most_bytes)
    if len(over):
        place, last = (int(size[c].iloc[over[0]]) for c in ("place", "id"))
        sample = sample.where((F.col("place") < place) | ((F.col("place") == place) & (F.col("id") < last)))
    return sample.select("text", "label")


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], **more: F.Column) -> DataFrame:
    """``docs``' columns, a double ``score`` and the columns ``more``, in one pass over the texts.

    Columns of these names that ``docs`` has already are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("score", *more)))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for part in byte_batches(batch, "text"):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(part.column("text")), pa.float64())], names=[*part.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(run, schema).withColumns(more)


def kept(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], cut: float = CUT) -> DataFrame:
    """``docs``' rows whose text scores ``cut`` or more, unchanged."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for part in byte_batches(batch, "text"):
                    yield part.filter(pa.array(score(part.column("text")) >= cut))

    return docs.mapInArrow(run, docs.schema)

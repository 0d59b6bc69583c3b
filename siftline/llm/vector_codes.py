"""Vectors as short codes by product quantisation in whole numbers.

A vector's parts are coded one by one, each by the nearest entry of its part's codebook. Rows are packed into blocks of
NumPy columns, a row of the block for each component, and written once; codebooks are learnt by ``treeAggregate`` over the
blocks: squared distances to all entries accumulate dimension by dimension, ``np.add.at`` adds each component to its
entry's sum, and the tasks' tensors of sums and counts, whose size depends on the codebook alone, merge through a
reduction tree. All arithmetic is in 64-bit integers, so results don't depend on order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block, rows whose distances are held at once, levels of the reduction tree.
BLOCK, STRIP, DEPTH = 4096, 256, 2
#: Components up to this size keep every sum of squares below 2**63: up to 4096 components.
LARGEST = 1 << 24


def _whole(lists: pa.Array, dims: int) -> np.ndarray:
    """int64 columns [dims][rows] of integer lists; what a shorter list lacks is 0."""
    offsets = lists.offsets.to_numpy()
    size, values = np.diff(offsets), lists.values.to_numpy()[offsets[0] : offsets[-1]]
    if (size == dims).all():
        return values.reshape(len(size), dims).T.copy()
    out = np.zeros((dims, len(size)), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size), row] = values
    return out


def _packed(vectors: DataFrame, dims: int) -> DataFrame:
    """(n, vec_ids, known_ids, labels, known_labels, columns): blocks of up to BLOCK rows, components in the least integer type that holds them."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                columns = _whole(part.column("x"), dims)
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.abs(columns).max(initial=0) <= np.iinfo(t).max)
                names, labels = part.column("vec_id"), part.column("label")
                row = [part.num_rows, names.fill_null(0).to_numpy().tobytes(), names.is_valid().to_numpy(False).tobytes(), labels.fill_null(0).to_numpy().tobytes(), labels.is_valid().to_numpy(False).tobytes(), np.dtype(kind).str, columns.astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), *[pa.binary()] * 4, pa.string(), pa.binary()), strict=True)], names=["n", "vec_ids", "known_ids", "labels", "known_labels", "kind", "columns"])

    return vectors.mapInArrow(run, "n int, vec_ids binary, known_ids binary, labels binary, known_labels binary, kind string, columns binary")


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of one part's nearest entry for each row: columns [width][rows], book [width][entries]."""
    rows = columns.shape[1]
    best, far = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    total, apart = (np.empty((min(STRIP, rows), book.shape[1]), np.int64) for _ in range(2))
    for s in range(0, rows, STRIP):
        strip = columns[:, s : s + STRIP]
        n = strip.shape[1]
        total[:n] = 0
        for d in range(len(columns)):
            np.subtract(strip[d, :, None], book[d, None, :], out=apart[:n])
            np.multiply(apart[:n], apart[:n], out=apart[:n])
            np.add(total[:n], apart[:n], out=total[:n])
        best[s : s + n] = total[:n].argmin(1)
        far[s : s + n] = total[np.arange(n), best[s : s + n]]
    return best, far


def learnt(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [parts][width][entries] after some rounds over the blocks; an entry without rows stays."""
    parts, width, entries = books.shape

    def columns_of(row) -> np.ndarray:
        return np.frombuffer(row["columns"], row["kind"]).reshape(parts, width, row["n"]).astype(np.int64)

    for _ in range(rounds):
        held = books

        def add(total, row, held=held):
            sums, counts = total
            for p, columns in enumerate(columns_of(row)):
                code, _ = nearest(columns, held[p])
                np.add.at(counts[p], code, 1)
                for d in range(width):
                    np.add.at(sums[p, d], code, columns[d])
            return sums, counts

        def merge(a, b):
            return a[0] + b[0], a[1] + b[1]

        nothing = np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64)
        sums, counts = blocks.select("n", "kind", "columns").rdd.treeAggregate(nothing, add, merge, DEPTH)
        used = counts[:, None, :]
        books = np.where(used > 0, np.floor_divide(sums, np.maximum(used, 1)), books)
    return books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""
    parts, width, _ = books.shape

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                columns = np.frombuffer(r["columns"], r["kind"]).reshape(parts, width, r["n"]).astype(np.int64)
                found = [nearest(c, b) for c, b in zip(columns, books, strict=True)]
                codes = np.stack([code for code, _ in found], 1).astype(np.uint8)
                digits = codes.tobytes().hex()
                names, labels = (pa.array(np.frombuffer(r[c], np.int64), mask=~np.frombuffer(r[k], bool)) for c, k in (("vec_ids", "known_ids"), ("labels", "known_labels")))
                code = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)])
                yield pa.RecordBatch.from_arrays([names, labels, code, pa.array(sum(far for _, far in found))], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row for each row of ``vectors(vec_id, embedding, label)`` that is kept.

    Components count as floor(scale * x). Each part's codebook begins as that part of the ``entries`` (256 at most) rows of
    least vec_id; each round assigns every part to its nearest entry, ties to the lower one, and moves entries to the floor
    of their parts' mean. code has two hex digits a part; error is the squared distance to the coded vector, label_error its
    sum over rows of the same label, nulls together.

    Vectors that are null or hold null, NaN or infinite components are left out. A shorter vector counts as followed by
    zeros, up to the longest's length rounded up to whole parts; an empty one as zeros. Rows that repeat a vec_id are
    rows of their own, and equal in rank they begin the codebook by their components; a null vec_id never does while
    others are left. Fewer rows than entries make a shorter codebook. Components beyond 2**24 after scaling, whose
    squares might leave 64 bits, are an error. Other columns, of any name, are ignored. An empty table gives an empty table.
    """
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform("embedding", lambda v: F.floor(scale * v.cast("double")).cast("long"))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    largest = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    size = vectors.where(fine).agg(F.max(F.size("embedding")).alias("dims"), F.max(largest).alias("largest")).first()
    if size["dims"] is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if size["largest"] is not None and size["largest"] * scale > LARGEST:
        raise ValueError(f"components up to {size['largest']} are too large for sums of squares in 64 bits")
    width = max(1, -(-size["dims"] // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toPandas()["x"]  # 256 rows
    book = np.zeros((len(first), parts * width), np.int64)
    for i, v in enumerate(first):
        book[i, : len(v)] = v
    blocks = staged(_packed(kept, parts * width))
    books = learnt(blocks, book.T.reshape(parts, width, len(first)), rounds)
    coded = staged(_coded(blocks, books))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    both = coded.join(sums, coded.label.eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))

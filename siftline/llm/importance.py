"""Importance resampling towards a target distribution by hashed n-grams.

Runs of one to three words fall into buckets. What a bucket holds in the target against what it holds in the corpus is
its gain; a document's weight is the sum of its features' gains, and weight plus Gumbel noise, which follows from the
doc_id alone, is drawn from the top: a sample without replacement, in proportion to the weights' exponentials.

Long texts are cut at word boundaries into chunks that carry the next two words, and are dealt over tasks; a chunk owns
the features that start at its own words. Chunk counts and weights are summed by document.

A feature's bucket is its CRC-32. The checksum is linear over bits, so a run's comes from those of its words: that of
the words before, moved on by the last word's length in one table look-up per byte of state, and that word's own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import shuffle_width, staged
from siftline.llm.wordkeys import LOWER, Words, column_bytes, slices
from siftline.operators.spread import numbered

#: Words of a feature at most, buckets, bytes of a text from which it is cut, words that tables know the lengths of.
ORDERS, BUCKETS, CHUNK_BYTES, SHORT = 3, 10_000, 1 << 15, 32
#: Bytes that separate words: all of ASCII but digits and letters.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_FULL = np.uint32(0xFFFFFFFF)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next states of single bytes, states of each length n and byte of state after n zero bytes)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    moved = np.empty((SHORT + 1, 4, 256), np.uint32)
    moved[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        moved[n + 1] = (moved[n] >> 8) ^ table[moved[n] & 255]
    return table, moved


_TABLE, _MOVED = _crc_tables()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return (state >> np.uint32(8)) ^ _TABLE[(state ^ byte) & np.uint32(255)]


class Checksums:
    """CRC-32 states of runs of some texts' words, in lower case."""

    def __init__(self, words: Words):
        self.raw, self.start, self.row = LOWER[words.raw], words.start, words.row
        self.size = words.end - words.start
        self.own = np.zeros(len(self.size), np.uint32)  # of the word alone, from state 0
        order = np.argsort(-np.minimum(self.size, SHORT + 1), kind="stable")
        order = order[np.searchsorted(-self.size[order], -SHORT, "left") :]  # longer ones go byte by byte in zlib
        for i in range(int(self.size[order].max(initial=0))):
            some = order[: np.searchsorted(-self.size[order], -i, "left")]
            self.own[some] = _step(self.own[some], self.raw[self.start[some] + i])

    def followed(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after those words."""
        n = np.minimum(self.size[word], SHORT)
        out = self.own[word]
        for k in range(4):
            out = out ^ _MOVED[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(self.size[word] > SHORT).tolist():
            w = word[i]
            out[i] = zlib.crc32(self.raw[self.start[w] : self.start[w] + self.size[w]], int(state[i] ^ _FULL)) ^ 0xFFFFFFFF
        return out

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, CRC-32) of each run of one word, of two and of three, that stays inside its row."""
        first = np.arange(len(self.size))
        state = np.full(len(first), _FULL)
        for more in range(ORDERS):
            if more:
                inside = first + more < len(self.size)
                first, state = first[inside], state[inside]
                same = self.row[first] == self.row[first + more]
                first, state = first[same], _step(state[same], np.uint32(32))
            state = self.followed(state, first + more)
            yield first, state ^ _FULL


def _chunks(text: pa.Array, limit: int) -> Iterator[tuple[int, int, int, str]]:
    """(row, number, words carried, chunk) of each text: chunks begin at the first word from every ``limit`` bytes on."""
    for i in range(len(text)):
        one = text.slice(i, 1)
        raw, _ = column_bytes(one)
        inside = ~SEPARATOR[raw]
        start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        cuts = np.unique(np.searchsorted(start, np.arange(0, len(raw), limit)))
        cuts = cuts[cuts < len(start)]
        for k, a in enumerate(cuts.tolist()):
            b = int(cuts[k + 1]) if k + 1 < len(cuts) else len(start)
            last = min(b + ORDERS - 1, len(start))
            end = len(raw) if last == len(start) else int(start[last])
            yield i, k, last - b, raw[start[a] : end].tobytes().decode()


def _pieces(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(short, long): rows (doc, row, carry, text); long texts as chunks, written once so that row numbers stay."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0))
    doc = F.col("doc_id").cast("long").alias("doc")
    short = docs.where(size <= limit).select(doc, F.lit(0).cast("long").alias("row"), F.lit(0).alias("carry"), text.alias("text"))
    long = docs.where(size > limit).select(doc, F.monotonically_increasing_id().alias("row"), text.alias("text"))

    def cut(batches):
        for batch in batches:
            for i, k, carry, chunk in _chunks(batch.column("text"), limit):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("doc"), one.column("row"), pa.array([k], pa.int32()), pa.array([carry], pa.int32()), pa.array([chunk])], names=["doc", "row", "part", "carry", "text"])
            none = batch.slice(0, 0)
            yield pa.RecordBatch.from_arrays([none.column("doc"), none.column("row"), *(pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string()))], names=["doc", "row", "part", "carry", "text"])

    chunks = staged(long.mapInArrow(cut, "doc long, row long, part int, carry int, text string"))
    return short, chunks.repartition(shuffle_width(docs.sparkSession), "row", "part").select("doc", "row", "carry", "text")


def _owned(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(rows, own words of each, [(row, CRC-32) of its own features]) of a batch in parts of bounded size."""
    text = batch.column("text")
    for a, b in slices(text):
        words = Words(text.slice(a, b - a), SEPARATOR)
        carry = batch.column("carry").slice(a, b - a).to_numpy()
        held = np.diff(words.first) - carry
        own = np.arange(len(words.row)) < (words.first[:-1] + held)[words.row] if len(words.row) else np.zeros(0, bool)
        kept = []
        for first, crc in Checksums(words).runs():
            mine = own[first]
            kept.append((words.row[first[mine]], crc[mine]))
        yield batch.slice(a, b - a), held, kept


def bucket_counts(pieces: list[DataFrame], buckets: int) -> np.ndarray:
    """How many features each bucket holds; a row per task and bucket is summed, ``buckets`` rows come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, features in _owned(batch):
                for _, crc in features:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    each = [p.mapInArrow(run, "bucket long, n long") for p in pieces]
    every = each[0] if len(each) == 1 else each[0].union(each[1])
    out = np.zeros(buckets, np.int64)
    for r in every.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target against that in the corpus, both smoothed by one."""
    k = len(corpus)
    ratio = (target + 1.0) * float(corpus.sum() + k) / ((corpus + 1.0) * float(target.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(pieces: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc, row, n_words, n_features, weight) of each row of pieces."""

    def run(batches):
        for batch in batches:
            for part, held, features in _owned(batch):
                n, weight = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                for row, crc in features:
                    n += np.bincount(row, minlength=len(held))
                    # sums of whole numbers, exact in doubles
                    weight += np.bincount(row, gains[crc % np.uint32(len(gains))], len(held)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("row"), pa.array(held.astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc", "row", "n_words", "n_features", "weight"])

    return pieces.mapInArrow(run, "doc long, row long, n_words long, n_features long, weight long")


def _noise(seed: int) -> F.Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): each row of ``docs(doc_id, text)`` weighed towards ``target(text)``.

    Words are runs of other characters than ASCII's marks, blanks and controls, A-Z in lower case; features are all runs
    of one to three of them, repeats counted. Of the documents with at least ``min_words`` words ``percent`` in a
    hundred, rounded down, are drawn: rank counts them from 1 by falling score, ties by rising doc_id; others have null.
    Null and empty texts, and those without words, have no features and weight 0. Rows that repeat a doc_id are
    documents of their own with the same noise; a null doc_id has the noise of an empty name and comes first among
    ties. Texts of any length are read whole, over ``chunk_bytes`` in chunks. Other columns, of any name, are ignored. An
    empty table gives an empty table, an empty target a table all of whose buckets are even.
    """
    short, long = _pieces(docs, chunk_bytes)
    aim = target.select(F.lit(0).cast("long").alias("doc_id"), "text")
    gains = bucket_gains(bucket_counts([short, long], buckets), bucket_counts([*_pieces(aim, chunk_bytes)], buckets))
    summed = _weighed(long, gains).groupBy("doc", "row").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    every = _weighed(short, gains).unionByName(summed)
    scored = staged(every.select("doc", "n_words", "n_features", "weight", (F.col("weight") + _noise(seed)).alias("score")))
    able = scored.where(F.col("n_words") >= min_words).withColumns({"fall": -F.col("score"), "all": F.lit(0)})
    drawn = able.count() * percent // 100
    place = numbered(able, "all", ["fall", "doc", "n_features"], "place")
    out = place.select("doc", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    rest = scored.where(F.col("n_words") < min_words).select("doc", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest).withColumnRenamed("doc", "doc_id")

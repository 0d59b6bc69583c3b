"""How many keys (hashed n-grams) of each owner (a set of them) another owner has too, by vertical fragments.

The order of all keys is cut into fragments, one for each shuffle partition. A task packs its texts' keys into one
row for each fragment that occurs in them, having met repetitions among its own texts first, so a key that a third of
all documents hold costs each task one entry. A fragment's task looks at its share in runs of bounded size, sorted by
Spark, and its findings, packed by bucket of owners, are summed per owner. Rows out of each step are at most as many
as the keys in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import shuffle_width, text_bytes
from siftline.llm.wordkeys import mix

#: Keys that a task gathers before it packs them, at least and at most, and of one fragment before it cuts them to
#: runs; keys that a packed row has on average at least; bytes of text whose keys make a run.
PACK_KEYS, MOST_KEYS, CUT_KEYS, ROW_KEYS, RUN_BYTES = 1 << 19, 1 << 21, 1 << 21, 64, 8 << 20

#: run: part of a fragment, -1 for findings. counts: keys of each owner. several: whether several owners of one pack have the key.
_PACKED = pa.schema([("fragment", pa.int32()), ("run", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("several", pa.binary())])
_PACKED_DDL = "fragment int, run int, owners binary, counts binary, keys binary, several binary"
_FINDING = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary())])

#: Takes an Arrow batch; gives parts (owner of each key, key).
KeysOf = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _least(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key: order, least owner of the key, whether the key has several owners."""
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[begin, len(k)])
    least = np.repeat(np.minimum.reduceat(o, begin), size)
    return order, least, np.repeat(np.maximum.reduceat(o, begin), size) != least


def _parts(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places) of each number that occurs."""
    order = np.argsort(number, kind="stable")
    sorted_ = number[order]
    edge = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
        yield int(sorted_[a]), order[a:b]


def _row(fragment: int, run: int, owner: np.ndarray, key: np.ndarray, several: np.ndarray) -> tuple:
    order = np.argsort(owner, kind="stable")
    own, count = np.unique(owner[order], return_counts=True)
    return fragment, run, own.tobytes(), count.astype(np.int32).tobytes(), key[order].tobytes(), several[order].tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _run_of(key: np.ndarray, runs: int) -> np.ndarray:
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(runs) >> np.uint64(32)).astype(np.int64)


def packed_rows(owner: np.ndarray, key: np.ndarray, fragments: int, turn: int, runs: int = 1) -> list[tuple]:
    """A pack's rows: its keys by fragment and run, each key once with its least owner, and what is known already as a finding."""
    order, least, several = _least(owner, key)
    owner, key = owner[order], key[order]
    later, rows = several & (owner != least), []
    if later.any():  # findings go to other fragments' tasks from pack to pack
        own, count = np.unique(owner[later], return_counts=True)
        rows.append((turn % fragments, -1, own.tobytes(), count.astype(np.int32).tobytes(), b"", b""))
    keep = ~later
    owner, key, several = owner[keep], key[keep], several[keep]
    number = ((key >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
    # the upper bits of a key say which fragment it is in; the lower 32 tell keys apart well enough
    return rows + [_row(f // runs, f % runs, owner[at], key[at].astype(np.uint32), several[at]) for f, at in _parts(number * runs + _run_of(key, runs))]


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.concatenate([np.repeat(np.frombuffer(r["owners"], np.int64), np.frombuffer(r["counts"], np.int32)) for r in rows])
    return own, np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in rows]), np.concatenate([np.frombuffer(r["several"], bool) for r in rows])


def cut_rows(rows: list[dict], runs: int) -> list[tuple]:
    """Many packs' rows of one fragment, cut into its runs."""
    own, key, several = _unpacked(rows)
    return [_row(rows[0]["fragment"], r, own[at], key[at], several[at]) for r, at in _parts(_run_of(key.astype(np.uint64), runs))]


def _merged(owners: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(owners), return_inverse=True)
    return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)


def finding_rows(owner: np.ndarray, count: np.ndarray, buckets: int) -> list[tuple]:
    bucket = (mix(owner.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return [(b, owner[at].tobytes(), count[at].astype(np.int32).tobytes()) for b, at in _parts(bucket)]


def shared_counts(docs: DataFrame, keys_of: KeysOf, column: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(owner, n): for each owner how many of its keys, as ``keys_of`` gives them, another owner has too; none: no row.

    An owner that stands in several rows counts for each. 32 bits of a key within its fragment are compared: a rare
    collision then counts a key as shared that is not, so n is an upper bound.
    """
    fragments = shuffle_width(docs.sparkSession)
    runs = max(1, -(-text_bytes(docs, column) // (fragments * run_bytes)))
    # packs are cut to runs at once where their rows are long enough then, and else where many packs have met
    at_once = ROW_KEYS * fragments * runs <= MOST_KEYS
    first_runs = runs if at_once else 1
    pack_keys = min(max(PACK_KEYS, ROW_KEYS * fragments * first_runs), MOST_KEYS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, turn = [], 0, 7919 * TaskContext.get().partitionId()
        for batch in batches:
            for part in keys_of(batch):
                parts.append(part)
                size += len(part[1])
                if size >= pack_keys:
                    turn += 1
                    yield _batch(packed_rows(*map(np.concatenate, zip(*parts, strict=True)), fragments, turn, first_runs), _PACKED)
                    parts, size = [], 0
        if size:
            yield _batch(packed_rows(*map(np.concatenate, zip(*parts, strict=True)), fragments, turn, first_runs), _PACKED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["run"] < 0:
                    yield _batch([tuple(row.values())], _PACKED)
                    continue
                held.append(row)
                size += len(row["several"])
                if size >= CUT_KEYS:
                    yield _batch(cut_rows(held, runs), _PACKED)
                    held, size = [], 0
        if held:
            yield _batch(cut_rows(held, runs), _PACKED)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One run after another; rows of a run follow each other."""
        held, owners, counts, size = [], [], [], 0

        def settle():
            own, key, several = _unpacked(held)
            order, _, many = _least(own, key)
            key, several = key[order], several[order]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            hit = many | np.repeat(np.logical_or.reduceat(several, begin), np.diff(np.r_[begin, len(key)]))
            return np.unique(own[order][hit], return_counts=True)

        for batch in batches:
            for row in batch.to_pylist():
                if row["run"] < 0:
                    own, count = np.frombuffer(row["owners"], np.int64), np.frombuffer(row["counts"], np.int32)
                else:
                    if not held or held[-1]["run"] == row["run"]:
                        held.append(row)
                        continue
                    own, count = settle()
                    held = [row]
                owners.append(own)
                counts.append(count)
                size += len(own)
                if size >= PACK_KEYS:
                    yield _batch(finding_rows(*_merged(owners, counts), fragments), _FINDING)
                    owners, counts, size = [], [], 0
        if held:
            own, count = settle()
            owners.append(own)
            counts.append(count)
            size += len(own)
        if size:
            yield _batch(finding_rows(*_merged(owners, counts), fragments), _FINDING)

    def sum_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As much memory as the bucket has owners."""
        owners, counts, size = [], [], 0
        for batch in batches:
            for o, c in zip(batch.column("owners").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                owners.append(np.frombuffer(o, np.int64))
                counts.append(np.frombuffer(c, np.int32))
                size += len(owners[-1])
            if size >= 4 * PACK_KEYS:
                own, count = _merged(owners, counts)
                owners, counts, size = [own], [count], 0
        if owners:
            own, count = _merged(owners, counts)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count)], names=["owner", "n"])

    packed = docs.mapInArrow(pack, _PACKED_DDL).repartitionById(fragments, F.col("fragment"))
    if not at_once:
        packed = packed.mapInArrow(cut, _PACKED_DDL)
    if runs > 1:
        packed = packed.sortWithinPartitions("run")
    findings = packed.mapInArrow(look, "bucket int, owners binary, counts binary")
    return findings.repartitionById(fragments, F.col("bucket")).mapInArrow(sum_, "owner long, n long")

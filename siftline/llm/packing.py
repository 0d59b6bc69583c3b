"""Packing token sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a remainder. The remainders' length histogram is the demand of a
cutting-stock problem. Its linear relaxation is solved over patterns (how many pieces of each length fill a
sequence): a greedy fractional packing gives the first basis, and a knapsack by dynamic programming prices better
patterns into it. Patterns are used as often as the rounded solution says, and what rounding leaves is packed by
decreasing length. The plan's size depends on the capacity alone. Each piece finds its place by its rank among the
pieces of its length.

Remainders stay whole where that packs well. Where it can't (few documents, or lengths that don't go together) they
are cut at halves, quarters and eighths of a sequence and packed again by the same method.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.staging import staged
from siftline.llm.wordkeys import slices

CAPACITY, END_ID = 1024, 0
#: Where whole remainders would leave more than this share of all sequences as padding, they are cut at 1/2, 1/4 and
#: 1/8 of a sequence: 2 to the power of these.
PADDING, CUTS = 0.01, (1, 2, 3)
#: Ranks among equal lengths are counted by bucket first, then inside each: pieces of a bucket, about.
BUCKET_PIECES = 512
#: The linear program's relative gap at which pricing ends, and its most rounds.
GAP, ROUNDS = 2e-4, 200
#: Texts for which both tokenizer libraries read the same letter classes; others go the slower way.
_COMMON = re.compile("[^\x00-ɏ‐-‧]|<\\|endoftext\\|>")
#: A run of white space from which the quick library's pattern might overflow its stack.
LONG_BLANK = 1 << 15
_BLANK_RUN = re.compile(r"\s{%d}" % LONG_BLANK)


@functools.lru_cache(maxsize=2)
def _tokenizers(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(ranks, "rb") as lines:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return full, tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def token_ids(text: str, path: str) -> list[int]:
    """The ids of the tokenizer file at ``path``; the same vocabulary's rank file beside it is read faster."""
    full, quick = _tokenizers(path)
    if _COMMON.search(text) or (len(text) > LONG_BLANK and _BLANK_RUN.search(text)):
        return full.encode(text, add_special_tokens=False).ids
    return quick.encode_ordinary(text)


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a remainder's parts, should it be cut."""
    out, at = [], 0
    for power in CUTS:
        part = capacity >> power
        if part and tokens - at >= part:
            out.append((at, part))
            at += part
    return [*out, (at, tokens - at)] if at < tokens else out


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, parts): each document's ids and an end id, as full sequences and a remainder.

    parts: for a remainder, (start, length, ids_crc32) of each of its parts one after another, should it be cut.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"]

    def pieces(text: str) -> list[tuple]:
        tokens = np.array([*token_ids(text, path), END_ID], "<u4")
        check = lambda s, n: zlib.crc32(tokens[s : s + n].tobytes())
        out = [(s, capacity, check(s, capacity), len(tokens), None) for s in range(0, len(tokens) - capacity + 1, capacity)]
        at = len(out) * capacity
        if at < len(tokens):
            parts = [x for s, n in cut(len(tokens) - at, capacity) for x in (at + s, n, check(at + s, n))]
            out.append((at, len(tokens) - at, check(at, len(tokens)), len(tokens), parts))
        return out

    def run(batches):
        for batch in batches:
            ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(text):
                rows, known = [], {}
                for doc, t in zip(ids[a:b], text.slice(a, b - a).to_pylist(), strict=True):
                    t = t or ""
                    if t not in known:
                        known[t] = pieces(t)
                    rows += [(doc, *piece) for piece in known[t]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>")


def _cut_up(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with every remainder cut to its parts."""
    at = lambda i, k: F.element_at("parts", (3 * i + k).cast("int"))
    number = F.sequence(F.lit(0), (F.size("parts") / 3 - 1).cast("int"))
    each = pieces.where(F.col("length") < capacity).withColumn("i", F.explode(number))
    parts = each.select("doc_id", at(F.col("i"), 1).alias("start"), at(F.col("i"), 2).alias("length"), at(F.col("i"), 3).alias("ids_crc32"), "doc_tokens")
    return pieces.where(F.col("length") == capacity).drop("parts").union(parts)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's value and counts: pieces worth ``worth`` each, ``lengths`` ascending."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        n = fits[c]
        gain = value[c - lengths[:n]] + worth[:n]
        i = int(gain.argmax())
        if gain[i] > value[c - 1] + 1e-12:
            value[c], choice[c] = gain[i], i
        else:
            value[c] = value[c - 1]
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(lengths[choice[c]])
    return float(value[capacity]), counts


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible basis, a column for each length.

    Sequences are filled by decreasing length, fractions allowed: each pattern is used until one of its lengths is
    used up, and that length occurs in no later pattern, so the columns are independent. A length that is used up
    together with another has a column of its own.
    """
    m = len(lengths)
    left, columns = demand.astype(float), np.zeros((m, m), np.int64)
    open_ = left > 0
    while open_.any():
        pattern, room, i = np.zeros(m, np.int64), capacity, m - 1
        while i >= 0 and room >= lengths[0]:
            i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
            while i >= 0 and not open_[i]:
                i -= 1
            if i >= 0:
                n = max(1, min(room // int(lengths[i]), int(np.ceil(left[i]))))
                pattern[i] = n
                room -= n * int(lengths[i])
                i -= 1
        some = np.flatnonzero(pattern)
        uses = left[some] / pattern[some]
        last = some[uses.argmin()]
        left[some] -= uses.min() * pattern[some]
        left[last] = 0
        open_ = left > 1e-9
        columns[:, last] = pattern
    alone = np.flatnonzero(columns.sum(0) == 0)
    columns[alone, alone] = capacity // lengths[alone]
    return columns


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts per length, uses) of the patterns that together hold the demand exactly.

    Revised simplex; the basis stays primal feasible, so stopping at a small gap, or after ROUNDS, is safe.
    """
    m = len(lengths)
    columns = _first_basis(lengths, demand, capacity)
    inverse = np.linalg.inv(columns)
    x = np.maximum(inverse @ demand, 0)
    for _ in range(ROUNDS):
        value, new = best_pattern(lengths, inverse.sum(0), capacity)
        if value <= 1 + GAP:
            break
        direction = inverse @ new
        up = np.flatnonzero(direction > 1e-9)
        out = up[np.argmin(x[up] / direction[up])]
        step = x[out] / direction[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        row = inverse[out] / direction[out]
        touched = np.flatnonzero(direction)
        inverse[touched] -= np.outer(direction[touched], row)
        inverse[out] = row
        columns[:, out] = new
    uses = np.floor(x + 1e-7).astype(np.int64)
    left = demand - columns @ uses
    while (left < 0).any():  # rounding errors only
        uses[np.flatnonzero((columns[left < 0].sum(0) > 0) & (uses > 0))[0]] -= 1
        left = demand - columns @ uses
    plan = [(columns[:, p], int(uses[p])) for p in range(m) if uses[p]]
    return plan + [(c, 1) for c in _decreasing(lengths, left, capacity)]


def _decreasing(lengths: np.ndarray, count: np.ndarray, capacity: int) -> list[np.ndarray]:
    """What rounding leaves: each sequence takes the longest piece that still fits, again and again."""
    count, out = count.copy(), []
    while count.any():
        pattern, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            i = int(np.searchsorted(lengths, room, "right")) - 1
            while i >= 0 and not count[i]:
                i -= 1
            if i < 0:
                break
            n = min(int(count[i]), room // int(lengths[i]))
            pattern[i] += n
            count[i] -= n
            room -= n * int(lengths[i])
        out.append(pattern)
    return out


def _padding(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]], capacity: int) -> int:
    """Ids that fill up the plan's sequences; one that is a power of two long is not filled up."""
    used = [(int(counts @ lengths), uses) for counts, uses in plan]
    return sum((capacity - n) * uses for n, uses in used if n & (n - 1))


def placement(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces per sequence, first offset), sorted by first rank."""
    rank, sequence, rows = dict.fromkeys(lengths.tolist(), 0), 0, {n: [] for n in lengths.tolist()}
    for counts, uses in plan:
        offset = 0
        for i in np.flatnonzero(counts):
            n, per = int(lengths[i]), int(counts[i])
            rows[n].append((rank[n], sequence, per, offset))
            rank[n] += per * uses
            offset += per * n
        sequence += uses
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def _plan(pieces: DataFrame, capacity: int) -> tuple[np.ndarray, np.ndarray, list, float]:
    """(lengths, demand, plan, share of padding) of the pieces shorter than a sequence; at most ``capacity`` lengths come to the driver."""
    held = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    full = held.pop(capacity, 0)
    lengths = np.array(sorted(held), np.int64)
    demand = np.array([held[n] for n in lengths.tolist()], np.int64)
    plan = cutting_stock(lengths, demand, capacity) if len(lengths) else []
    sequences = full + sum(uses for _, uses in plan)
    return lengths, demand, plan, _padding(lengths, plan, capacity) / max(1, sequences * capacity)


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (from ``token_pieces``) with (sequence_id, offset): odd ids for full pieces, even ones for the packed others."""
    pieces = staged(pieces)
    whole = pieces.drop("parts")
    lengths, demand, plan, padding = _plan(whole, capacity)
    if padding > PADDING:
        parts = _cut_up(pieces, capacity)
        other = _plan(parts, capacity)
        if other[3] < padding:
            whole, (lengths, demand, plan, _) = parts, other
    where = placement(lengths, plan)

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = where[int(n)]
                first, base, per, begin = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                sequence[own] = 2 * (base + (rank[own] - first) // per)
                offset[own] = begin + (rank[own] - first) % per * n
            batch = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    # as many buckets for each length as its pieces need
    buckets = np.ones(capacity, np.int64)
    buckets[lengths] = -(-demand // BUCKET_PIECES)
    many = F.get(F.split(F.lit(",".join(map(str, buckets.tolist()))), ",").cast("array<bigint>"), F.col("length").cast("int"))
    rest = whole.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), many))
    counts = rest.groupBy("length", "bucket").agg(F.count("*").alias("held"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = counts.select("length", "bucket", (F.sum("held").over(running) - F.col("held")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    names = [*whole.columns]
    ranked = rest.withColumn("inside", inside - 1).join(ahead, ["length", "bucket"]).select(*names, (F.col("ahead") + F.col("inside")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema) + ", sequence_id long, offset long"
    full = whole.where(F.col("length") == capacity).select("*", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(ranked.mapInArrow(place, schema))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each row of ``docs(doc_id, text)``.

    Each text's ids are followed by one end id, so null and empty texts are pieces of length 1. Sequences hold at
    most ``capacity`` ids and start at offset 0 without gaps. Texts of any length are read whole, long runs of white
    space too. Repeated rows and rows with a null doc_id are packed like others, each once. Other columns are
    ignored. An empty table gives an empty table.
    """
    return packed(token_pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity), capacity)

"""Byte-level BPE over tables of distinct words.

A text is cut into words before every blank that follows something else: there the tokenizer's pattern always begins anew,
so the words' ids, one after another, are the text's. Texts are gathered into packs of bounded size, whose distinct words
are numbered, so a document is a list of numbers. The packs' distinct words are dealt by their hash and meet in one table
per shuffle partition, where each distinct word is encoded once, however many packs and texts hold it. Its ids go back to
the packs, by number, and each document's ids are put together by position. Decoding looks every id up in the table of the
vocabulary's pieces, which the tokenizer file bounds.

What is shuffled is compressed: the packs' distinct words, a row for each pack and partition, their ids, and the documents'
numbers. A word that all texts hold costs each pack one entry.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm.staging import byte_batches, shuffle_width

#: Bytes of text in a pack: as many as give each partition a row of some length, in these bounds; words encoded at once.
ROW_BYTES, LEAST_BYTES, MOST_BYTES, WORDS_AT_ONCE = 4096, 8 << 20, 128 << 20, 1 << 14
#: White space before a blank, and the places where a text with such is cut.
_TIGHT, _CUT = re.compile(r"\s |\x00"), re.compile(r"(?<=\S)(?= )")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    for token in out.get_added_tokens_decoder().values():
        if token.lstrip or token.rstrip or re.search(r"\s", token.content):
            raise ValueError(f"{path}: the added token {token.content!r} takes blanks, so words can't be encoded one by one")
    return out


def words_of(text: str) -> list[str]:
    """The words of a text, with the blanks before them; one after another they are the text."""
    if _TIGHT.search(text):
        return [w for w in _CUT.split(text) if w]
    return [w for w in text.replace(" ", "\x00 ").split("\x00") if w]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    many = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], 4 * many, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, many).T).view("<u4").ravel()


def _runs_of(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value that occurs."""
    order = np.argsort(values, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(values[order])) + 1).tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield int(values[order[a]]), order[a:b]


#: digest: of the pack's words in order, so that the two readings of a pack can't be taken for one another.
_WORDS = pa.schema([("pack", pa.int64()), ("digest", pa.int64()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
_PLACES = pa.schema([("pack", pa.int64()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("places", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _packs(docs: DataFrame, pack_bytes: int, schema: pa.Schema, rows_of: Callable) -> DataFrame:
    """``rows_of(pack, words, [(doc_id, places)])`` of each pack of each task's documents."""

    def run(batches):
        pack, number, docs_, size = TaskContext.get().partitionId() << 32, {}, [], 0
        for batch in batches:
            for part in byte_batches(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = words_of(text or "")
                    docs_.append((doc, np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint32, len(words))))
                    size += len(text or "") + 16
                    if size >= pack_bytes:
                        yield from rows_of(pack, list(number), docs_)
                        pack, number, docs_, size = pack + 1, {}, [], 0
        if docs_:
            yield from rows_of(pack, list(number), docs_)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, _ddl(schema))


def _digest(words: list[bytes]) -> int:
    out = 0
    for w in words:
        out = zlib.crc32(w, out)
    return out


def packed_words(docs: DataFrame, pack_bytes: int, buckets: int) -> DataFrame:
    """(pack, digest, bucket, numbers, sizes, body): each pack's distinct words, a row for each bucket of them."""

    def rows_of(pack, words, _):
        raw = [w.encode() for w in words]
        digest, size = _digest(raw), np.fromiter((len(w) for w in raw), np.int64, len(raw))
        bucket = np.fromiter((zlib.crc32(w) for w in raw), np.uint64, len(raw)) * np.uint64(buckets) >> np.uint64(32)
        rows = [(pack, digest, b, _squeezed(at), _squeezed(size[at]), pa.Codec("zstd", 1).compress(b"".join([raw[i] for i in at.tolist()]), asbytes=True)) for b, at in _runs_of(bucket.astype(np.int64))]
        if rows:
            yield _batch(rows, _WORDS)

    return _packs(docs, pack_bytes, _WORDS, rows_of)


def packed_places(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """(pack, digest, doc_id, places): each document as the numbers of its words in its pack."""

    def rows_of(pack, words, docs_):
        digest = _digest([w.encode() for w in words])
        yield _batch([(pack, digest, doc, _squeezed(places)) for doc, places in docs_], _PLACES)

    return _packs(docs, pack_bytes, _PLACES, rows_of)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(pack, digest, numbers, sizes, ids) of ``packed_words`` whose partitions hold whole buckets: a task keeps a table of
    its distinct words, and each is encoded when it comes up first."""
    schema = pa.schema([*[_WORDS.field(c) for c in ("pack", "digest", "numbers", "sizes")], ("ids", pa.binary())])

    def run(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for r in batch.to_pylist():
                size = _unsqueezed(r["sizes"]).astype(np.int64)
                body = pa.Codec("zstd").decompress(r["body"], int(size.sum()), asbytes=True)
                end = np.cumsum(size)
                found = [body[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                new = [w for w in dict.fromkeys(found) if w not in known]
                for s in range(0, len(new), WORDS_AT_ONCE):
                    some = new[s : s + WORDS_AT_ONCE]
                    codes = _tokenizer(path).encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                    known.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(some, codes, strict=True))
                ids = [known[w] for w in found]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                yield _batch([(r["pack"], r["digest"], r["numbers"], _squeezed(sizes), _squeezed(np.frombuffer(b"".join(ids), "<u4")))], schema)

    return words.mapInArrow(run, _ddl(schema))


def _letters() -> dict[str, int]:
    """The byte behind each letter of the vocabulary's alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the vocabulary's pieces by id; the offsets of an id that isn't there are equal."""
    letter, found = _letters(), _tokenizer(path).get_vocab(with_added_tokens=True)
    size = np.zeros(max(found.values()) + 2, np.int64)
    for piece, i in found.items():
        size[i + 1] = len(piece)
    by_id = {i: piece for piece, i in found.items()}
    return np.frombuffer(bytes(letter[c] for i in sorted(by_id) for c in by_id[i]), np.uint8), np.cumsum(size)


def _flat(values: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The runs values[offsets[p]:offsets[p + 1]] of the places p, one after another."""
    size = (offsets[1:] - offsets[:-1])[places]
    end = np.cumsum(size)
    return values[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(offsets[places] - (end - size), size)]


def decoded(ids: np.ndarray, path: str) -> str:
    """The text of ids, each looked up in the table of pieces."""
    return _flat(*pieces(path), ids).tobytes().decode("utf-8", "replace")


def _by_number(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a pack's words in the order of their numbers."""
    if not rows:
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    number, size, ids = (np.concatenate([_unsqueezed(r[c]) for r in rows]) for c in ("numbers", "sizes", "ids"))
    order, begin = np.argsort(number, kind="stable"), np.r_[0, np.cumsum(size, dtype=np.int64)]
    return _flat(ids, begin, order), np.r_[0, np.cumsum(size[order], dtype=np.int64)]


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _documents(docs: DataFrame, path: str, out: Callable, schema: str, pack_bytes: int | None) -> DataFrame:
    """``out(doc_id, ids)`` of every document, its pack's words and its numbers having met."""
    width = shuffle_width(docs.sparkSession)
    pack_bytes = pack_bytes or min(MOST_BYTES, max(LEAST_BYTES, ROW_BYTES * width))
    words = packed_words(docs, pack_bytes, width).repartitionById(width, F.col("bucket"))
    known = encoded_words(words, path).withColumnRenamed("pack", "home")
    names, kinds = zip(*((c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")), strict=True)

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        coded = right.to_pylist()
        ids, at = _by_number(coded)
        digests, rows = {r["digest"] for r in coded}, []
        for batch in left.to_batches():
            for r in batch.to_pylist():
                if digests and r["digest"] not in digests or len(digests) > 1:
                    raise ValueError("the documents came in another order when they were read again: write them to a table first")
                rows.append(out(r["doc_id"], _flat(ids, at, _unsqueezed(r["places"]))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=list(names))

    return packed_places(docs, pack_bytes).groupBy("pack").cogroup(known.groupBy("home")).applyInArrow(put, schema)


def encode_documents(docs: DataFrame, path: str, pack_bytes: int | None = None) -> DataFrame:
    """(doc_id, ids): each row of ``docs(doc_id, text)`` as the ids of the byte-level BPE file at ``path``, no special tokens added.

    Ids are those of the tokenizers library for the whole text, added tokens in the text being single ids. Null and
    empty texts have no ids. Repeated rows and rows with a null doc_id come back as often as they are there. Texts and
    words of any length are taken whole. Other columns, of any name, are ignored. An empty table gives an empty table.
    ``docs`` is read twice and must come in the same order both times, as a table does; otherwise this is an error.
    """
    return _documents(docs, path, lambda doc, ids: (doc, ids.astype(np.int32)), "doc_id long, ids array<int>", pack_bytes)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``coded(doc_id, ids)``: each id joined with its piece by the vocabulary's table; bytes that are no
    UTF-8 become U+FFFD. Null and empty ids give an empty text."""

    def run(batches):
        for batch in batches:
            texts = [decoded(np.array(ids or [], np.int64), path) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str, pack_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode_documents``' ids as little-endian unsigned 32-bit
    integers, and of the UTF-8 of the text that they decode to. What it takes is what ``encode_documents`` takes."""

    def out(doc, ids):
        return doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded(ids, path).encode()).hexdigest()

    return _documents(docs, path, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", pack_bytes)

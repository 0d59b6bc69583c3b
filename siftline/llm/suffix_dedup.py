"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at content-selected positions: the minimiser of every window of ``min_words`` words, so a
passage of that length has the same suffixes kept wherever it stands. A suffix whose first words (its head) stand in
one document only can't match and goes. The others are dealt by their heads and sorted by their words; neighbours are
compared for the words they have in common. Matches are extended to the left inside their documents by comparing the
words before the kept positions, as far as the windows of that minimiser reach, and longer passages are the unions
of their windows.

Where very many documents share a head, its suffixes would all fall to one task: those are dealt by the longest words
that a window of theirs has, all of its own, a record for each window, and are sorted and compared like the others.

Hashes choose positions and deal records; what matches is decided on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.staging import fresh, shuffle_width, staged
from siftline.llm.wordkeys import LOWER, SEPARATOR, Words, runs, slices

#: Words of a suffix's head; words of a text in which places are told apart at once; records compared at once; the
#: records from which a head is frequent; frequent heads at most (8 MB, they go to every executor).
ANCHOR_WORDS, SPAN, CHUNK, FREQUENT, BROADCAST_HEADS = 16, 1 << 25, 1 << 15, 1 << 11, 1_000_000


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(words: Words, hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's anchor, grams): anchors are minimisers, the rightmost of equal ones."""
    anchor = min(ANCHOR_WORDS, min_words)
    grams = runs(hashes, anchor)
    width = min_words - anchor + 1
    all_starts, all_anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low = np.uint64((1 << 26) - 1)
    for begin in range(0, len(hashes) - min_words + 1, SPAN):
        part = grams[begin : begin + SPAN + width - 1]
        place = np.arange(len(part), dtype=np.uint64)
        least = _window_minimum((part & ~low) | (low - place), width)
        starts = np.flatnonzero(words.row[begin : begin + len(least)] == words.row[begin + min_words - 1 :][: len(least)])
        all_starts.append(starts + begin)
        all_anchors.append((low - (least[starts] & low)).astype(np.int64) + begin)
    return np.concatenate(all_starts), np.concatenate(all_anchors), grams


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    text = batch.column(batch.schema.get_field_index("text"))
    for a, b in slices(text):
        words = Words(text.slice(a, b - a))
        yield batch.slice(a, b - a), words, words.hashes()


def _heads(docs: DataFrame, min_words: int) -> DataFrame:
    """(head, doc, place, known): the kept suffixes. Of those with one head in a task's texts only the documents of least
    id are not known to be shared; so a head that all documents have costs each task one row to look up.
    """

    def run(batches):
        for batch in batches:
            for part, words, hashes in _rows(batch):
                _, anchor, grams = anchors(words, hashes, min_words)
                kept = np.unique(anchor)
                if not len(kept):
                    continue
                row = words.row[kept]
                doc, head, place = part.column("doc").to_numpy()[row], grams[kept].view(np.int64), kept - words.first[row]
                order = np.argsort(head, kind="stable")
                doc, head, place = doc[order], head[order], place[order]
                begin = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
                least = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(head)]))
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(doc), pa.array(place), pa.array(doc != least)], names=["head", "doc", "place", "known"])

    return docs.mapInArrow(run, "head long, doc long, place long, known boolean")


def _matched(docs: DataFrame, min_words: int, frequent: int) -> tuple[DataFrame, np.ndarray]:
    """((doc, places), frequent heads): each document's kept positions whose head another document has too; the heads of more
    than ``frequent`` places, or of as many more as leaves BROADCAST_HEADS of them, sorted."""
    heads = staged(_heads(docs, min_words))
    shared = staged(heads.groupBy("head").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("many")).where("least < most").select("head", "many"))
    while shared.where(F.col("many") > frequent).count() > BROADCAST_HEADS:
        frequent *= 2
    often = shared.where(F.col("many") > frequent).select("head").toPandas()["head"].to_numpy(np.int64)
    # known rows have a lesser document in their task, so they are shared whatever the others say
    every = heads.where("known").select("doc", "place").union(heads.where("not known").join(shared.select("head"), "head").select("doc", "place"))
    return every.groupBy("doc").agg(F.collect_set("place").alias("places")), np.sort(often)


def _joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(text, begins, ends) of all words one after another in lower case, one blank between them."""
    size = words.end - words.start
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    letters = LOWER[words.raw[~SEPARATOR[words.raw]]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out.tobytes(), begin, begin + size


_RECORD = "head long, after string, before string, doc long, places array<long>, many array<long>, fewest long, most long, several boolean"
_RUNS = "doc long, runs array<struct<start: long, many: long, later: boolean>>"


def _united(group: np.ndarray, start: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, starts, lengths) of the unions of each group's runs, sorted; starts and lengths are below 2**31."""
    if not len(group):
        return group, start, many
    order = np.lexsort((start, group))
    group, start, many = group[order], start[order], many[order]
    new = np.r_[True, group[1:] != group[:-1]]
    base = np.cumsum(new) << 33
    end = np.maximum.accumulate(base + start + many)
    edge = np.flatnonzero(new | np.r_[True, (base + start)[1:] > end[:-1]])
    return group[edge], start[edge], (end - base)[np.r_[edge[1:], len(group)] - 1] - start[edge]


def _contexts(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple]:
    """For each part of a batch (text, first, last, kept, doc, place, most, fewest, heads, windows): its words as one text with
    their bounds there, the positions in ``places``, whose windows begin ``fewest`` to ``most`` words before, and hashes of all windows."""
    for part, words, hashes in _rows(batch):
        starts, anchor, grams = anchors(words, hashes, min_words)
        wanted = np.zeros(len(hashes) + 1, bool)
        for i, places in enumerate(part.column("places").to_pylist()):
            at = np.asarray(places, np.int64) + words.first[i]
            wanted[at[at < words.first[i + 1]]] = True
        begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
        end = np.r_[begin[1:], len(anchor)] - 1 if len(begin) else begin
        own = wanted[anchor[begin]]
        begin, end = begin[own], end[own]
        if len(begin):
            kept = anchor[begin]
            row = words.row[kept]
            text, first, last = _joined(words)
            yield text, first.tolist(), last.tolist(), kept.tolist(), part.column("doc").to_numpy()[row].tolist(), (kept - words.first[row]).tolist(), (kept - starts[begin]).tolist(), (kept - starts[end]).tolist(), grams[kept].view(np.int64), runs(hashes, min_words).view(np.int64)


def _suffixes(docs: DataFrame, min_words: int, often: np.ndarray) -> DataFrame:
    """A record for each matched position: the words after it and before it that its windows reach; where its head is one of
    ``often``, a record for each of its windows, dealt by all of the window's words. A document's positions that agree in all
    of this are one record with their ``places``, however often it repeats a phrase.

    Records that agree inside a task become one, that of the least document, with ``several`` set; the others' windows are
    settled: a row for each document (``head`` null) has their runs, ``places`` where these begin and ``many`` windows in each.
    """
    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.int64()] * 2, pa.bool_()]

    def run(batches):
        for batch in batches:
            for text, first, last, kept, doc, place, most, fewest, heads, windows in _contexts(batch, min_words):
                groups: dict[tuple, list[tuple[int, int]]] = {}
                frequent = np.isin(heads, often, assume_unique=False).tolist()
                for i, (p, m, f, h) in enumerate(zip(kept, most, fewest, heads.tolist(), strict=True)):
                    for far, near, key in [(n, n, int(windows[p - n])) for n in range(f, m + 1)] if frequent[i] else [(m, f, h)]:
                        groups.setdefault((text[first[p - far] : last[p + min_words - near - 1]], far, near), []).append((i, key))
                rows, settled = [], []
                for (context, m, f), members in groups.items():
                    least = min(doc[i] for i, _ in members)
                    several = any(doc[i] != least for i, _ in members)
                    cut = first[kept[members[0][0]]] - first[kept[members[0][0]] - m]
                    before, after = context[: max(0, cut - 1)].decode(), context[cut:].decode()
                    rows.append((members[0][1], after, before, least, [place[i] for i, _ in members if doc[i] == least], None, f, m, several))
                    settled += [(doc[i], place[i] - m, m - f + 1) for i, _ in members if doc[i] != least]
                if settled:
                    owner, start, many = _united(*np.array(settled, np.int64).T)
                    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]).tolist()
                    for a, b in zip(edge, [*edge[1:], len(owner)], strict=True):
                        rows.append((None, None, None, int(owner[a]), start[a:b].tolist(), many[a:b].tolist(), 0, 0, True))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(run, _RECORD)


def _words_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins, ends): equal ids are equal words; where each record's words after its position begin, and where those before it end."""
    after, before = (pc.split_pattern(chunk.column(c).combine_chunks(), " ") for c in ("after", "before"))
    ids = pa.concat_arrays([after.values, before.values]).dictionary_encode().indices.to_numpy()
    return ids, after.offsets.to_numpy()[:-1].astype(np.int64), before.offsets.to_numpy()[1:].astype(np.int64) + len(after.values)


def _in_common(ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many first words each record has in common with the one before it."""
    table = np.full((len(count), int(count.max())), -1, np.int32)
    for j in range(table.shape[1]):
        has = count > j
        table[has, j] = ids[begin[has] + j]
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    return np.r_[0, np.where(same.all(1), table.shape[1], same.argmin(1))]


def compared(chunk: pa.Table, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(in several documents, in a lesser document too): for each record and each number of words before its position,
    up to the most, whether the window that begins there is known to stand elsewhere.

    The chunk holds all records of some heads, sorted by the words after the position.
    """
    doc, fewest, most = (chunk.column(c).to_numpy() for c in ("doc", "fewest", "most"))
    several = chunk.column("several").to_numpy()
    ids, begin, end = _words_of(chunk)
    order = np.arange(len(doc))
    letters = chunk.column("after").combine_chunks().buffers()[2]
    if (np.frombuffer(letters, np.uint8) < 32).any():  # control characters sort before the blank that ends a word
        size = min_words - fewest
        order = np.array(sorted(order, key=lambda i: ids[begin[i] : begin[i] + size[i]].tolist()))
    doc, fewest, most, several, begin, end = (x[order] for x in (doc, fewest, most, several, begin, end))
    common = _in_common(ids, begin, min_words - fewest)
    found, later = (np.zeros((len(doc), int(most.max()) + 1), bool) for _ in range(2))
    left = np.zeros(len(doc), np.int64)  # equal numbers: the same words before the position, as many as looked at
    for n in range(found.shape[1]):
        if n:
            has = most >= n
            pair = np.where(has, left * (len(ids) + 1) + ids[np.maximum(end - n, 0)] + 1, -1 - np.arange(len(doc)))
            left = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        own = np.flatnonzero((fewest <= n) & (n <= most))
        if not len(own):
            continue
        # neighbours with so many words in common, and the same words before: the same window
        key = np.cumsum(common < min_words - n)[own] * (len(doc) + 1) + left[own]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        least = np.minimum.reduceat(doc[own], edge)
        shared = (np.maximum.reduceat(doc[own], edge) != least) | np.logical_or.reduceat(several[own], edge)
        found[own, n] = np.repeat(shared, size)
        later[own, n] = doc[own] != np.repeat(least, size)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return found[back], later[back]


def _runs(doc: np.ndarray, places: pa.ListArray, found: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, many, later) of neighbouring windows of one kind at each place; column n of the tables is the window n words before a place."""
    kind = (found.astype(np.int8) + (found & later))[:, ::-1]
    edged = np.pad(kind, ((0, 0), (1, 1)))
    row, begin = np.nonzero((edged[:, 1:] != edged[:, :-1])[:, :-1] & (kind > 0))
    row_, end = np.nonzero((edged[:, 1:] != edged[:, :-1])[:, 1:] & (kind > 0))
    place, offset = places.values.to_numpy(), places.offsets.to_numpy().astype(np.int64)
    size = np.diff(offset)[row]
    run = np.repeat(np.arange(len(row)), size)
    at = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + offset[row[run]]
    start = place[at] - (kind.shape[1] - 1 - begin[run])
    return doc[row[run]], start, (end - begin + 1)[run], kind[row, begin][run] > 1


def _by_document(doc: np.ndarray, start: np.ndarray, many: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """A row (doc, runs) for each document: the unions of its runs, those of one kind apart from the other."""
    names, number = np.unique(doc, return_inverse=True)
    group, start, many = _united(2 * number.astype(np.int64) + later, start.astype(np.int64), many.astype(np.int64))
    runs_ = pa.StructArray.from_arrays([pa.array(start), pa.array(many), pa.array(group % 2 == 1)], names=["start", "many", "later"])
    offsets = np.searchsorted(group // 2, np.arange(len(names) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(offsets), runs_)], names=["doc", "runs"])


def _neighbours(records: DataFrame, min_words: int, chunk_rows: int) -> DataFrame:
    """Runs of repeated windows, by comparing the sorted records of each head, some heads at a time; a row for each document of these."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        found, later = compared(table, min_words)
        return _by_document(*_runs(table.column("doc").to_numpy(), pa.concat_arrays(table.column("places").chunks), found, later))

    def run(batches):
        held = None
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("head")))
            if known.num_rows:  # every window of theirs stands in a lesser document too
                start, many = known.column("places"), known.column("many")
                doc = np.repeat(known.column("doc").to_numpy(), np.diff(start.offsets.to_numpy()))
                yield _by_document(doc, start.flatten().to_numpy(), many.flatten().to_numpy(), np.ones(len(doc), bool))
                batch = batch.filter(pc.is_valid(batch.column("head")))
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > chunk_rows:
                head = held.column("head").to_numpy()
                edge = np.flatnonzero(head[1:] != head[:-1]) + 1
                if not len(edge):
                    break
                at = int(edge[max(0, np.searchsorted(edge, chunk_rows, "right") - 1)])
                yield settle(held.slice(0, at))
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield settle(held)

    return records.mapInArrow(run, _RUNS)


def repeated_windows(docs: DataFrame, min_words: int, chunk_rows: int = CHUNK, frequent: int = FREQUENT) -> DataFrame:
    """(doc, windows): the starts of the windows of ``min_words`` words that another document has too, as runs (start, many, later).

    later: a document of smaller id has them.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    matched, often = _matched(docs, min_words, frequent)
    records = _suffixes(docs.join(matched, "doc"), min_words, often)
    dealt = F.coalesce("head", F.xxhash64("doc"))
    ordered = records.repartition(shuffle_width(docs.sparkSession), dealt).sortWithinPartitions("head", "after")
    found = _neighbours(ordered, min_words, chunk_rows)
    return found.groupBy("doc").agg(F.flatten(F.collect_list("runs")).alias("windows"))


def _spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of the spans [begin, end), as sorted separate spans."""
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, b[1:] > e[:-1]])
    return list(zip(b[new].tolist(), e[np.r_[new[1:] - 1, len(e) - 1]].tolist(), strict=True))


def _window_runs(column: pa.Array, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(begins, ends, later) in words of each row's runs of windows; none for a null."""
    begin, many, later = (column.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "many", "later"))
    offsets = column.offsets.to_numpy()
    for i, valid in enumerate(column.is_valid().to_pylist()):
        s = slice(offsets[i], offsets[i + 1]) if valid else slice(0, 0)
        yield begin[s], begin[s] + many[s] - 1 + min_words, later[s].astype(bool)


def repeated_passages(docs: DataFrame, min_words: int = 50, chunk_rows: int = CHUNK, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_holder): the passages of at least ``min_words`` words that stand in
    several documents of ``docs(doc_id, text)``, other columns being ignored.

    Words are runs of other characters than white space, compared without regard to A-Z's case. A span is the
    longest union of such passages; first_holder tells that no part of it stands in a document with a smaller
    doc_id. Repetition within one document doesn't count, and rows that repeat a doc_id are one document whose
    spans are pooled. Null, empty and short texts, and rows with a null doc_id, have no spans; documents without
    spans have no row. Texts of any length are read whole. An empty table gives an empty table. Suffixes whose head
    stands in more than ``frequent`` places are dealt window by window, with the same result.
    """

    def run(batches):
        for batch in batches:
            out = []
            for doc, (begin, end, later) in zip(batch.column("doc").to_pylist(), _window_runs(batch.column("windows"), min_words), strict=True):
                spans, after = _spans(begin, end), np.sort(begin[later])
                for a, b in spans:
                    at = np.searchsorted(after, a)
                    out.append((doc, a, b, b - a, not (at < len(after) and after[at] < b)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_()), strict=True)], names=["doc_id", "start_word", "end_word", "n_words", "first_holder"])

    return repeated_windows(docs, min_words, chunk_rows, frequent).mapInArrow(run, "doc_id long, start_word long, end_word long, n_words long, first_holder boolean")


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with each repeated passage left in its holder of least doc_id and cut from all others.

    Text around a cut stays as it is. A document that loses all its words goes; one that had none, a null or empty
    text, stays, and so do rows with a null doc_id. Rows that repeat a doc_id each lose what any of them has to.
    n_chars, where there is such a column, is made to fit; columns of any other name are carried. An empty table
    gives an empty table.
    """
    name, cuts = fresh("doc", docs), fresh("cuts", docs)

    def cut(batches):
        for batch in batches:
            text = batch.column("text")
            out = text.to_pylist()
            runs_ = list(_window_runs(batch.column(cuts), min_words))
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                for i, (begin, end, later) in enumerate(runs_[a:b]):
                    first, last = words.first[i], words.first[i + 1]
                    begin, end = begin[later], np.minimum(end[later], last - first)
                    inside = begin < last - first
                    if not inside.any():
                        continue
                    raw, at, keep, lost = words.raw, words.offsets[i], [], 0
                    for x, y in _spans(begin[inside], end[inside]):
                        keep.append(raw[at : words.start[first + x]].tobytes())
                        at, lost = words.end[first + y - 1], lost + y - x
                    keep.append(raw[at : words.offsets[i + 1]].tobytes())
                    out[a + i] = b"".join(keep).decode() if lost < last - first else None
            gone = np.array([x is None and y for x, y in zip(out, text.is_valid().to_pylist(), strict=True)], bool)
            done = batch.drop_columns([cuts])
            done = done.set_column(done.schema.get_field_index("text"), "text", pa.array(out, text.type))
            yield done.filter(pa.array(~gone))

    windows = repeated_windows(docs, min_words)
    # only what is cut travels with the texts
    later = windows.select(F.col("doc").alias(name), F.filter("windows", lambda w: w["later"]).alias(cuts)).where(F.size(cuts) > 0)
    joined = docs.join(staged(later), docs.doc_id == F.col(name), "left").drop(name)
    cut_docs = joined.mapInArrow(cut, docs.schema)
    return cut_docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut_docs

"""Word-table BPE, vector codes and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftline.llm.importance import SEPARATOR, Checksums, _chunks, importance_resample
from siftline.llm.vector_codes import LARGEST, nearest, vector_codes
from siftline.llm.word_bpe import decode_documents, decoded, encode_documents, encoded_digests, words_of
from siftline.llm.wordkeys import Words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", "ß", "7", "42", "!?", "…", "字", "字体", " ", " ", "🙂", "<|endoftext|>", "<|endof", "\x1c", "\x85", "𐥀", "A", "Tokenizer", "  \n ", "-", "‍"]


def noise(n, seed, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, most))) for _ in range(n)]


# BPE


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(PATH)


def test_the_pattern_begins_anew_before_every_blank_after_something_else(full):
    """Each character of the plane's first part, and a stride through the rest, before and after a blank."""
    some = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    ids = lambda t: full.encode(t, add_special_tokens=False).ids
    for c in some:
        text = f"a{c} b {c}x"
        assert [i for w in words_of(text) for i in ids(w)] == ids(text), hex(ord(c))


def test_words_are_the_text_and_their_ids_are_its_ids(full):
    for text in noise(3000, 1):
        words = words_of(text)
        ids = full.encode(text, add_special_tokens=False).ids
        assert "".join(words) == text and "" not in words
        assert [i for w in words for i in full.encode(w, add_special_tokens=False).ids] == ids
        assert decoded(np.array(ids, "<u4"), PATH) == full.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("pack_bytes", [None, 3000])
def test_documents_against_the_tokenizer(spark, docs, full, pack_bytes):
    rows = [(i, t) for i, t in enumerate(noise(300, 2))] + [(1000, None), (1001, ""), (1002, "word " * 60_000), (1003, "z" * 30_000), (1004, " " * 50_000), (1, "again"), (1, "again"), (None, "no id"), (None, None)]
    table = docs(rows, extra=True).repartition(3)
    got = encoded_digests(table, PATH, pack_bytes).collect()
    want = []
    for i, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids
        text = full.decode(ids, skip_special_tokens=False)
        assert text == (t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_ids_and_texts_come_back(spark, docs, full):
    rows = [(i, t) for i, t in enumerate(noise(40, 3))]
    coded = encode_documents(docs(rows), PATH)
    for r in coded.collect():
        assert list(r["ids"]) == full.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids
    assert sorted(map(tuple, decode_documents(coded, PATH).collect())) == rows
    assert decode_documents(spark.createDataFrame([(1, None), (2, []), (3, [50256, 187])], "doc_id long, ids array<int>"), PATH).collect()[2]["text"] == full.decode([50256, 187], skip_special_tokens=False)
    assert encode_documents(docs([]), PATH).collect() == [] and encoded_digests(docs([(1, None)]), PATH).first()["n_tokens"] == 0


def test_another_order_is_an_error(spark, docs):
    def drawn(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([random.SystemRandom().random().hex() for _ in range(batch.num_rows)]))

    table = docs([(i, "") for i in range(60)])
    with pytest.raises(Exception, match="another order"):
        encoded_digests(table.mapInArrow(drawn, table.schema), PATH).collect()


# vector codes


def plain_codes(rows, rounds=4, entries=256, parts=4):
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in kept), default=0)
    width = max(1, -(-dims // parts))
    kept = [(i, label, v + [0] * (width * parts - len(v)), len(v)) for i, label, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2][: r[3]]))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in order] for p in range(parts)]

    def closest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for r in kept:
                part = r[2][p * width : (p + 1) * width]
                own.setdefault(closest(part, books[p])[1], []).append(part)
            for k, members in own.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for r in kept:
        found = [closest(r[2][p * width : (p + 1) * width], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[r[1]] = sums.get(r[1], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[1]))
    return [(i, c, e, sums[label], digest) for i, c, e, label in out]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS x", "1 AS code", "2 AS error", "3 AS n")


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_against_a_plain_version(spark, entries):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], int(i) % 3 if i % 5 else None) for i in rng.permutation(320)]
    rows += [(400, None, 1), (401, [1.0, None] * 4, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] * 8, None), (404, [0.5] * 8, 1), (404, [0.5] * 8, 1), (None, [0.25] * 8, 1), (-5, [0.1] * 8, 2), (-5, [-0.1] * 8, 2)]
    got = vector_codes(vectors(spark, rows).repartition(5), entries=entries).collect()
    assert ordered(got) == ordered(plain_codes(rows, entries=entries))


def test_codes_of_short_and_uneven_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5] * 6, None), (4, [0.5] * 6, None)]
    assert ordered(vector_codes(vectors(spark, rows)).collect()) == ordered(plain_codes(rows))
    assert vector_codes(vectors(spark, [])).collect() == [] and vector_codes(vectors(spark, [(1, None, 1)])).collect() == []
    assert [r["code"] for r in vector_codes(vectors(spark, [(1, [], None)])).collect()] == ["00000000"]
    with pytest.raises(ValueError):
        vector_codes(vectors(spark, [(1, [float(LARGEST)] * 4, 1)]))


def test_nearest_takes_the_lower_of_equal_entries():
    book = np.array([[4, 0, 4, 0]])
    best, far = nearest(np.array([[1, 2, 3, 9]]), book)
    assert best.tolist() == [1, 0, 0, 0] and far.tolist() == [1, 4, 1, 25]


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target, percent=5, least=20, buckets=10_000):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for c in features(t)[1]:
                out[c % buckets] += 1
        return out

    s, t = counts([x for _, x in rows]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def some_texts(n, seed):
    r = random.Random(seed)
    made = ["".join(r.choice("abcXYZ019éß字-") for _ in range(r.choice((1, 2, 4, 31, 32, 33, 70)) if r.random() < 0.1 else r.randint(1, 6))) for _ in range(60)]
    return ["".join(r.choice(made) + r.choice((" ", ", ", "\n\n", "; ", " ")) for _ in range(r.randint(0, 70))) for _ in range(n)]


def test_checksums_of_runs():
    texts = some_texts(50, 4) + ["", "x", "a " * 5 + "y" * 5000 + " b"]
    words = Words(pa.array(texts), SEPARATOR)
    got = [[] for _ in texts]
    for first, crc in Checksums(words).runs():
        for f, c in zip(first.tolist(), crc.tolist(), strict=True):
            got[words.row[f]].append(c)
    assert got == [features(t)[1] for t in texts]


def test_chunks_carry_two_words():
    text = "one two  three, four five six seven eight nine ten"
    parts = list(_chunks(pa.array([text, "--", ""]), 12))
    own = []
    for row, k, carry, chunk in parts:
        words = WORD.findall(chunk)
        assert row == 0 and carry == min(2, 10 - len(own) - (len(words) - carry)) and words == WORD.findall(text)[len(own) : len(own) + len(words)]
        own += words[: len(words) - carry]
    assert own == WORD.findall(text) and len(parts) > 3 and [k for _, k, _, _ in parts] == list(range(len(parts)))


@pytest.mark.parametrize("chunk_bytes", [1 << 18, 40])
def test_resampling_against_a_plain_version(spark, docs, chunk_bytes):
    rows = [(i, t) for i, t in enumerate(some_texts(150, 5))]
    rows += [(500, None), (501, ""), (502, "?!"), (503, "word " * 3000), (504, "x" * 9000), (505, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[7][1]), (None, None), (506, "A b C " * 40)]
    target = some_texts(12, 6) + [None, "", "word word " * 200]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance_resample(docs(rows, extra=True).repartition(3), table, percent=20, chunk_bytes=chunk_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4] is None, r[4] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(resampled(rows, target, 20), key=key)


def test_resampling_edges(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert importance_resample(docs([]), nothing).collect() == []
    rows = [(i, f"{i} " * 25) for i in range(40)]
    assert sorted(map(tuple, importance_resample(docs(rows), nothing).collect())) == sorted(resampled(rows, []))

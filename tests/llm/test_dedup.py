import random
import re
from collections import defaultdict

import pytest

from siftline.llm.components import components
from siftline.llm.ngram_join import jaccard_components, one_of_each
from siftline.llm.suffix_dedup import repeated_passages, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def sample(seed, n=60):
    r = random.Random(seed)
    pick = lambda k: [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) + str(r.randint(0, 400)) for _ in range(k)]
    base, rows = [pick(r.randint(60, 140)) for _ in range(6)], []
    passage = pick(55)
    for i in range(n):
        w = list(r.choice(base)) if i % 2 else pick(r.randint(0, 150))
        for _ in range(r.randint(0, 6)):
            if w:
                w[r.randrange(len(w))] = r.choice(pick(3))
        if i % 7 == 0:
            at = r.randint(0, len(w))
            w = w[:at] + passage + w[at:]
        rows.append((i * 3, (" " if i % 3 else "\n").join(x.upper() if i % 5 == 0 else x for x in w)))
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "one two"), (505, "two one")]


def linked(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_join_equals_brute_force(spark, docs, seed, k, percent):
    rows = sample(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs(rows, extra=True).repartition(5), k, percent).collect()}
    assert got == linked(rows, k, percent)


def test_join_of_a_large_near_group(spark, docs):
    """More members than a block holds, most of them linked through one document only."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 330):
        w = list(base)
        w[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_components(docs(rows), 4, 85).collect()}
    assert got == linked(rows, 4, 85)


def test_join_edges(spark, docs):
    assert jaccard_components(docs([])).collect() == []
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, "A b C d E f"), (9, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in jaccard_components(docs(rows)).collect() if r["doc_id"] is not None)
    assert got == [(False, 1, 1), (False, 1, 1), (False, 7, 1), (False, 9, 9)]
    long = [(1, "q " * 300_000), (2, "q " * 300_000 + "r"), (3, "z" * 3_000_000)]
    assert [r["component_id"] for r in jaccard_components(docs(long)).orderBy("doc_id").collect()] == [1, 2, 3]


def test_rows_that_repeat_an_id_lose_no_link(spark, docs):
    word = lambda s, n: " ".join(f"{s}{j}" for j in range(n))
    a, b = word("a", 60), word("b", 60)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (5, word("c", 40)), (5, word("d", 40)), (4, word("d", 40)), (9, word("c", 40) + " y"), (7, word("e", 9))]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_components(docs(rows).repartition(3)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (7, 7), (9, 4)]
    assert sorted({r["doc_id"] for r in one_of_each(docs(rows)).collect()}) == [1, 4, 7]


@pytest.mark.parametrize("fragments", [64, 3750, 125_000])
def test_rows_of_packed_keys_are_proportional_to_keys(fragments):
    """However many fragments there are, each step gives at most a row for each key, or for each fragment that occurs."""
    import numpy as np

    from siftline.llm.sharedkeys import cut_rows, finding_rows, packed_rows

    r = np.random.default_rng(1)
    owner, key = r.integers(0, 900, 40_000), r.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    rows = packed_rows(owner, key, fragments, 3)
    assert len(rows) <= min(fragments, 40_000) + 1 and sum(len(x[5]) for x in rows) == 40_000
    names = ("fragment", "run", "owners", "counts", "keys", "several")
    direct = packed_rows(owner, key, fragments, 3, 7)
    assert len(direct) <= min(7 * fragments, 40_000) + 1 and sum(len(x[5]) for x in direct) == 40_000
    again = cut_rows([dict(zip(names, x, strict=True)) for x in rows], fragments)
    assert len(again) <= min(fragments, 40_000) and sum(len(x[5]) for x in again) == 40_000
    assert len(finding_rows(np.arange(900), np.ones(900, np.int64), fragments)) <= min(fragments, 900)


@pytest.mark.parametrize(("run_bytes", "most"), [(1 << 23, 1 << 21), (300, 1 << 21), (300, 100)])
def test_shared_counts_equal_brute_force(spark, docs, monkeypatch, run_bytes, most):
    """The fragment as one run, and as many, which packs are cut to at once or later."""
    import numpy as np

    from siftline.llm import sharedkeys
    from siftline.llm.sharedkeys import shared_counts
    from siftline.llm.wordkeys import Words

    monkeypatch.setattr(sharedkeys, "MOST_KEYS", most)
    rows = sample(4)

    def keys_of(batch):
        words = Words(batch.column("text"))
        at = np.unique(np.stack([batch.column("doc_id").to_numpy()[words.row], words.hashes().view(np.int64)]), axis=1)
        yield at[0], at[1].view(np.uint64)

    holders = defaultdict(set)
    for i, t in rows:
        for w in words(t):
            holders[w].add(i)
    want = {i: n for i, t in rows if (n := sum(len(holders[w]) > 1 for w in set(words(t))))}
    got = {r["owner"]: r["n"] for r in shared_counts(docs(rows).select("doc_id", "text").repartition(3), keys_of, run_bytes=run_bytes).collect()}
    assert got == want


def test_one_of_each(spark, docs):
    rows = sample(2)
    table = docs(rows, extra=True)
    got = one_of_each(table)
    assert got.columns == table.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, c in linked(rows, 5, 80).values()})
    assert one_of_each(docs([])).count() == 0
    assert one_of_each(docs([(None, "a"), (None, None)])).count() == 2


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked_nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x in linked_nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def spans(rows, least):
    where, texts = defaultdict(set), {}
    for i, t in rows:
        texts[i] = w = words(t)
        for s in range(len(w) - least + 1):
            where[tuple(w[s : s + least])].add(i)
    out = set()
    for i, w in texts.items():
        found = []
        for s in range(len(w) - least + 1):
            if len(where[tuple(w[s : s + least])]) > 1:
                first = min(where[tuple(w[s : s + least])]) == i
                if found and s <= found[-1][1]:
                    found[-1] = (found[-1][0], s + least, found[-1][2] and first)
                else:
                    found.append((s, s + least, first))
        out |= {(i, *x) for x in found}
    return out


@pytest.mark.parametrize(("seed", "least", "chunk", "frequent"), [(1, 50, 1 << 15, 1 << 11), (2, 20, 40, 10), (4, 9, 5, 5), (6, 90, 1 << 15, 1), (3, 16, 1, 1 << 11)])
def test_passages_equal_brute_force(spark, docs, seed, least, chunk, frequent):
    """Small chunks make heads come to an end inside a batch; frequent heads are looked up by their windows."""
    rows = sample(seed)
    got = repeated_passages(docs(rows, extra=True).repartition(4), least, chunk, frequent).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["first_holder"]) for r in got} == spans(rows, least)


def test_passages_with_control_characters_and_one_common_head(spark, docs):
    """Words that begin with characters below the blank; hundreds of documents that share sixteen words and differ around them."""
    r = random.Random(3)
    head = [f"h{i}" for i in range(16)]
    rows = []
    for i in range(120):
        w = [f"{r.choice('ab')}{r.randrange(4)}" for _ in range(12)]
        rows.append((i, " ".join([*w[:6], *head, r.choice(["x", "x\x01", "\x02"]), *w[6:]])))
    for chunk, frequent in ((1 << 15, 1 << 11), (7, 7)):
        got = repeated_passages(docs(rows), 20, chunk, frequent).collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"], r["first_holder"]) for r in got} == spans(rows, 20)


def test_only_equal_words_match():
    """Records under one head whose hashes agree: only those match whose words do."""
    import pyarrow as pa

    from siftline.llm.suffix_dedup import compared

    after = ["a b c d", "a b c e", "a b c e", "a b x"]
    chunk = pa.table({"head": [7] * 4, "after": after, "before": ["u v", "u v", "w v", "u v"], "doc": [3, 1, 2, 4], "place": [9] * 4, "fewest": [1, 1, 1, 2], "most": [2] * 4, "several": [False] * 4})
    found, later = compared(chunk, 5)
    assert found.tolist() == [[False, False, True], [False, True, True], [False, True, False], [False, False, False]]
    assert later.tolist() == [[False, False, True], [False, False, False], [False, True, False], [False, False, False]]


def without(rows, least):
    """Each text's words that no window with a holder of smaller id covers."""
    least_holder, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for s in range(len(w) - least + 1):
            least_holder.setdefault(tuple(w[s : s + least]), i)
    for i, t in rows:
        w = words(t)
        gone = {j for s in range(len(w) - least + 1) if least_holder[tuple(w[s : s + least])] != i for j in range(s, s + least)}
        out[i] = [x for j, x in enumerate(w) if j not in gone]
    return out


@pytest.mark.parametrize("seed", [1, 6])
def test_cut_passages(spark, docs, seed):
    rows = sample(seed)
    table = docs(rows, extra=True)
    kept = without_repeats(table)
    assert kept.columns == table.columns
    after = {r["doc_id"]: r for r in kept.collect()}
    want = without(rows, 50)
    assert {i: words(r["text"]) for i, r in after.items()} == {i: w for i, w in want.items() if w or not words(dict(rows)[i])}
    for i, t in rows:
        if i in after and want[i] == words(t):
            assert after[i]["text"] == t
        if i in after and after[i]["text"] is not None:
            assert after[i]["n_chars"] == len(after[i]["text"])
    assert after[500]["text"] is None and after[501]["text"] == ""


def test_passage_edges(spark, docs):
    assert repeated_passages(docs([])).collect() == [] and without_repeats(docs([])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    twice = docs([(1, text), (1, text), (None, text), (3, text + " " + text)])
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(twice).collect()}
    assert got == {(1, 0, 60), (3, 0, 120)} or got == {(1, 0, 60), (3, 0, 60), (3, 60, 120)}
    assert repeated_passages(docs([(1, text + " x " + text), (2, "other")])).count() == 0
    left = without_repeats(docs([(1, text), (2, text), (3, "a " + text + " é")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"].split()[0], len(r["text"].split())) for r in left] == [(1, "w0", 60), (3, "a", 2)]
    long = "x y " * 200_000
    assert repeated_passages(docs([(1, long), (2, long)])).count() == 2


@pytest.mark.parametrize("frequent", [2048, 5])
def test_rows_of_passages_follow_documents_not_places(spark, docs, frequent):
    """Documents that repeat one phrase give a row for each of its windows in one of them, not for each place in all."""
    from pyspark.sql import functions as F

    from siftline.llm.suffix_dedup import _matched, _neighbours, _suffixes

    phrase = " ".join(f"w{i}" for i in range(10))
    rows = [(i, f"a{i} " + f"{phrase} " * 200 + f"b{i}") for i in range(12)]
    table = docs(rows).select(F.col("doc_id").alias("doc"), "text").coalesce(1)
    matched, often = _matched(table, 20, frequent)
    records = _suffixes(table.join(matched, "doc").coalesce(1), 20, often).cache()
    found = _neighbours(records.repartition(3, F.coalesce("head", F.xxhash64("doc"))).sortWithinPartitions("head", "after"), 20, 1000)
    assert records.count() <= 60 and found.count() <= 3 * 12
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["first_holder"]) for r in repeated_passages(docs(rows), 20, 1000, frequent).collect()}
    assert got == {(i, 1, 2001, i == 0) for i in range(12)}

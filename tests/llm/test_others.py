import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm.fingerprints import GRAM, WINDOW, edited_fingerprints, fingerprints
from siftline.llm.html_text import extract_text, visible_text
from siftline.llm.mixing import mix, mixed_documents
from siftline.llm.packing import cutting_stock, pack_documents, placement, token_ids
from siftline.llm.topk import Lists, top_inner_products
from siftline.llm.url_filter import filter_urls, host_of, validity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(n, seed=1, most=80):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, most))) for _ in range(n)]


# fingerprints


def test_edited_texts(spark, docs):
    rows = [(i * 7, t) for i, t in enumerate(texts(60))] + [(9000, None), (9001, ""), (9002, "x" * 400_000), (9003, "é"), (9004, texts(1)[0])]
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(rows, extra=True).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[9004]["fingerprint"] == got[0]["fingerprint"] and got[9000]["fingerprint"] == got[9001]["fingerprint"] == ""


def test_edited_edges(spark, docs):
    assert edited_fingerprints(docs([])).collect() == []
    one = edited_fingerprints(docs([(5, "a b c d e f g h")])).first()
    assert one["near_next"] == 1.0
    same = edited_fingerprints(docs([(1, "a b"), (1, "a b"), (None, "c d"), (None, "e")])).collect()
    assert len(same) == 4


def test_winnowing_picks_rightmost_minima_and_keeps_its_guarantee(spark, docs):
    shared = texts(1, 9, 60)[0].split()[:GRAM + WINDOW - 1]
    rows = [(i, t) for i, t in enumerate(texts(30, 2))] + [(100, "p q r " + " ".join(shared) + " s t"), (101, "u " + " ".join(shared))]
    got = {r["doc_id"]: r for r in fingerprints(docs(rows)).collect()}
    assert len(shared) < GRAM + WINDOW - 1 or set(got[100]["hashes"]) & set(got[101]["hashes"])
    for i, t in rows:
        places = [(1 << 28) - 1 - (x & (1 << 28) - 1) for x in got[i]["fingerprint"]]
        grams = max(1, len(t.split()) - GRAM + 1) if t else 0
        assert places == sorted(places) and len(set(places)) == len(places)
        if grams > WINDOW:
            assert places[0] < WINDOW and all(b - a <= WINDOW for a, b in zip(places, places[1:], strict=False)) and places[-1] >= grams - WINDOW
    ties = fingerprints(docs([(1, "a a a a a a a a a a a a a a")])).first()["fingerprint"]
    assert [(1 << 28) - 1 - (x & (1 << 28) - 1) for x in ties] == list(range(WINDOW - 1, 11))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def winnowed(text):
    """The kept (position, hash) of a text, from the definition alone."""
    import re

    import xxhash

    pieces = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        pieces += [w[i : i + 16] for i in range(len(w) - 15)] if len(w) > 16 else [w]
    prime, base = 2**35 - 31, 8191
    h = [signed(xxhash.xxh64_intdigest(p.encode(), 42)) % prime for p in pieces]
    if len(h) >= GRAM:
        grams = [sum(x * base ** (GRAM - 1 - j) for j, x in enumerate(h[i : i + GRAM])) % prime for i in range(len(h) - GRAM + 1)]
    else:
        grams = None  # fewer words than a gram: one value, whichever
    if grams is None:
        return None if h else []
    windows = [range(i, i + WINDOW) for i in range(len(grams) - WINDOW + 1)] or [range(len(grams))]
    return sorted({max(((-grams[p], p) for p in w))[1] for w in windows}), grams


def test_fingerprints_by_definition(spark, docs):
    """Every kept position and hash, and both likenesses, against a plain version."""
    r = random.Random(12)
    rows = [(i, t) for i, t in enumerate(texts(50, 13, 70))] + [(60, " ".join(r.choice("ab") for _ in range(60))), (61, "x" * 40 + " é" * 9), (62, "a b c d"), (63, "".join(r.choice("一是不了") for _ in range(60)))]
    got = {x["doc_id"]: x for x in fingerprints(docs(rows)).collect()}
    last = (1 << 28) - 1
    for i, t in rows:
        want = winnowed(t)
        if want:
            assert [(last - (x & last), x >> 28) for x in got[i]["fingerprint"]] == [(p, want[1][p]) for p in want[0]]
    edited = {x["doc_id"]: x for x in edited_fingerprints(docs(rows).repartition(3)).collect()}
    of = lambda t: None if winnowed(t) is None else {winnowed(t)[1][p] for p in winnowed(t)[0]} if winnowed(t) else set()
    order, checked = sorted(rows, key=lambda x: -x[0]), 0
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        a, b, c = of(t), of(t[: len(t) - half] + following[:half]), of(following)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        if None not in (a, b, c):
            checked += 1
            assert edited[i]["near_edited"] == pytest.approx(like(a, b)) and edited[i]["near_next"] == pytest.approx(like(a, c))
    assert checked > 30


def test_edited_texts_among_null_and_repeated_ids(spark, docs):
    """A third of the rows without an id: they are dealt to groups of their own, and every row has one next."""
    rows = [(i, t) for i, t in enumerate(texts(40, 17))] + [(None, t) for t in texts(60, 18)] + [(7, t) for t in texts(20, 19)]
    got = edited_fingerprints(docs(rows, extra=True).repartition(5)).collect()
    assert len(got) == len(rows) and sorted(r["n_chars"] for r in got) == sorted(len(t) for _, t in rows)


def test_a_shift_in_an_unspaced_text_keeps_its_fingerprints(spark, docs):
    r = random.Random(4)
    text = "".join(r.choice("的一是不了人我在有他这中大来上😀") for _ in range(800))
    shared = text[300:326]
    rows = [(1, text), (2, "x" + text), (3, text[:400] + "y" + text[400:]), (4, "a" * 21 + shared + "b" * 40), (5, "p" * 34 + shared + "q" * 40)]
    got = {r["doc_id"]: set(r["hashes"]) for r in fingerprints(docs(rows)).collect()}
    like = lambda a, b: len(got[a] & got[b]) / len(got[a] | got[b])
    assert like(1, 2) > 0.9 and like(1, 3) > 0.8 and got[4] & got[5]


# mixing


def test_mix_meets_targets(spark, docs):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts(200, 3), ["b"] * 120 + ["a"] * 5 + [None] * 30 + ["é"] * 45, strict=True))] + [(900, None, "a"), (901, "", "z"), (901, "", "z")]
    got = mix(docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    targets, taken, sums = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        targets[s], sums[s] = r["target"], r["source_size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    weight = dict(zip(["a", "b", "z", "é", None], [3, 1, 2, 3, 1], strict=True))
    total, free, want = 1.5 * sum(size.values()), set(sums), {}
    while True:  # targets by the rule itself: share, cap, share the excess again
        share = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sums[s]}
        if not over:
            break
        want |= {s: 2.0 * sums[s] for s in over}
        free -= over
    want |= {s: share * weight[s] for s in free}
    for s in sums:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) < len(sums)
    assert sum(taken.values()) == 3 * sum(size.values()) // 2
    again = mix(docs(rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_edges(spark, docs):
    assert mix(docs([])).collect() == [] and mixed_documents(docs([])).collect() == []
    assert [(r["size"], r["taken"]) for r in mix(docs([(1, None, "a"), (None, "", None)])).collect()] == [(0, 0), (0, 0)]
    only = mix(docs([(1, "a b c d", "s"), (1, "a b c d", "s")])).collect()
    assert sum(r["taken"] for r in only) == 12


def test_mixed_documents_are_served_in_proportion(spark, docs):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(200)] + [(7, "w " * 10, "b")]
    table = docs(rows, extra=True)
    got = mixed_documents(table)
    assert got.columns == table.columns
    served = [r["source"] for r in got.collect()]
    want = {s: 0 for s in "ab"}
    for r in mix(table).collect():
        want["ab"[r["doc_id"] % 2]] += r["taken"]
    for s in "ab":
        assert abs(10 * served.count(s) - want[s]) <= 10
        assert abs(served[: len(served) // 2].count(s) / served.count(s) - 0.5) < 0.05


# packing


def test_pack_round_trip(spark, docs):
    rows = [(i, t) for i, t in enumerate(texts(150, 5, 900))] + [(900, None), (901, ""), (902, "naïve 漢字 <|endoftext|> ok"), (903, "a" * 50_000), (904, "b c"), (904, "b c")]
    got = pack_documents(docs(rows, extra=True).repartition(4)).collect()
    full = Tokenizer.from_file(PATH)
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in rows[:-2]:
        ids = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(by[904]) == 2
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    used = sum(r["length"] for r in got)
    assert len(sequences) - used / 1024 < 2
    assert pack_documents(docs([])).collect() == []


def test_both_tokenizer_libraries_agree():
    r = random.Random(8)
    full = Tokenizer.from_file(PATH)
    for _ in range(400):
        t = "".join(chr(r.choice([*range(32, 127), *range(9, 14), *range(0x80, 0x250), 0, 27, 0x2019, 0x2028])) for _ in range(60)) + "  \n x's 12é"
        assert token_ids(t, PATH) == full.encode(t, add_special_tokens=False).ids


def test_cutting_stock_holds_the_demand():
    r = np.random.default_rng(2)
    for lengths in ([1], [7, 512, 1000], sorted({int(x) for x in r.integers(1, 1024, 60)})):
        lengths = np.array(lengths)
        demand = r.integers(1, 300, len(lengths))
        plan = cutting_stock(lengths, demand, 1024)
        assert (sum(c * n for c, n in plan) == demand).all() and all((c * lengths).sum() <= 1024 for c, _ in plan)
    lengths, demand = np.array([3, 424, 600]), np.array([10, 4, 4])
    where = placement(lengths, cutting_stock(lengths, demand, 1024))
    assert sum(len(v) for v in where.values()) >= 3 and placement(np.zeros(0, np.int64), []) == {}


def test_column_generation_comes_near_the_bound():
    """All lengths from 1 to 1023: sequences in use against all ids over the capacity."""
    r = np.random.default_rng(5)
    lengths = np.arange(1, 1024)
    for demand in (r.integers(20, 60, 1023), (6000 / (1 + lengths / 60)).astype(int)):
        plan = cutting_stock(lengths, demand, 1024)
        assert (sum(c * n for c, n in plan) == demand).all()
        assert sum(n for _, n in plan) <= 1.01 * (lengths @ demand) / 1024 + 1


def test_small_instances_are_packed_as_well_as_by_search():
    """The linear program's value is at most the best whole packing, found by trying all; rounding adds few sequences."""
    r = np.random.default_rng(9)

    def least(items, capacity):
        best = [len(items)]

        def fill(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= items[k] and rooms[i] not in rooms[:i]:
                    fill(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
            fill(k + 1, [*rooms, capacity - items[k]])

        fill(0, [])
        return best[0]

    for _ in range(25):
        items = sorted(r.integers(1, 40, 9).tolist(), reverse=True)
        lengths, demand = np.unique(items, return_counts=True)
        got = sum(n for _, n in cutting_stock(lengths, demand, 40))
        assert least(items, 40) <= got <= least(items, 40) + 1


def test_lengths_that_do_not_go_together_are_cut(spark, docs):
    rows = [(i, "a b c d " * 175) for i in range(40)]
    got = pack_documents(docs(rows)).collect()
    used, sequences = sum(r["length"] for r in got), len({r["sequence_id"] for r in got})
    assert len(got) > 40 and sequences - used / 1024 < 2


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\x1c", "\x1f", " \n"])
def test_long_white_space_is_read(blank):
    for t in (blank * 1_000_000, "a" + blank * 1_000_000 + "b"):
        assert token_ids(t, PATH) == Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids


# exact top-k


def brute(vectors, k=5):
    import math

    rows = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows[i] = [math.floor(256 * x) for x in v]
    out = set()
    for q in (i for i in rows if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(rows[q], rows[c], strict=False)), c) for c in rows if c != q)[:k]
        out |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    return out


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, 8)]) for i in range(600)] + [(i, [0.5] * 8) for i in range(600, 640)]
    rows += [(700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (800, [0.25, 0.5]), (801, [])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {tuple(x) for x in top_inner_products(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(rows)
    assert {tuple(x) for x in top_inner_products(table.union(table), F.col("vec_id") % 50 == 0).collect()} == got


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    ask = F.col("vec_id") % 50 == 0
    assert top_inner_products(spark.createDataFrame([], schema), ask).collect() == []
    assert top_inner_products(spark.createDataFrame([(1, [1.0], 0)], schema), ask).collect() == []
    few = spark.createDataFrame([(50, [1.0], 0), (1, [2.0], 0), (2, [-1.0], 0)], schema)
    assert [tuple(r) for r in top_inner_products(few, ask).orderBy("rank").collect()] == [(50, 1, 1, 131072), (50, 2, 2, -65536)]


@pytest.mark.parametrize(("dims", "share"), [(3, 0.5), (64, 0.9)])
def test_lists_stop_early_and_lose_nothing(dims, share):
    """Unit vectors in 64 dimensions, like embeddings: with a floor well under all entries are read."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, dims))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    lists, queries = Lists(x), x[:12]
    theta, depth = lists.depths(queries)
    for i, q in enumerate(queries):
        score = x @ q
        score[i] = -np.inf
        for floor in (-np.inf, np.sort(score[:1500])[-5]):
            lists.entries = 0
            found = lists.search(q, theta[i], depth[i], floor, 5, np.array([i]))
            assert set(np.argsort(-score, kind="stable")[:5]) <= set(found) | set(np.flatnonzero(score == np.sort(score)[-5])) and i not in found
        assert lists.entries < share * x.size


def test_short_batches_make_long_lists(monkeypatch):
    """Lists are made over a block of candidates, whatever the size of Spark's batches; results are as by brute force."""
    from siftline.llm import topk

    built = []
    monkeypatch.setattr(topk, "Lists", lambda x: built.append(len(x)) or Lists(x))
    monkeypatch.setattr(topk, "BLOCK", 400 * 8)

    class Table:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    r = np.random.default_rng(6)
    x, ids = r.integers(-200, 200, (1000, 8)).astype(float), np.arange(0, 1000, 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 30)[: 1000 - i]), pa.array(x[i : i + 30].tolist())], names=["vec_id", "x"]) for i in range(0, 1000, 30)]
    got = [b.to_pydict() for b in topk._top_of_chunk(Table(), ids, x[ids], np.full(len(ids), -np.inf), 5)(iter(batches))]
    assert built == [400, 400, 200]
    want = {(q, c, int(x[q] @ x[c])) for q in ids.tolist() for c in sorted((c for c in range(1000) if c != q), key=lambda c: (-(x[q] @ x[c]), c))[:5]}
    assert {(q, c, s) for b in got for q, c, s in zip(b["query_id"], b["vec_id"], b["score"], strict=True)} == want


def test_scores_beyond_doubles_are_exact(spark):
    """Products of over 2**53, and two different vectors under the query's own id."""
    big = [1.0e6 + 1 / 256, 1.0, 2.0]
    rows = [(0, big), (0, [1.5e6, 0.0, 0.0]), (1, big), (2, [1.0e6, 5.0, 0.0]), (3, [-1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = top_inner_products(table, F.col("vec_id") == 0).collect()
    scaled = [[int(256 * c // 1) for c in v] for _, v in rows]
    want = {s for q in (0, 1) for s in [sum(a * b for a, b in zip(scaled[q], scaled[c], strict=True)) for c in (2, 3, 4)]}
    assert {r["score"] for r in got} == want and max(want) > 2**53 and {r["vec_id"] for r in got} == {1, 2, 3}


# HTML


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>w", "- x\n- y\n  - z\n\nw"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>name<th>n<tr><td>long one<td>7</table>", "name     | n\nlong one | 7"),
        ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na | b"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f<tr><td>g<td>h</table>", "a | b    | c\nd |   |  | e\nf\ng | h"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
        ("<ol reversed><li>a<li>b<li>c</ol><ol reversed start=9><li>x<li>y</ol>", "3. a\n2. b\n1. c\n\n9. x\n8. y"),
        ("<table>stray<tr><td>a<br>b<td>c</table>", "stray\na | c\nb |"),
        ("<style>p{}</style><script>var a='</p>'</script><p hidden>no</p><p style='display: none'>no</p><b>yes", "yes"),
        ("<title>t</title><body>a<!-- x --> b<br>c", "a b\nc"),
        ("<pre>\n a\n  b</pre>", "a\n  b"),
        ("a <b> b</b>  c\n\nd", "a b c d"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<img alt='pic'><input type=hidden value=h><textarea>&lt;k</textarea>", "pic<k"),
        ("x < y and <unclosed", "x < y and "),
        ("</p></div>a</b>", "a"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<h1>T</h1>text<hr>more", "T\n\ntext\n\n----\n\nmore"),
        ("a <svg><title>t</title><text>Label</text></svg> <math>x=3</math> b", "a Label x=3 b"),
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no<hr></div>z", "yes\n\nz"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "| yes"),
        ("<a href='x>y' title=\"q\">z</a>", "z"),
        ('<a href="x>text</a> b', "text b"),
    ],
)
def test_rendering(source, want):
    assert visible_text(source).strip() == want.strip()


def page(r):
    """(html, text) of random blocks, the text worked out from the blocks themselves."""
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 7)))
    words = lambda most: [word() for _ in range(r.randint(1, most))]
    noise = lambda: r.choice(["", " ", "\n  ", "<!-- no -->", "<script>x<y</script>", "<span hidden>no</span>", "<i style='display:none'>no</i>"])
    wrapped = lambda ws: r.choice([" ", "\n", "  "]).join(r.choice([w, f"<b>{w}</b>", f"<a href='x>y'>{w}</a>"]) for w in ws)
    maybe = lambda tag: r.choice([tag, ""])
    source, blocks = [], []
    for _ in range(r.randint(1, 6)):
        kind = r.choice(["p", "div", "ul", "ol", "table"])
        if kind in ("p", "div"):
            ws = words(6)
            source.append(f"<{kind}>{noise()}{wrapped(ws)}" + ("</div>" if kind == "div" else maybe("</p>")))
            blocks.append((kind == "p", [" ".join(ws)]))
        elif kind in ("ul", "ol"):
            items = [words(3) for _ in range(r.randint(1, 4))]
            source.append(f"<{kind}>{noise()}" + "".join(f"<li>{wrapped(ws)}{maybe('</li>')}{noise()}" for ws in items) + f"</{kind}>")
            blocks.append((True, [(f"{n}. " if kind == "ol" else "- ") + " ".join(ws) for n, ws in enumerate(items, 1)]))
        else:
            rows = [[words(2) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 4))]
            source.append(f"<table>{noise()}" + "".join("<tr>" + "".join(f"<td>{wrapped(ws)}{maybe('</td>')}" for ws in row) + maybe("</tr>") for row in rows) + "</table>")
            cells = [[" ".join(ws) for ws in row] for row in rows]
            wide = [max(len(row[c]) for row in cells if c < len(row)) for c in range(max(map(len, cells)))]
            blocks.append((True, [" | ".join(x.ljust(wide[c]) for c, x in enumerate(row)).rstrip() for row in cells]))
        source.append(noise())
    text = "\n".join(blocks[0][1])
    for (a, _), (b, lines) in zip(blocks, blocks[1:], strict=False):
        text += ("\n\n" if a or b else "\n") + "\n".join(lines)
    return "".join(source), text


def test_rendering_against_a_plain_renderer():
    r = random.Random(21)
    for _ in range(300):
        source, want = page(r)
        assert visible_text(source) == want, source


@pytest.mark.parametrize(
    "source",
    ["<a " * 16_000, "<div>" * 16_000 + "</x>" * 16_000, "<b><table><td>" + "<div>" * 16_000 + "</b>" * 16_000, '<a b="' * 16_000, "<a b='\"" * 9000 + ">x", "<p>" * 16_000 + "</p>" * 16_000, "</" * 50_000, "<![" * 50_000, "<h1><div>" * 9000],
)
def test_broken_pages_are_read_in_linear_time(source):
    import time

    begin = time.perf_counter()
    visible_text(source)
    assert time.perf_counter() - begin < 5


def test_unlike_tables_lose_no_text_and_add_few_blanks():
    tall = "<table>" + "".join(f"<tr><td>{'x' * 8000 if i == 0 else 'a'}<td>b{i}" for i in range(3000)) + "</table>"
    wide = "<table><tr>" + "".join(f"<td>c{i}" for i in range(900)) + "<td>" + "<br>".join("y" for _ in range(900)) + "<tr><td>" + "z" * 900 + "</table>"
    for source, parts in ((tall, [f"b{i}" for i in range(3000)]), (wide, [f"c{i}" for i in range(900)])):
        text = visible_text(source)
        assert len(text) < 10 * len(source) and set(parts) <= set(text.replace("|", " ").split())


def test_pages(spark):
    deep = "<div>" * 5000 + "x" + "<table><tr><td>" * 60 + "y"
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (3, "v", ""), (4, "w", deep), (5, "w", "<p>word " * 50_000)]
    got = extract_text(spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[1] == "a" and by[2] == by[3] == "" and "x" in by[4] and "y" in by[4] and got.count() == 6 and by[5].count("word") == 50_000
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


# URL filters

ENTRIES = [("domain", "b.com", "block", 10), ("domain", "b.com", "remove", 20), ("domain", "B.com/", "block", 30), ("host", "ok.b.com", "allow", 12), ("prefix", "b.com/x/y", "watch", 5), ("domain", "c.d.e", "block", 0), (None, "z", "block", 1)]


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame(ENTRIES, "kind string, pattern string, action string, listed_at int")
    urls = ["http://b.com/", "https://u:p@WWW.b.com:8/q?x#y", "http://ok.b.com/x", "http://b.com/X/Y/z", "http://notb.com", "junk", None, "http://c.d.e./", "http://d.e"]
    rows = [(i, u, t) for i, u in enumerate(urls) for t in (1, 10, 15, 20, 29, 30, None)] + [(0, urls[0], 15)]
    got = filter_urls(spark.createDataFrame(rows, "capture_id long, url string, fetched_at int"), entries).collect()
    assert len(got) == len(rows)

    def held(pattern, t):
        last = max(((d, a) for k, p, a, d in ENTRIES if k and f"{k}:{p.lower().rstrip('/')}" == pattern and t is not None and d <= t), default=None)
        return last[1] if last and last[1] != "remove" else None

    for r in got:
        host = (r["url"] or "").lower().partition("://")[2].split("/")[0].split("@")[-1].split(":")[0].rstrip(".") if "://" in (r["url"] or "") else ""
        path = [p for p in (r["url"] or "").lower().partition("://")[2].split("#")[0].split("?")[0].split("/")[1:] if p]
        labels = host.split(".")
        keys = [f"domain:{'.'.join(labels[-n:])}" for n in range(1, len(labels) + 1)] + [f"host:{host}"] + [f"prefix:{host}/{'/'.join(path[:n])}" for n in range(1, len(path) + 1)]
        active = [(k, held(k, r["fetched_at"])) for k in keys if host and held(k, r["fetched_at"])]
        assert (r["host"], r["n_active"]) == (host, len(active))
        assert (r["pattern"], r["action"]) == (active[-1] if active else (None, "allow"))
    assert filter_urls(spark.createDataFrame(rows, "capture_id long, url string, fetched_at int"), entries.limit(0)).where("action = 'allow'").count() == len(rows)
    assert filter_urls(spark.createDataFrame([], "capture_id long, url string, fetched_at int"), entries).collect() == []
    assert validity(entries).count() == 5


def test_hosts(spark):
    urls = {"HTTP://A.b:80/c": "a.b", "ftp://u@h/": "h", "//x": "", "http://[::1]/": "[::1]", "https://u:p@[2001:DB8::2]:8080/x?y": "[2001:db8::2]", "http://[::1": ""}
    got = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", host_of(F.col("u")).alias("h")).collect()}
    assert got == urls


@pytest.mark.parametrize("most", [200_000, 10])
def test_a_large_list_joins_alike_whether_sent_or_shuffled(spark, monkeypatch, most):
    """Thousands of entries and a host that holds a third of the captures, against a lookup in plain Python."""
    import siftline.llm.url_filter as module

    monkeypatch.setattr(module, "BROADCAST_ENTRIES", most)
    r = random.Random(4)
    hosts = ["hot.example.com"] * 40 + [f"h{i}.{r.choice('abc')}.example.com" for i in range(60)] + ["[2001:db8::1]", "[2001:db8::2]", "10.0.0.1"]
    entries = {("domain", r.choice(["example.com", "[2001:db8::1]", *(f"{c}.example.com" for c in "abc"), *hosts]), r.choice(["block", "allow", "watch", "remove"]), r.randrange(300)) for _ in range(900)}
    entries |= {("prefix", f"{r.choice(hosts)}/{'/'.join(r.choice('xyz') for _ in range(r.randint(1, 11)))}", r.choice(["block", "remove"]), r.randrange(300)) for _ in range(2500)}
    entries = sorted({(k, p, d): (k, p, a, d) for k, p, a, d in entries}.values())
    rows = [(i, f"http://{r.choice(hosts)}/{'/'.join(r.choice('xyz') for _ in range(r.randint(0, 12)))}", r.randrange(320)) for i in range(600)]
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, listed_at int")
    captures = spark.createDataFrame([(*c, "x", "y") for c in rows], "capture_id long, url string, fetched_at int, pattern string, host string")
    got = {x["capture_id"]: (x["n_active"], x["pattern"], x["action"]) for x in filter_urls(captures, listed).collect()}
    dated = {}
    for k, p, a, d in entries:
        dated.setdefault(f"{k}:{p}", []).append((d, a))
    for i, url, t in rows:
        host, _, path = url[7:].partition("/")
        labels, parts = [host] if host[0] == "[" else host.split("."), [x for x in path.split("/") if x]
        keys = [f"domain:{'.'.join(labels[-n:])}" for n in range(1, len(labels) + 1)] + [f"host:{host}"] + [f"prefix:{host}/{'/'.join(parts[:n])}" for n in range(1, len(parts) + 1)]
        active = [(k, a) for k in keys for d, a in [max(((d, a) for d, a in dated.get(k, []) if d <= t), default=(0, "remove"))] if a != "remove"]
        assert got[i] == ((len(active), *active[-1]) if active else (0, None, "allow"))


def test_the_query_and_its_sql_agree_on_deep_pages(spark, tmp_path):
    import duckdb

    from siftline.llm.queries import QUERIES, URL_SQL

    deep = "a.b.c.d.e.f.g.h.i"
    urls = [f"http://{deep}.{h}/{'/'.join('en' for _ in range(n))}" for h in ("spam-farm.example.org", "ads-track.example.org", "free-bets.example.com", "x.com") for n in (0, 1, 9)]
    urls += [f"https://ads-track.example.org/{'/'.join(['en', *'abcdefgh'])}", "https://ADS-track.example.org/EN/x", "http://m.free-bets.example.com/"]
    pages = [(i * 31 + k, u, "") for i in range(13) for k, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op10_url_filters"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.sql(URL_SQL)
        names = want.columns
        assert sorted(tuple(str(r[c]) for c in names) for r in got) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_url_filter_of_deep_entries(spark):
    host, path = ".".join("abcdefghij") + ".com", "/".join("klmnopqrstu")
    long = ".".join("x" for _ in range(120)) + ".org"
    entries = [("domain", host, "block"), ("prefix", f"{host}/{path}", "allow"), ("domain", long, "watch"), ("host", long, "block")]
    entries = spark.createDataFrame([(*e, 1) for e in entries], "kind string, pattern string, action string, listed_at int")
    urls = [f"http://w.{host}/", f"http://{host}/{path}/v", f"http://{host}/k", f"http://{host[2:]}/{path}", f"http://{long}/"]
    rows = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at int")
    told = lambda listed: [(r["n_active"], r["action"]) for r in filter_urls(rows, listed).orderBy("capture_id").collect()]
    assert told(entries) == [(1, "block"), (2, "allow"), (1, "block"), (0, "allow"), (2, "block")]
    assert told(entries.where("kind = 'host'")) == [(0, "allow")] * 4 + [(1, "block")]


def test_an_address_is_one_label(spark):
    from datetime import date

    day = date(2024, 1, 1)
    listed = spark.createDataFrame([("domain", "0.1", "block", day), ("domain", "10.0.0.2", "block", day), ("domain", "1.2.3", "watch", day)], "kind string, pattern string, action string, listed_at date")
    urls = ["http://10.0.0.1/a", "http://10.0.0.2:80/", "http://1.2.3/", "http://x.1.2.3/", "http://a.10.0.0.2/", "http://10.0.0.2/" + "p/" * 20_000]
    rows = spark.createDataFrame([(i, u, day, "x") for i, u in enumerate(urls)], "capture_id long, url string, fetched_at date, host string")
    got = {r["capture_id"]: r["action"] for r in filter_urls(rows, listed).collect()}
    assert got == {0: "allow", 1: "block", 2: "watch", 3: "watch", 4: "allow", 5: "block"}


def test_many_cells_that_take_rows_below_are_read_in_linear_time():
    import time

    begin = time.perf_counter()
    text = visible_text("<table><tr>" + "<td rowspan=60000>x" * 1500 + "<tr><td>y" * 6000 + "</table>")
    assert text.count("x") == 1500 and text.count("y") == 6000 and time.perf_counter() - begin < 20

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import toxicity
from siftline.llm.labelled import training_sample
from siftline.llm.quality import BINS, DEPTH, PENALTY, Boosted, accepted, boost, quality_scores, statistics
from siftline.llm.toxicity import Network, toxicity_scores

BAD = ("wretched", "vile", "rotten", "foul")


def corpus(n=260, seed=4):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 60))]
        good, toxic = r.random() < 0.7, r.random() < 0.35
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(BAD)
        text = " ".join(w) if good else " ".join(x + r.choice(("***", "&&&", "%%%")) for x in w)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, parts, back):
    return zlib.crc32(str(i).encode()) % parts == back


@pytest.mark.parametrize(("scores", "column", "parts", "back", "least"), [(quality_scores, 1, 4, 2, 0.95), (toxicity_scores, 2, 3, 1, 0.9)])
def test_held_out_accuracy(spark, docs, scores, column, parts, back, least):
    rows, labels = corpus()
    wrong = [(i, 1 - q, 1 - t) if held(i, parts, back) else (i, q, t) for i, q, t in labels]
    out = scores(docs(rows).select("doc_id", "text"), table(spark, wrong)).collect()  # labels held out are wrong, so learning from them would show
    truth = {x[0]: x[column] for x in labels}
    own = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in own} == {i for i, _ in rows if held(i, parts, back)}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_edges(spark, docs, scores):
    rows, labels = corpus(120)
    odd = [(900, None), (901, ""), (902, "x" * 2_000_000), (903, "a b " * 200_000), (None, "same words"), (904, "same words"), (904, "same words")]
    marks = table(spark, [*labels, (None, 1, 1), (5, None, None), (6, 1, 1), (6, 1, 1)])
    given = docs(rows + odd, extra=True).selectExpr("*", "'x' AS id", "'x' AS label", "'x' AS _id", "'x' AS _label", "'x' AS place", "'x' AS Predicted", "'x' AS least")
    table_ = scores(given, marks)
    assert sorted(table_.columns) == sorted({*(c for c in given.columns if c != "Predicted"), "score", "held_out", "predicted"})
    out = table_.collect()
    assert len(out) == len(rows) + len(odd)
    assert len({r["score"] for r in out if r["text"] == "same words"}) == 1
    by = {r["doc_id"]: r for r in out}
    assert by[900]["score"] == by[901]["score"] and by[None]["held_out"] is False
    assert scores(docs([]).select("doc_id", "text"), marks).collect() == []
    for few in (marks.limit(0), marks.where("doc_id = 7")):
        assert len({r["score"] for r in scores(docs(rows).select("doc_id", "text"), few).collect()}) == 1


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 5)), None
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    model = boost(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    inner = model.feature.shape[1]
    for row in x[:20]:
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - inner]
        assert model.margin(row[None])[0] == pytest.approx(total)
    assert isinstance(boost(x[:0], y[:0]), Boosted)


def test_statistics_of_single_texts():
    texts = ["", None, "a", "The the\nthe", "é ü", "x" * 50, " \n\t"]
    one = statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(one[i], statistics(pa.array([t], pa.string()))[0])
    assert not one[0].any() and not one[1].any()


def test_responses_by_definition():
    rng = np.random.default_rng(1)
    net = Network(rng.normal(size=(1 << 17, 8)).astype(np.float32), [rng.normal(size=(w, 8, 16)).astype(np.float32) for w in (1, 2, 3)], [rng.normal(size=16).astype(np.float32) for _ in range(3)], np.ones(48, np.float32), 0.0)
    ids = rng.integers(1, 1 << 17, (9, 2))
    e = net.words[ids[:, 0]] + net.words[ids[:, 1]]
    for w, r in zip((1, 2, 3), net.responses(ids), strict=True):
        for i in range(9):
            want = net.shifts[w - 1] + sum(e[i + o] @ net.filters[w - 1][o] for o in range(w) if i + o < 9)
            assert np.allclose(r[i], want, atol=1e-4)


def test_accepted_keeps_rows_unchanged(spark, docs):
    rows, labels = corpus()
    given = docs(rows, extra=True).selectExpr("*", "'x' AS _id", "'x' AS _label", "'x' AS label")
    kept = accepted(given, table(spark, labels))
    assert kept.columns == given.columns
    truth = {i: q for i, q, _ in labels}
    got = {r["doc_id"] for r in kept.collect()}
    assert np.mean([(i in got) == bool(truth[i]) for i, _ in rows]) > 0.95
    assert accepted(docs([]), table(spark, labels)).count() == 0


def test_sample_is_bounded_in_rows_and_bytes(spark, docs):
    rows, labels = corpus(60)
    many = docs([r for r in rows for _ in range(20)])
    marks = table(spark, labels)
    got = training_sample(many, marks, "quality", 4, 2, 7, 1 << 20).collect()
    assert len(got) == 7
    size = sum(len(r["text"]) for r in got)
    fewer = training_sample(many, marks, "quality", 4, 2, 7, size - 1).collect()
    assert 0 < len(fewer) < 7 and sum(len(r["text"]) for r in fewer) < size
    assert training_sample(many, marks, "quality", 4, 2, 7, 1).collect() == []


def test_splits_are_the_best_of_all():
    """Each split of the first tree against every statistic and every edge, tried one by one."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 1] > 0.2) ^ (x[:, 2] + 0.3 * rng.normal(size=300) > 0.5)).astype(float)
    model = boost(x, y)
    g, h = np.full(300, y.mean()) - y, np.full(300, y.mean() * (1 - y.mean()))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]

    def gain(rows, f, cut):
        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
        if h[left].sum() < 1 or h[right].sum() < 1:
            return 0.0
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + PENALTY)
        return part(left) + part(right) - part(rows)

    todo = [(0, np.arange(300))]
    for node, rows in todo:
        if node >= 2**DEPTH - 1:
            assert model.leaf[0, node - 2**DEPTH + 1] == pytest.approx(-0.15 * g[rows].sum() / (h[rows].sum() + PENALTY))
            continue
        f, cut = model.feature[0, node], model.cut[0, node]
        best = max(gain(rows, i, c) for i in range(4) for c in edges[i])
        assert (gain(rows, f, cut) if np.isfinite(cut) else 0.0) == pytest.approx(best if best > 1e-6 else 0.0)
        todo += [(2 * node + 1, rows[x[rows, f] <= cut]), (2 * node + 2, rows[x[rows, f] > cut])]


def network(seed=1):
    rng = np.random.default_rng(seed)
    return Network(rng.normal(size=(1 << 17, 8)).astype(np.float32), [rng.normal(0, 0.5, (w, 8, 16)).astype(np.float32) for w in (1, 2, 3)], [rng.normal(size=16).astype(np.float32) for _ in range(3)], rng.normal(0, 0.3, 48).astype(np.float32), 0.1)


def some_texts(rng, sizes=(5, 1, 17, 30)):
    """Texts of word ids, each followed by three zeros, as the network sees them."""
    parts = [np.concatenate([rng.integers(1, 1 << 17, (n, 2)), np.zeros((3, 2), np.int64)]) for n in sizes]
    return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


@pytest.mark.parametrize("span", [1 << 15, 7])
def test_pooling_by_definition(monkeypatch, span):
    """The largest response of each filter in each text, whole or in spans."""
    monkeypatch.setattr(toxicity, "SPAN", span)
    net = network()
    ids, begins = some_texts(np.random.default_rng(2))
    got, (tops, at) = net.pooled(ids, begins), toxicity._largest(net, ids, begins)
    for i in range(len(begins) - 1):
        e = net.words[ids[begins[i] : begins[i + 1], 0]] + net.words[ids[begins[i] : begins[i + 1], 1]]
        after = ids[begins[i + 1] : begins[i + 1] + 2]
        e = np.concatenate([e, net.words[after[:, 0]] + net.words[after[:, 1]], np.zeros((2, 8))])
        for k, (w, f, s) in enumerate(zip((1, 2, 3), net.filters, net.shifts, strict=True)):
            r = np.stack([s + sum(e[p + o] @ f[o] for o in range(w)) for p in range(begins[i + 1] - begins[i])])
            assert np.allclose(got[i, 16 * k : 16 * k + 16], np.maximum(r.max(0), 0), atol=1e-4)
            assert np.allclose(tops[k][i], np.maximum(r.max(0), 0), atol=1e-4)
            assert np.allclose(r[at[k][i] - begins[i], np.arange(16)], r.max(0), atol=1e-4)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(5)
    net = network(3)
    ids, begins = some_texts(rng)
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.7, 1.3, 0.5, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-(net.pooled(ids, begins) @ net.out + net.bias)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    grads, words, pushed = toxicity._gradients(net, ids, begins, y, weight)
    places = [(v, k, grads[k]) for k, v in toxicity._parameters(net).items()] + [(net.words, "words", dict(zip(words.tolist(), pushed, strict=True)))]
    agree = total = 0
    for values, name, grad in places:
        for _ in range(12):
            at = (int(rng.choice(words[words > 0])), int(rng.integers(8))) if name == "words" else tuple(int(rng.integers(n)) for n in values.shape)
            want = grad[at[0]][at[1]] if name == "words" else grad[at]
            old = values[at]
            values[at] = old + 2e-3
            up = loss()
            values[at] = old - 2e-3
            down = loss()
            values[at] = old
            total += 1
            agree += abs((up - down) / 4e-3 - want) < 2e-3 + 0.02 * abs(want)
    assert agree >= 0.95 * total  # a largest response may change its place within a step


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(6)
    for _ in range(20):
        z, y = rng.normal(size=40).round(2), (rng.random(40) < 0.4).astype(float)
        if not 0 < y.sum() < 40:
            continue
        f1 = lambda cut: 2 * y[z > cut].sum() / max(1, (z > cut).sum() + y.sum())  # noqa: B023, E731
        assert f1(toxicity._threshold(z, y)) >= max(f1(c) for c in np.r_[z - 1e-3, z + 1e-3]) - 0.05


def test_one_very_long_text_takes_bounded_memory():
    import tracemalloc

    net = network()
    text = pa.array(["word other thing " * 350_000])
    tracemalloc.start()
    net.raw(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20

"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first letters; filters of several widths slide over them, each filter's largest response in the
document is kept, and a logistic layer weighs these. A threshold per language, the language being told from the
text's own function words, is calibrated on labelled rows that training didn't see.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.labelled import CUT, held_out, scored, training_sample
from siftline.llm.wordkeys import Words, mix, slices

#: Labelled rows learnt from at most; hashed words, their dimensions, filter widths and filters of each.
MOST_LABELLED, TABLE, SIZE, WIDTHS, FILTERS = 10_000, 1 << 17, 8, (1, 2, 3), 16
#: Bytes of labelled texts learnt from at most; words whose responses are held at once.
MOST_BYTES, SPAN = 32 << 20, 1 << 15
#: Bytes of a word's beginning that have an embedding of their own.
BEGINNING = 5
#: Rounds (more where documents are few), documents a step, step size; documents that must hold a hashed word before it is learnt.
ROUNDS, STEP_DOCS, RATE, LEAST_DOCS = 4, 32, 0.05, 3
#: Each language's function words; fixed values.
LANGUAGES = {
    "en": "the of and to in is that for it with as was on be by this are",
    "de": "der die das und ist von den mit des ein eine nicht zu im auf für",
    "fr": "le la les et un une que qui du dans pour est sur par au de des",
    "es": "el los las y del que se con una por su para es al lo como de",
}
#: Words here end at any ASCII character that is no letter or digit.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SIGNS = [np.sort(Words(pa.array([w])).hashes()) for w in LANGUAGES.values()]


def _languages(words: Words, hashes: np.ndarray) -> np.ndarray:
    """The language whose function words are most among a text's, or -1 where none occurs."""
    votes = np.zeros((words.rows, len(_SIGNS)))
    for k, sign in enumerate(_SIGNS):
        hit = sign[np.minimum(np.searchsorted(sign, hashes), len(sign) - 1)] == hashes
        votes[:, k] = np.diff(np.r_[0, np.cumsum(hit)][words.first])
    return np.where(votes.max(1) > 0, votes.argmax(1), -1)


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins, languages): texts' hashed words and beginnings one after another, each text followed by zeros."""
    words = Words(text, _BREAK)
    hashes = words.hashes()
    pad = max(WIDTHS)
    begins = words.first + pad * np.arange(words.rows + 1)
    ids = np.zeros((begins[-1], 2), np.int32)
    at = np.arange(len(hashes)) + pad * words.row
    ids[at, 0] = hashes % np.uint64(TABLE - 1) + np.uint64(1)
    ids[at, 1] = mix(words.hashes(first_bytes=BEGINNING)) % np.uint64(TABLE - 1) + np.uint64(1)
    return ids, begins, _languages(words, hashes)


@dataclass
class Network:
    words: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    cuts: dict[int, float] = field(default_factory=dict)
    slope: float = 1.0

    def responses(self, ids: np.ndarray, kind=np.float32, n: int | None = None) -> list[np.ndarray]:
        """Each width's filter responses at the first ``n`` positions, or all; the last ones see zeros beyond the end."""
        n, most = len(ids) if n is None else n, max(WIDTHS)
        e = np.zeros((n + most - 1, SIZE), kind)
        seen = ids[: n + most - 1]
        np.add(self.words[seen[:, 0]], self.words[seen[:, 1]], out=e[: len(seen)])
        parts = e @ np.concatenate([f[o] for f in self.filters for o in range(len(f))], 1).astype(kind)
        out, column = [], 0
        for width, shift in zip(WIDTHS, self.shifts, strict=True):
            r = parts[:n, column : column + FILTERS] + shift
            for o in range(1, width):
                r += parts[o : o + n, column + o * FILTERS : column + (o + 1) * FILTERS]
            column += width * FILTERS
            out.append(r)
        return out

    def pooled(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text, 0 at least; long texts go in spans."""
        out = np.zeros((len(begins) - 1, FILTERS * len(WIDTHS)))
        for a in range(0, len(ids), SPAN):
            b = min(a + SPAN, len(ids))
            first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
            cuts = np.maximum(begins[first:last], a) - a
            found = np.concatenate([np.maximum.reduceat(r, cuts, axis=0) for r in self.responses(ids[a : b + max(WIDTHS) - 1], np.float64, b - a)], 1)
            np.maximum(out[first:last], found, out=out[first:last])
        return out

    def raw(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z, lang = np.zeros(len(text)), np.zeros(len(text), np.int64)
        for a, b in slices(text, 1 << 20):
            ids, begins, own = _tokens(text.slice(a, b - a))
            # in doubles and rounded, so that a text's neighbours in a batch leave no trace
            z[a:b], lang[a:b] = np.round(self.pooled(ids, begins) @ self.out + self.bias, 6), own
        return z, lang

    def probability(self, text: pa.Array) -> np.ndarray:
        """0 to 1; CUT exactly where the language's threshold is."""
        z, lang = self.raw(text)
        cut = np.array([self.cuts.get(int(k), self.cuts.get(-1, 0.0)) for k in lang]) if len(lang) else 0.0
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def _train(texts: list[str], y: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    net = Network(
        np.zeros((TABLE, SIZE), np.float32),
        [rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, width).astype(np.float32),
        float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))),
    )
    docs = []
    for t in texts:
        ids, _, _ = _tokens(pa.array([t]))
        docs.append(ids)
    often = np.zeros(TABLE, np.int32)
    for ids in docs:
        often[np.unique(ids)] += 1
    known = (often >= LEAST_DOCS) & (np.arange(TABLE) > 0)
    net.words[known] = rng.normal(0, 0.05, (int(known.sum()), SIZE))
    docs = [np.where(known[ids], ids, 0) for ids in docs]
    sums = {"words": np.full((TABLE, 1), 1e-3, np.float32)}
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    state = {k: np.zeros_like(v) for k, v in _parameters(net).items()}
    for _ in range(max(ROUNDS, min(15 * ROUNDS, 8000 * ROUNDS // max(1, len(docs))))):
        order = rng.permutation(len(docs))
        for s in range(0, len(docs), STEP_DOCS):
            some = order[s : s + STEP_DOCS]
            ids = np.concatenate([docs[i] for i in some])
            begins = np.r_[0, np.cumsum([len(docs[i]) for i in some])]
            _step(net, ids, begins, y[some], weight[some], state, sums)
    return net


def _parameters(net: Network) -> dict[str, np.ndarray]:
    return {"out": net.out} | {f"f{i}": f for i, f in enumerate(net.filters)} | {f"s{i}": f for i, f in enumerate(net.shifts)}


def _largest(net: Network, ids: np.ndarray, begins: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each width, every text's largest response of each filter (0 at least) and its place, the first of equal ones."""
    n = len(begins) - 1
    tops = [np.full((n, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
    at = [np.zeros((n, FILTERS), np.int64) for _ in WIDTHS]
    for a in range(0, len(ids), SPAN):
        b = min(a + SPAN, len(ids))
        first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
        cuts = np.r_[np.maximum(begins[first:last], a), b] - a
        for r, top, place in zip(net.responses(ids[a : b + max(WIDTHS) - 1], np.float32, b - a), tops, at, strict=True):
            for i in range(last - first):
                part = r[cuts[i] : cuts[i + 1]]
                where = part.argmax(0)
                value = part[where, np.arange(FILTERS)]
                better = value > top[first + i]
                top[first + i, better] = value[better]
                place[first + i, better] = (where + a + cuts[i])[better]
    return [np.maximum(t, 0) for t in tops], at


def _gradients(net: Network, ids, begins, y, weight) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(gradients of the weighted mean log loss by parameter, words touched, their gradients); only largest responses pass any back."""
    n = len(y)
    tops, at = _largest(net, ids, begins)
    pooled = np.concatenate(tops, 1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
    d = ((p - y) * weight / n).astype(np.float32)
    grads = {"out": pooled.T @ d, "bias": d.sum()}
    back = (d[:, None] * net.out) * (pooled > 0)
    touched, pushed = [], []
    padded = np.concatenate([ids, np.zeros((max(WIDTHS), 2), ids.dtype)])
    for w, width in enumerate(WIDTHS):
        g = back[:, w * FILTERS : (w + 1) * FILTERS]
        grads[f"s{w}"] = g.sum(0)
        gf = np.zeros_like(net.filters[w])
        for o in range(width):
            word = padded[at[w] + o]
            gf[o] = np.einsum("ijk,ij->kj", net.words[word].sum(2), g)
            push = (g[:, :, None] * net.filters[w][o].T[None]).reshape(-1, SIZE)
            touched += [word[:, :, 0].ravel(), word[:, :, 1].ravel()]
            pushed += [push, push]
        grads[f"f{w}"] = gf
    some, inverse = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(some), SIZE), np.float32)
    np.add.at(total, inverse, np.concatenate(pushed))
    total[some == 0] = 0
    return grads, some, total


def _step(net: Network, ids, begins, y, weight, state, sums) -> None:
    """One step of gradient descent scaled by past gradients."""
    grads, some, total = _gradients(net, ids, begins, y, weight)
    for k, v in _parameters(net).items():
        state[k] = 0.95 * state[k] + 0.05 * grads[k] ** 2
        v -= RATE * 0.2 * grads[k] / (np.sqrt(state[k]) + 1e-4)
    net.bias -= RATE * float(grads["bias"])
    sums["words"][some] += (total**2).mean(1, keepdims=True)
    net.words[some] -= RATE * total / np.sqrt(sums["words"][some])


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut between two scores that has the best F1."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    low = z[best + 1] if best + 1 < len(z) else z[best] - 1
    return float((z[best] + low) / 2)


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Network:
    """The network learnt from at most ``most`` labelled rows of MOST_BYTES together, a fifth of them for the thresholds."""
    rows = training_sample(docs, labels, "toxic", 3, 1, most, MOST_BYTES).toPandas()
    rows = rows.sort_values(["text", "label"]).sample(frac=1, random_state=3)
    texts, y = rows["text"].to_list(), rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Network(np.zeros((TABLE, SIZE), np.float32), [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, {-1: 1.0 - y.mean() if len(y) else 0.0})
    part = len(y) - len(y) // 5
    net = _train(texts[:part], y[:part])
    z, lang = net.raw(pa.array(texts[part:], pa.string()))
    y = y[part:]
    if not 0 < y.sum() < len(y):
        net.cuts = {-1: 0.0}
        return net
    net.cuts = {-1: _threshold(z, y)}
    for k in range(len(LANGUAGES)):
        own = lang == k
        if 30 <= y[own].sum() < own.sum():
            net.cuts[k] = _threshold(z[own], y[own])
    spread = float(np.abs(z - net.cuts[-1]).mean())
    net.slope = 2.0 / max(spread, 1e-3)
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``docs(doc_id, text)``' columns with (held_out, score, predicted); higher scores mean that toxic 1 is likelier.

    Only the text enters a score: equal texts score alike, null and empty ones as texts without words. Labels
    are learnt from rows whose crc32(doc_id as text) mod 3 is not 1. Without labels, or with one kind only, every
    document has the same score. Repeated rows, null ids and an empty table are scored like others; very long texts
    count whole, in spans of bounded memory. Columns named score, held_out or predicted are replaced, others are
    carried.
    """
    net = learn_toxicity(docs, labels, most)
    return scored(docs, net.probability, held_out=held_out(3, 1), predicted=(F.col("score") >= CUT).cast("int"))

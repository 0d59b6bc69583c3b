"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays, so a batch of documents walks all of them at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.labelled import CUT, held_out, kept, scored, training_sample
from siftline.llm.wordkeys import Words, mix, slices

#: Bytes of labelled texts learnt from at most.
MOST_BYTES = 256 << 20
#: Labelled rows learnt from at most; trees, their depth, bins per statistic, step and the leaves' penalty.
MOST_LABELLED, TREES, DEPTH, BINS, STEP, PENALTY = 20_000, 80, 4, 64, 0.15, 2.0
#: Function words of several languages; fixed values.
COMMON_WORDS = ("the of and to in is that for it with as was on be by this are or an at from "
                "der die das und ist von den mit des ein eine nicht zu im auf für "
                "le la les de des et un une que qui en du dans pour est sur par au "
                "el los las y del que se con una por su para es al lo como").split()
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "high": range(128, 256),
    "stop": b".!?", "comma": b",;:", "bang": b"!", "bar": b"|", "star": b"*", "hash": b"#", "dollar": b"$", "percent": b"%", "amp": b"&",
    "at": b"@", "slash": b"/\\", "bracket": b"()[]{}<>", "equal": b"=+_~^-", "quote": b"'\"`", "control": (*range(0, 9), *range(14, 32), 127),
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes), _i] = 1
_FEW = ("characters", "entropy", "words", "word length", "word length spread", "short words", "long words", "distinct words", "top word", "common words", "lines", "distinct lines", "line length", "longest word", "distinct pairs")
STATISTICS = (*_CLASSES, *_FEW)


def _hashes_of(words) -> np.ndarray:
    return np.sort(Words(pa.array([" ".join(words)])).hashes())


_COMMON = _hashes_of(COMMON_WORDS)


def statistics(text: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; an empty or null one has zeros only."""
    out = np.zeros((len(text), len(STATISTICS)))
    for a, b in slices(text):
        part = text.slice(a, b - a)
        words = Words(part)
        hashes, length = words.hashes(), (words.end - words.start).astype(float)
        newline = np.r_[0, np.cumsum(words.raw == 10)][words.start] if len(words.start) else np.zeros(0)
        for i in range(b - a):
            lo, hi = words.offsets[i], words.offsets[i + 1]
            if lo == hi:
                continue
            count = np.bincount(words.raw[lo:hi], minlength=256)
            share = count / (hi - lo)
            seen = share[share > 0]
            row = [np.log1p(hi - lo), -(seen * np.log2(seen)).sum()]
            s, e = words.first[i], words.first[i + 1]
            n = e - s
            if n:
                h, size, line = hashes[s:e], length[s:e], newline[s:e]
                kinds, often = np.unique(h, return_counts=True)
                begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                lines = np.add.reduceat(mix(h), begin)
                pairs = np.unique(h[1:] * np.uint64(31) + h[:-1]) if n > 1 else h
                at = np.minimum(np.searchsorted(_COMMON, kinds), len(_COMMON) - 1)
                common = often[_COMMON[at] == kinds].sum()
                row += [np.log1p(n), size.mean(), size.std(), (size <= 3).mean(), (size >= 12).mean(), len(kinds) / n, often.max() / n, common / n]
                row += [np.log1p(len(lines)), len(np.unique(lines)) / len(lines), n / len(lines), np.log1p(size.max()), len(pairs) / max(1, n - 1)]
            else:
                row += [0.0] * 13
            out[a + i] = [*(share @ _CLASS), *row]
    return out


@dataclass
class Boosted:
    """Trees in arrays: node (t, i) sends a row right where statistic feature[t, i] exceeds cut[t, i]; leaves last."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-self.margin(x[i : i + 4096]))) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Newton boosting of the logistic loss on histograms of quantile bins."""
    n, width = x.shape
    inner = 2**DEPTH - 1
    if n == 0 or y.min() == y.max():
        base = 0.0 if n == 0 else float(np.log((y.mean() * n + 1) / ((1 - y.mean()) * n + 1)))
        return Boosted(base, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    flat = binned + np.arange(width) * BINS
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (many, width, BINS)
            gs, hs = (np.bincount(at, np.repeat(v, width), many * width * BINS).reshape(shape).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + PENALTY) + (gt - gs) ** 2 / (ht - hs + PENALTY) - gt**2 / (ht + PENALTY)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        where = node - inner
        leaf = -STEP * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + PENALTY)
        margin += leaf[where]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(base, np.stack(features), np.stack(cuts), np.stack(leaves))


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Boosted:
    """Trees learnt from at most ``most`` labelled rows' statistics; the texts stay on the executors."""
    sample = training_sample(docs, labels, "quality", 4, 2, most, MOST_BYTES)

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], names=["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort(x.T)  # the same trees whatever order the rows came in
    return boost(x[order], rows["y"].to_numpy(float)[order])


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``docs(doc_id, text)``' columns with (held_out, score, predicted); higher scores mean that quality 1 is likelier.

    Only the text enters a score: equal texts score alike; null and empty texts score by statistics of zeros.
    Labels are learnt from rows whose crc32(doc_id as text) mod 4 is not 2. Without labels, or with one kind
    only, every document has the same score. Repeated rows, null ids and an empty table are scored like others;
    very long texts count whole. Columns named score, held_out or predicted are replaced, others are carried.
    """
    model = learn_quality(docs, labels, most)
    return scored(docs, lambda text: model.probability(statistics(text)), held_out=held_out(4, 2), predicted=(F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``docs``' rows that the classifier predicts to be of quality 1, unchanged.

    Null and empty texts go or stay by the score of statistics of zeros; repeated rows and rows with a null doc_id
    by their texts. Columns of any other name are carried. An empty table gives an empty table.
    """
    model = learn_quality(docs, labels, most)
    return kept(docs, lambda text: model.probability(statistics(text)))

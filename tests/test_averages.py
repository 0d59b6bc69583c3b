"""Means of the rows within reach over blocks, against all pairs."""

import numpy as np
import pytest

from siftline.config import Config
from siftline.operators import averages, clustering, neighbours, spread
from siftline.operators.averages import Sums, finite, moved, packed, pieces, unpacked


def means(x, y, reach):
    """Each x moved to the mean of the y within reach, all pairs compared one dimension after the other."""
    with np.errstate(all="ignore"):
        far = sum(((x[:, None, d] - y[None, :, d]) ** 2 for d in range(x.shape[1])), np.zeros((len(x), len(y))))
        near = far <= reach * reach
        out = x.copy()
        for i in np.flatnonzero(near.any(1)):
            out[i] = y[near[i]].mean(0).astype(np.float32)
    return out


@pytest.mark.parametrize(
    ("made", "reach"),
    [
        (lambda rng: rng.normal(size=(900, 8)) * 0.375, 0.9),
        (lambda rng: np.round(rng.normal(size=(900, 3)) * 2) / 2, 0.5),  # many pairs are just in reach, and many rows equal
        (lambda rng: np.round(rng.normal(size=(400, 2)) * 10) / 10 + 4e4, 0.3),  # far from 0, on a grid that doubles don't hit
        (lambda rng: rng.normal(size=(300, 2)) * 1e-25, 1e-25),
        (lambda rng: rng.normal(size=(300, 2)) * np.where(rng.random((300, 1)) < 0.1, 1e30, 1), 0.7),
        (lambda rng: rng.integers(0, 2, (300, 2)).astype(float), 0.0),
        (lambda rng: np.where(rng.random((300, 2)) < 0.02, np.inf, rng.normal(size=(300, 2))), 0.7),
    ],
)
def test_sums_are_those_of_all_pairs(made, reach):
    y = made(np.random.default_rng(3))
    x, y = y[::-1].copy(), y[np.isfinite(y).all(1)]
    sums = Sums(x, reach)
    for s in range(0, len(y), 100):
        sums.add(y[s : s + 100], np.ones(len(y[s : s + 100])))
    np.testing.assert_allclose(sums.means(), means(x, y, reach), rtol=2e-7, atol=1e-9 * max(reach, 1e-25))


def test_equal_rows_weigh_as_often_as_they_are_there():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 0.0]])
    sums = Sums(x, 1.0)
    sums.add(x[:2], np.array([3.0, 1.0]))
    assert sums.means().tolist() == [[0.25, 0.0], [0.25, 0.0], [9.0, 0.0]]


def table(spark, made):
    rows = [(j, i, *map(float, v)) for j, x in made.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "job_id long, row_id long, a0 double, a1 double").repartition(3)


def test_blocks_are_bounded_and_move_by_all_rows(spark, monkeypatch):
    for module, least in ((averages, {"BLOCK_LEAST": 50, "BLOCK_MOST": 50, "PIECE_ROWS": 20, "CHUNK_ROWS": 8}), (neighbours, {"LEAF_ROWS": 16, "LEAF_SAMPLE": 2})):
        for k, v in least.items():
            monkeypatch.setattr(module, k, v)
    rng = np.random.default_rng(1)
    made = {4: rng.normal(size=(400, 2)), 7: np.concatenate([np.ones((300, 2)), rng.normal(size=(60, 2)), [[np.nan, 0.0], [np.inf, 0.0]]])}
    rows = table(spark, made)
    blocks = packed(rows, 2)
    held = [len(r["rows"]) // 8 for r in blocks.collect()]
    assert sum(held) == 760 == rows.where(finite(2)).count() and len(held) > 12 and max(held) <= 150
    parts = pieces(blocks, 2)
    # copies are one row of a piece with their number
    weights = [np.frombuffer(r["w"]) for r in parts.where("job_id = 7").collect()]
    assert sum(w.sum() for w in weights) == 360 and sum(map(len, weights)) <= 60 + len(held)
    got = {(r["job_id"], r["row_id"]): (r["a0"], r["a1"]) for r in unpacked(moved(blocks, parts, 2, 0.6, 5), 2).collect()}
    want = {}
    for j, x in made.items():
        some = x[np.isfinite(x).all(1)]
        want |= {(j, i): tuple(v) for i, v in enumerate(means(some, some, 0.6))}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)], rtol=2e-7, atol=1e-9)


def test_mean_shift_makes_no_row_for_each_pair(spark, monkeypatch):
    """A thousand rows that are all in reach of each other, which were a million rows in each of six steps."""
    monkeypatch.setattr(spread, "near", lambda *_: pytest.fail("pairs as rows"))
    x = (np.random.default_rng(4).normal(size=(1000, 2)) * 0.1).astype(np.float32)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "job_id long, row_id long, v array<float>")
    got = {r["row_id"]: (r["label"], r["cluster_count"]) for r in clustering.cluster(df, "mean_shift", Config(), most=64).collect()}
    label, n = clustering.mean_shift(x.astype(float), 0.9)
    assert got == {i: (int(k), n) for i, k in enumerate(label)}

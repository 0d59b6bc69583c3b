"""Neighbours over k-d leaves against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators.neighbours import Leaves, Tree, near


def tables(spark, made):
    rows = [(j, i, *map(float, v)) for j, x in made.items() for i, v in enumerate(x)]
    dims = next(iter(made.values())).shape[1]
    left = spark.createDataFrame(rows, "job_id long, row_id long, " + ", ".join(f"a{d} double" for d in range(dims))).repartition(3)
    return left, left.select("job_id", F.col("row_id").alias("other"), *(F.col(f"a{d}").alias(f"b{d}") for d in range(dims)))


@pytest.mark.parametrize("dims", [1, 3, 8])
def test_pairs_are_all_pairs_within_reach(spark, dims):
    rng = np.random.default_rng(dims)
    made = {1: rng.normal(size=(300, dims)), 2: np.round(rng.normal(size=(200, dims)) * 2) / 2, 9: rng.normal(size=(3, dims))}
    made[1][40:120], made[2][5] = made[1][7], np.nan
    left, right = tables(spark, made)
    reach = 0.5 if dims < 8 else 1.5
    got = near(Leaves(left, dims, leaf_rows=24), left, right, dims, reach).select("job_id", "row_id", "other").collect()
    want = {(j, a, b) for j, x in made.items() for a, b in zip(*np.nonzero(((x[:, None] - x[None]) ** 2).sum(2) <= reach * reach), strict=True)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_leaves_of_equal_points():
    x = np.ones((50, 2))
    assert Tree.built(x).leaves == 1 and Tree.built(np.zeros((0, 2))).leaves == 1
    x[::2, 1] = 3
    tree = Tree.built(x, 4)
    assert tree.leaves == 2 and sorted(np.bincount(tree.leaf(x))) == [25, 25]


def test_few_of_all_pairs_are_compared(spark):
    """Fifty thousand rows of eight dimensions: pairs that share a key against all pairs."""
    rng, n = np.random.default_rng(2), 50_000
    left, right = tables(spark, {1: rng.normal(size=(n, 8)).round(4)})
    leaves, a, b = Leaves(left, 8), [f"a{d}" for d in range(8)], [f"b{d}" for d in range(8)]
    counted = lambda df: df.groupBy("job_id", "cell", "key").agg(F.count("*").alias("n"))
    held = counted(leaves.keyed(right, b, "other"))
    pairs = counted(leaves.looked_into(left, a, 0.45)).join(held.withColumnRenamed("n", "m"), ["job_id", "cell", "key"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert held.agg(F.sum("n"), F.max("n")).first()[0] == n and pairs < n * n / 10


def test_near_broadcasts_nothing(spark, tmp_path):
    spark.range(300).selectExpr("1L AS job_id", "id AS row_id", "id / 10 AS a0").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    leaves = Leaves(rows, 1)
    other = rows.selectExpr("job_id", "row_id AS other", "a0 AS b0")
    for more in ((), (None, "left_semi")):
        found = near(leaves, rows, other, 1, 0.55, *more)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert near(leaves, rows, other, 1, 0.55).count() == 300 + 2 * sum(300 - k for k in range(1, 6))

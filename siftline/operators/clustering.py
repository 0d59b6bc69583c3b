"""Seven ways to segment a job's feature vectors, with their observed semantics.

Jobs of up to GROUP_ROWS rows are a group each. Larger ones are spread over tasks (``spread``), but for optics and
agglomerative, which look at a job's first rows only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.config import algorithm as named
from siftline.staging import staged

K, KMEANS_ROUNDS, GMM_ROUNDS = 3, 12, 8
LEADERS, MODES, SHIFTS, MODE_REACH = 8, 16, 6, 0.04
BAND_ROWS, PAIR_ROWS = 4096, 1024
#: Rows of the largest job that goes into one group.
GROUP_ROWS = 4096
# Mixture weights to begin with; fixed values.
WEIGHTS = (0.34, 0.33, 0.33)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def kmeans(x: np.ndarray, k: int = K) -> tuple[np.ndarray, int]:
    """Farthest-first centres from the first row, then twelve rounds; an empty centre stays."""
    k = min(k, len(x))
    centers = x[:1].astype(float)
    while len(centers) < k:
        centers = np.vstack([centers, x[_nearest(x, centers)[1].argmax()]])
    label = np.zeros(len(x), int)
    for _ in range(KMEANS_ROUNDS):
        label, _ = _nearest(x, centers)
        for c in range(k):
            if (own := label == c).any():
                centers[c] = x[own].mean(0).astype(np.float32)
    return label, k


class Within:
    """Rows within a distance of a point, looked up along the first dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x[:, 0], kind="stable")
        self.first = x[self.order, 0]

    def __call__(self, point: np.ndarray, reach: float) -> np.ndarray:
        if np.isnan(point).any():
            return np.zeros(0, int)
        pad = reach * (1 + 1e-9) + 1e-12
        some = self.order[np.searchsorted(self.first, point[0] - pad, "left") : np.searchsorted(self.first, point[0] + pad, "right")]
        return some[((self.x[some] - point) ** 2).sum(1) <= reach * reach]


def dbscan(x: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, int]:
    """A dense row that no cluster has opens one with its unclaimed direct neighbours; clusters don't expand."""
    label, near, clusters = np.full(len(x), -2), Within(x), 0
    for i in range(len(x)):
        if label[i] != -2:
            continue
        own = near(x[i], eps)
        if len(own) < least:
            label[i] = -1
            continue
        label[i] = clusters
        label[own[label[own] == -2]] = clusters
        clusters += 1
    return label, clusters


def birch(x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Rows in order join the nearest of eight leaders or open one; when all are taken the last is moved."""
    label, state = birch_fold(x, threshold)
    return label, state[2]


def birch_fold(x: np.ndarray, threshold: float, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """The rows' labels and the state after them: leaders, rows held by each, leaders in use."""
    leader, held, n = state or (np.zeros((LEADERS, x.shape[1])), np.zeros(LEADERS), 0)
    leader, held = leader.copy(), held.copy()
    label = np.zeros(len(x), int)
    for r, row in enumerate(x):
        far = ((leader[:n] - row) ** 2).sum(1)
        best = int(far.argmin()) if n else 0
        if not n or not far[best] <= threshold * threshold:
            best = n if n < LEADERS else LEADERS - 1
            n = min(n + 1, LEADERS)
            leader[best] = row
        label[r] = best
        held[best] += 1
        leader[best] = ((leader[best] * (held[best] - 1) + row) / held[best]).astype(np.float32)
    return label, (leader, held, n)


def mean_shift(x: np.ndarray, bandwidth: float) -> tuple[np.ndarray, int]:
    """Each row climbs six steps over a flat kernel, then takes the first mode in reach; sixteen modes at most."""
    near, modes, label = Within(x), [], np.zeros(len(x), int)
    for r in range(len(x)):
        point = x[r]
        for _ in range(SHIFTS):
            own = near(point, bandwidth)
            if not len(own):
                break
            point = x[own].mean(0).astype(np.float32).astype(float)
        hit = next((i for i, m in enumerate(modes) if ((m - point) ** 2).sum() < MODE_REACH), len(modes))
        if hit == len(modes) and hit < MODES:
            modes.append(point)
        label[r] = hit
    return label, len(modes)


def _exchanged(counts: np.ndarray) -> np.ndarray:
    """Row numbers by falling count, in the order in which an exchange sort leaves equal ones."""
    order, value = np.arange(len(counts)), counts.copy()
    for i in range(len(value)):
        # each exchange at i puts the next larger value there
        while True:
            more = np.flatnonzero(value[i + 1 :] > value[i])
            if not len(more):
                break
            j = i + 1 + more[0]
            value[i], value[j] = value[j], value[i]
            order[i], order[j] = order[j], order[i]
    return order


def optics(x: np.ndarray, eps: float, least: int, stable: bool = False) -> tuple[np.ndarray, int]:
    """Bands of ``least`` rows by falling neighbour count, over the first rows; the others have label 0."""
    label, some = np.zeros(len(x), int), x[:BAND_ROWS]
    near = Within(some)
    counts = np.array([len(near(p, eps)) for p in some])
    order = np.argsort(-counts, kind="stable") if stable else _exchanged(counts)
    label[order] = np.arange(len(some)) // least
    return label, len(some) // least + 1


def gmm(x: np.ndarray, k: int = K) -> tuple[np.ndarray, int]:
    """Eight rounds over unit variances from the first three rows."""
    means, weights = x[np.arange(k) % len(x)].astype(float), np.array(WEIGHTS[:k])
    label = np.zeros(len(x), int)
    for _ in range(GMM_ROUNDS):
        part = weights * np.exp(-0.5 * ((x[:, None, :] - means[None]) ** 2).sum(2))
        total = part.sum(1, keepdims=True)
        part = part / np.where(total == 0, 1.0, total)
        label = part.argmax(1)
        held = part.sum(0)
        weights = held / len(x)
        means = ((part.T @ x) / np.where(held > 0, held, 1.0)[:, None]).astype(np.float32).astype(float)
    return label, k


def agglomerative(x: np.ndarray, target: int = K) -> tuple[np.ndarray, int]:
    """Of the first rows only the closest pair shares a label; the others have one each, rows beyond have 0."""
    label, some = np.zeros(len(x), int), x[:PAIR_ROWS]
    n = len(some)
    own = np.arange(n)
    if n > target and n > 1:
        best, pair = np.inf, (0, 1)
        for i in range(n - 1):
            far = ((some[i + 1 :] - some[i]) ** 2).sum(1)
            j = int(np.nanargmin(far)) if not np.isnan(far).all() else 0
            if far[j] < min(best, 1e18):
                best, pair = far[j], (i, i + 1 + j)
        own[pair[1]] = own[pair[0]]
    _, first, back = np.unique(own, return_index=True, return_inverse=True)
    label[:n] = np.argsort(np.argsort(first))[back]
    return label, len(first)


def assign(x: np.ndarray, name: str, config: Config) -> tuple[np.ndarray, int]:
    x, eps, least = x.astype(float), config.dbscan_eps, config.dbscan_min_samples
    match named(name):
        case "kmeans++":
            return kmeans(x)
        case "birch":
            return birch(x, eps)
        case "mean_shift":
            return mean_shift(x, 2 * eps)
        case "optics":
            return optics(x, 1.2 * eps, least)
        case "gmm":
            return gmm(x)
        case "agglomerative":
            return agglomerative(x)
    return dbscan(x, eps, least)


def cluster(features: DataFrame, name: str | None = None, config: Config = Config(), most: int = GROUP_ROWS) -> DataFrame:
    """(job_id, row_id, label, cluster_count); the algorithm is ``name`` or the features' column ``algorithm``.

    Jobs are counted at once; those of more than ``most`` rows are written once and spread over tasks.
    """
    from siftline.operators import spread

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id", kind="stable")
        label, n = assign(np.stack(pdf["v"].to_list()), pdf["algorithm"].iloc[0], config)
        return pd.DataFrame({"job_id": pdf["job_id"], "row_id": pdf["row_id"], "label": label.astype("int32"), "cluster_count": np.int64(n)})

    def grouped(some: DataFrame) -> DataFrame:
        return some.groupBy("job_id").applyInPandas(run, "job_id long, row_id long, label int, cluster_count long")

    marked = (features if name is None else features.withColumn("algorithm", F.lit(name))).select("job_id", "row_id", "v", "algorithm")
    counted = marked.groupBy("job_id").agg(F.count("*").alias("n"), F.first("algorithm").alias("algorithm"), F.max(F.size("v")).alias("dims"))
    large = counted.where(F.col("n") > most).collect()
    if not large:
        return grouped(marked)
    table = marked.sparkSession.createDataFrame([(r["job_id"],) for r in large], "job_id long")
    rows = staged(marked.join(F.broadcast(table), "job_id"))
    out = grouped(marked.join(F.broadcast(table), "job_id", "left_anti"))
    jobs: dict[str, list] = {}
    for r in large:
        jobs.setdefault(named(r["algorithm"]), []).append(r)
    for kind, some in jobs.items():
        own = rows.join(F.broadcast(marked.sparkSession.createDataFrame([(r["job_id"],) for r in some], "job_id long")), "job_id")
        if kind in spread.FORMS:
            labels = spread.FORMS[kind](own.drop("algorithm"), max(r["dims"] for r in some), config)
        else:
            first = BAND_ROWS if kind == "optics" else PAIR_ROWS
            head = staged(grouped(own.where(F.col("row_id") < first)))
            rest = own.where(F.col("row_id") >= first).select("job_id", "row_id", F.lit(0).alias("label"))
            labels = head.unionByName(rest.join(F.broadcast(head.select("job_id", "cluster_count").distinct()), "job_id"))
        out = out.unionByName(labels.select("job_id", "row_id", "label", "cluster_count"))
    return out


def spread_kmeans(features: DataFrame, k: int = K) -> DataFrame:
    """k-means as ``kmeans`` has it, a job's rows spread over tasks: (job_id, row_id, label).

    Only k centres of each job travel, through the driver: a round is one grouping with partial sums. Persist
    ``features`` where they are dear to make.
    """
    spark = features.sparkSession
    far = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2.0)), F.lit(0.0), lambda s, d: s + d)

    def with_centers(centers: dict) -> DataFrame:
        table = spark.createDataFrame(list(centers.items()), "job_id long, centers array<array<float>>")
        return features.join(F.broadcast(table), "job_id").withColumn("far", F.transform("centers", far))

    centers = {r["job_id"]: [list(r["v"])] for r in features.where("row_id = 0").collect()}
    if not centers:
        return features.select("job_id", "row_id", F.lit(0).alias("label"))
    for _ in range(k - 1):
        found = with_centers(centers).groupBy("job_id").agg(F.max_by("v", F.struct(F.array_min("far"), -F.col("row_id"))).alias("v"), F.count("*").alias("n"))
        for r in found.collect():
            if len(centers[r["job_id"]]) < r["n"]:
                centers[r["job_id"]].append(list(r["v"]))
    label = (F.array_position("far", F.array_min("far")) - 1).cast("int")
    for _ in range(KMEANS_ROUNDS - 1):
        dims = max(len(c[0]) for c in centers.values())
        means = with_centers(centers).groupBy("job_id", label.alias("label")).agg(F.array(*(F.avg(F.get("v", d).cast("double")) for d in range(dims))).alias("c"))
        for r in means.collect():
            centers[r["job_id"]][r["label"]] = [float(x) for x in r["c"] if x is not None]
    return with_centers(centers).select("job_id", "row_id", label.alias("label"))


def closest_pair(features: DataFrame) -> DataFrame:
    """(job_id, i, j): the closest of the first rows, as agglomerative merges them; at most PAIR_ROWS rows a job."""
    some = features.where(F.col("row_id") < PAIR_ROWS)
    pair = some.select("job_id", F.col("row_id").alias("i"), F.col("v").alias("a")).join(some.select("job_id", F.col("row_id").alias("j"), F.col("v").alias("b")), "job_id").where("i < j")
    from siftline.functions.numbers import distance_sq

    return pair.groupBy("job_id").agg(F.min(F.struct(distance_sq(F.col("a"), F.col("b")).alias("d"), "i", "j")).alias("p")).select("job_id", "p.i", "p.j")


def density_bands(features: DataFrame, eps: float, least: int) -> DataFrame:
    """(job_id, row_id, label): optics with equal counts in row order, in columns only; rows from BAND_ROWS on have label 0."""
    from siftline.functions.numbers import distance_sq

    some = features.where(F.col("row_id") < BAND_ROWS)
    cell = F.floor(F.col("v")[0] / eps)
    left = some.select("job_id", "row_id", F.col("v").alias("a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = some.select("job_id", F.col("v").alias("b"), cell.alias("cell"))
    near = left.join(right, ["job_id", "cell"]).where(F.sqrt(distance_sq(F.col("a"), F.col("b"))) <= eps)
    counts = near.groupBy("job_id", "row_id").agg(F.count("*").alias("n"))
    # a row near to none, not even to itself, has a band too
    counts = some.select("job_id", "row_id").join(counts, ["job_id", "row_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n"), "row_id")) - 1
    bands = counts.select("job_id", "row_id", F.floor(rank / least).cast("int").alias("label"))
    return bands.unionByName(features.where(F.col("row_id") >= BAND_ROWS).select("job_id", "row_id", F.lit(0).alias("label")))

"""Fixed statistics of feature vectors, one row per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, OUTLIER, FLAT = 32, 9.0, 1e-4


def _bucket(c) -> F.Column:
    return F.when(F.isnan(c), 0).otherwise(F.least(F.lit(float(BUCKETS - 1)), F.floor(F.least(F.abs(c), F.lit(float(BUCKETS)))).cast("double"))).cast("int")


def dim_stats(features: DataFrame, dims: int) -> DataFrame:
    """(job_id, row_count, dimensions, mean, min, max, stddev arrays, entropy, slope): one pass with partial sums."""
    v = [F.col("v")[d].cast("double") for d in range(dims)]
    x = [f"x{d}" for d in range(dims)]
    flat = features.select("job_id", "row_id", *(c.alias(n) for c, n in zip(v, x, strict=True)), _bucket(v[0]).alias("bucket"))

    def edge(f, name):
        # a NaN counts only in the first row, where nothing compares as less or greater
        first = F.max(F.when((F.col("row_id") == 0) & F.isnan(name), True))
        return F.when(first, F.lit(float("nan"))).otherwise(f(F.when(~F.isnan(name), F.col(name))))

    n = F.count("*")
    hist = [F.count(F.when(F.col("bucket") == b, 1)) for b in range(BUCKETS)]
    spread = sum((F.when(h > 0, -(h / n) * F.log2(h / n)).otherwise(0.0) for h in hist), F.lit(0.0))
    return flat.groupBy("job_id").agg(
        n.alias("row_count"), F.lit(dims).cast("long").alias("dimensions"),
        F.array(*(F.avg(c) for c in x)).alias("mean"), F.array(*(edge(F.min, c) for c in x)).alias("min"), F.array(*(edge(F.max, c) for c in x)).alias("max"),
        F.array(*(F.stddev_pop(c) for c in x)).alias("stddev"), spread.alias("entropy"), F.coalesce(F.regr_slope("x0", F.col("row_id").cast("double")), F.lit(0.0)).alias("slope"),
    )


def scores(features: DataFrame, stats: DataFrame) -> DataFrame:
    """(job_id, row_id, score): the sum of squared deviations in standard deviations, 1 where a column is flat."""
    joined = features.join(stats.select("job_id", "mean", "stddev"), "job_id")
    part = F.zip_with("v", F.arrays_zip("mean", "stddev"), lambda x, s: F.pow((x.cast("double") - s["mean"]) / F.when(s["stddev"] > FLAT, s["stddev"]).otherwise(1.0), 2.0))
    return joined.select("job_id", "row_id", F.aggregate(part, F.lit(0.0), lambda a, b: a + b).alias("score"))


def summary(features: DataFrame, dims: int) -> DataFrame:
    """``dim_stats`` with outlier_ratio and trend."""
    stats = dim_stats(features, dims)
    ratio = scores(features, stats).groupBy("job_id").agg(F.avg((F.col("score") > OUTLIER).cast("double")).alias("outlier_ratio"))
    return stats.join(ratio, "job_id").withColumn("trend", trend("slope"))


def trend(slope) -> F.Column:
    slope = F.col(slope) if isinstance(slope, str) else slope
    return F.when(slope > 0.05, "Rising").when(slope < -0.05, "Falling").otherwise("Stable")


def cluster_sizes(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(job_id, label, n) for every label below the job's cluster_count, empty ones too."""
    every = counts.where("cluster_count > 0").select("job_id", F.explode(F.sequence(F.lit(0), F.col("cluster_count").cast("int") - 1)).alias("label"))
    held = labels.groupBy("job_id", "label").agg(F.count("*").alias("n"))
    return every.join(held, ["job_id", "label"], "left").select("job_id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def balance(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("job_id").agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).withColumn("balance", F.when(F.col("largest") > 0, F.col("smallest") / F.col("largest")).otherwise(0.0))


def cluster_density(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(job_id, slot, n, density): a cluster's share of the rows; noise stands in the slot after the last cluster."""
    slot = F.when(F.col("label") < 0, F.col("cluster_count")).otherwise(F.col("label")).cast("int")
    held = labels.join(counts.select("job_id", "cluster_count"), "job_id").groupBy("job_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    return held.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("job_id")))

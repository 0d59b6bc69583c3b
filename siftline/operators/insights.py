"""Sentences about a job's summary and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROAD, STEEP, PRESSED, NOISY, UNEVEN = 1.25, 0.05, 0.08, 0.15, 0.3


def insights(summaries: DataFrame, balances: DataFrame) -> DataFrame:
    """(job_id, pos, title, detail, tone) of summaries with cluster_count and balances (job_id, smallest, largest, balance)."""
    s = summaries.join(balances, "job_id", "left")
    c, text = F.col, F.format_string
    percent = c("outlier_ratio") * 100
    # titles and sentences are fixed values
    found = [
        (F.lit(True), "Segmentation", text("%d rows were compressed into %d cluster bands with %d numeric dimensions.", c("row_count"), c("cluster_count"), c("dimensions")), F.when(c("cluster_count") > 1, "warm").otherwise("calm")),
        (F.lit(True), "Distribution", text("Entropy landed at %.3f, which suggests a %s categorical spread in the payload.", c("entropy"), F.when(c("entropy") >= BROAD, "broad").otherwise("narrow")), F.when(c("entropy") >= BROAD, "hot").otherwise("calm")),
        (F.lit(True), "Trend", text("The dominant trend is %s with slope %.4f across the primary timeline.", c("trend"), c("slope")), F.when(F.abs("slope") >= STEEP, "warm").otherwise("calm")),
        (F.lit(True), "Anomaly pressure", text("Outliers account for %.2f%% of the observed rows.", percent), F.when(c("outlier_ratio") >= PRESSED, "hot").otherwise("calm")),
        (c("dimensions") >= 2, "Projection", text("A 2D projection of dim 0 and dim 1 is rendered. Range: [%.2f, %.2f] x [%.2f, %.2f].", c("min")[0], c("max")[0], F.get("min", 1), F.get("max", 1)), F.lit("calm")),
        (c("outlier_ratio") >= NOISY, "Noise signal", text("High outlier ratio (%.1f%%) indicates noisy or multi-modal data. Consider tuning epsilon or switching to OPTICS/GMM.", percent), F.lit("hot")),
        ((c("cluster_count") > 1) & (c("row_count") > 0), "Balance", text("Cluster balance is %.0f%% (largest %d vs smallest %d). %s", c("balance") * 100, c("largest"), c("smallest"), F.when(c("balance") < UNEVEN, "Highly imbalanced — review feature scaling.").otherwise("Reasonably balanced.")), F.when(c("balance") < UNEVEN, "warm").otherwise("calm")),
    ]
    every = F.array(*(F.struct(keep.alias("keep"), F.lit(title).alias("title"), detail.alias("detail"), tone.alias("tone")) for keep, title, detail, tone in found))
    return s.select("job_id", F.posexplode(F.filter(every, lambda x: x["keep"])).alias("pos", "i")).select("job_id", "pos", "i.title", "i.detail", "i.tone")

"""The two whole paths: jobs to results, and lines to a profile."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.operators import profile as p
from siftline.operators.clustering import cluster
from siftline.operators.features import feature_vectors
from siftline.operators.fields import fields, parsed, rows, stamped
from siftline.operators.insights import insights
from siftline.operators.summary import balance, cluster_density, cluster_sizes, summary
from siftline.sources.lines import engine_lines, profiler_lines
from siftline.staging import keeping, staged, unstage

NO_ROWS = "no analyzable rows found"


@dataclass
class Analysis:
    """Tables of one analysis; features and labels are staged, and ``close`` removes them when the others are written."""

    jobs: DataFrame
    features: DataFrame
    labels: DataFrame
    results: DataFrame
    insights: DataFrame
    density: DataFrame

    def close(self) -> None:
        unstage(self.features)
        unstage(self.labels)


def analyze(jobs: DataFrame, config: Config = Config()) -> Analysis:
    """Features, clusters, summaries and insights of jobs (job_id, algorithm, payload).

    results: (job_id, algorithm, status, error, cluster_count, summary columns); a job without rows has failed. What
    the settings switch off is 0 or Stable.
    """
    features = feature_vectors(engine_lines(jobs, config.max_rows_per_analysis), config)
    features = staged(features)
    labels = staged(cluster(features.join(jobs.select("job_id", "algorithm"), "job_id"), None, config))
    counts = labels.groupBy("job_id").agg(F.max("cluster_count").alias("cluster_count"))
    summed = summary(features, config.dims).join(counts, "job_id")
    sizes = balance(cluster_sizes(labels, counts))
    off = {
        "entropy": None if config.enable_shannon_entropy else F.lit(0.0),
        "slope": None if config.enable_linear_regression else F.lit(0.0),
        "outlier_ratio": None if config.enable_outlier_detection else F.lit(0.0),
        "trend": None if config.enable_time_series_trend and config.enable_linear_regression else F.lit("Stable"),
    }
    summed = summed.withColumns({c: v for c, v in off.items() if v is not None})
    told = insights(summed, sizes)
    density = cluster_density(labels.select("job_id", "label"), counts)
    done = jobs.select("job_id", "algorithm").join(summed, "job_id", "left")
    status = F.when(F.col("row_count").isNull(), "failed").otherwise("ready")
    results = done.select("job_id", "algorithm", status.alias("status"), F.when(F.col("row_count").isNull(), NO_ROWS).alias("error"), *(c for c in summed.columns if c != "job_id"))
    return Analysis(jobs, features, labels, results, told, density)


def status_json(results: DataFrame, updated_ms=None) -> DataFrame:
    """(job_id, json): jobId as a string, status, updatedMs, error."""
    now = F.lit(0).cast("long") if updated_ms is None else updated_ms
    return results.select("job_id", F.to_json(F.struct(F.col("job_id").cast("string").alias("jobId"), "status", now.alias("updatedMs"), F.coalesce("error", F.lit("")).alias("error"))).alias("json"))


def result_json(results: DataFrame, html_column: str | None = None, svg_column: str | None = None) -> DataFrame:
    """(job_id, json) with the eleven keys of a job's result."""
    page = F.coalesce(html_column, F.lit("")) if html_column else F.lit("")
    chart = F.coalesce(svg_column, F.lit("")) if svg_column else F.lit("")
    number = lambda c: F.coalesce(c, F.lit(0))
    body = F.struct(
        F.col("job_id").cast("string").alias("jobId"), "status", "algorithm", number("row_count").alias("rows"), number("cluster_count").alias("clusters"), number("entropy").alias("entropy"),
        number("slope").alias("trendSlope"), number("outlier_ratio").alias("outlierRatio"), page.alias("html"), chart.alias("svg"), F.coalesce("error", F.lit("")).alias("error"),
    )
    return results.select("job_id", F.to_json(body).alias("json"))


class Profile:
    """A profile of lines (job_id, line_index, line); each part is a DataFrame, made once, when it is asked for.

    Lines are parsed once, into a staged table that all parts read; times are read from it by the parts that show them.
    Key counts and numeric keys, a row for each job and key, are staged by the first part that needs them. Nothing stays
    cached; ``close``, or the end of a ``with`` block, removes all of it.
    """

    def __init__(self, lines: DataFrame, config: Config = Config()):
        self.config = config
        self._own: list[DataFrame] = []
        self.parsed = self._staged(parsed(lines))
        self.rows = rows(self.parsed)
        self.fields = fields(stamped(self.parsed))

    def _staged(self, df: DataFrame) -> DataFrame:
        with keeping(self._own):
            return staged(df)

    @classmethod
    def of(cls, jobs: DataFrame, config: Config = Config()) -> Profile:
        return cls(profiler_lines(jobs), config)

    def __enter__(self) -> Profile:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Removes the staged tables; nothing may be read from the profile afterwards."""
        for df in self._own:
            unstage(df)

    @cached_property
    def key_counts(self) -> DataFrame:
        return self._staged(p.key_counts(self.fields))

    @cached_property
    def numeric_keys(self) -> DataFrame:
        return self._staged(p.numeric_keys(self.key_counts, self.rows))

    @cached_property
    def scatter(self) -> DataFrame:
        with keeping(self._own):
            return p.scatter(self.parsed, self._staged(self.scatter_pairs))

    @cached_property
    def category_histogram(self) -> DataFrame:
        with keeping(self._own):
            return p.category_histogram(self.parsed, lambda: self.severity, lambda: self.entity, lambda: p.least_key(self.low_cardinality), lambda: self.format_coverage)

    schemas = cached_property(lambda self: p.schemas(self.fields, self.key_counts))
    samples = cached_property(lambda self: p.samples(self.fields))
    correlations = cached_property(lambda self: p.correlations(self.parsed, self.numeric_keys.where(F.lit(self.config.enable_correlation_matrix))))
    series = cached_property(lambda self: p.numeric_series(self.parsed, self.numeric_keys))
    scatter_pairs = cached_property(lambda self: p.scatter_pairs(self.correlations, self.numeric_keys))
    booleans = cached_property(lambda self: p.boolean_histogram(self.fields))
    text_lengths = cached_property(lambda self: p.text_lengths(self.fields, self.rows, self.key_counts))
    null_ratios = cached_property(lambda self: p.null_ratios(self.key_counts, self.rows))
    field_coverage = cached_property(lambda self: p.field_coverage(self.fields))
    shape_coverage = cached_property(lambda self: p.shape_coverage(self.rows))
    format_coverage = cached_property(lambda self: p.format_coverage(self.rows))
    dominant_keys = cached_property(lambda self: p.dominant_keys(self.fields, self.rows))
    severity = cached_property(lambda self: p.severity_histogram(self.rows))
    entity = cached_property(lambda self: p.entity_histogram(self.rows))
    low_cardinality = cached_property(lambda self: p.low_cardinality(self.fields, self.schemas, self.rows))
    category = cached_property(lambda self: p.category(self.fields, self.rows))
    totals = cached_property(lambda self: p.totals(self.rows))
    donuts = cached_property(lambda self: p.donuts(self.fields, self.schemas))
    stats_grid = cached_property(lambda self: p.stats_grid(self.schemas))
    counters = cached_property(lambda self: p.counters(self.rows, self.key_counts, self.numeric_keys, self.correlations))

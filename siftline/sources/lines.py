"""Payloads and tables as numbered lines.

Both views split a payload inside its row, so numbering needs no shuffle. The engine's keeps every line that isn't
empty; the profiler's trims lines and drops blank ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import MAX_ROWS, algorithm

#: White space as JavaScript has it, for a Java character class; fixed values.
JS_SPACE = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: The sample dataset; fixed values.
SAMPLE = "\n".join(
    (
        '{"timestamp":"2026-04-30T00:15:02.123Z","level":"INFO","service":"api","event":"login","user_id":9421,"latency_ms":12}',
        '{"timestamp":"2026-04-30T00:15:02.445Z","level":"WARN","service":"db","event":"pool","active_conns":425,"queue_depth":18}',
        '{"timestamp":"2026-04-30T00:15:03.001Z","level":"ERROR","service":"payments","event":"txn","duration_ms":73,"status_code":503}',
        '{"timestamp":"2026-04-30T00:15:03.110Z","level":"INFO","service":"storage","event":"backup","iops":15400,"bytes_sent":1200}',
        '{"timestamp":"2026-04-30T00:15:03.155Z","level":"DEBUG","service":"cache","event":"heartbeat","retry_attempt":3,"ttl_ms":4500}',
    )
)


def js_trim(c) -> F.Column:
    return F.regexp_replace(c, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def jobs(spark: SparkSession, payloads, names=()) -> DataFrame:
    """(job_id, algorithm, payload), ids counted from 1; blank payloads are refused."""
    rows = [(i, algorithm(names[i - 1] if i <= len(names) else None), p) for i, p in enumerate(payloads, 1)]
    if any(not (p or "").strip() for _, _, p in rows):
        raise ValueError("payload must not be blank")
    return spark.createDataFrame(rows, "job_id long, algorithm string, payload string")


def accepted(requests: DataFrame) -> DataFrame:
    """Requests (payload, algorithm) that ingest accepts, with the algorithm's canonical name."""
    lower = F.lower(F.coalesce("algorithm", F.lit("dbscan")))
    name = F.when(lower == "kmeans", "kmeans++").when(lower.isin("kmeans++", "birch", "mean_shift", "optics", "gmm", "agglomerative"), lower).otherwise("dbscan")
    return requests.where(F.col("payload").isNotNull() & (js_trim("payload") != "")).withColumn("algorithm", name)


def engine_lines(job: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(job_id, row_id, line): every line but empty ones, ``max_rows`` of each job at most."""
    kept = F.slice(F.filter(F.split("payload", "\n", -1), lambda x: x != ""), 1, max_rows)
    return job.select("job_id", F.posexplode(kept).alias("row_id", "line")).withColumn("row_id", F.col("row_id").cast("long"))


def profiler_lines(job: DataFrame) -> DataFrame:
    """(job_id, line_index, line): trimmed lines that aren't blank."""
    kept = F.filter(F.transform(F.split("payload", "\n", -1), js_trim), lambda x: x != "")
    return job.select("job_id", F.posexplode(kept).alias("line_index", "line")).withColumn("line_index", F.col("line_index").cast("long"))


def json_lines(table: DataFrame, index: str, columns: dict, job_id: int = 1) -> DataFrame:
    """A table's rows as JSON lines of one job, ``index`` being their number; nulls are written."""
    body = F.to_json(F.struct(*(c.alias(name) for name, c in columns.items())), {"ignoreNullFields": "false"})
    return table.select(F.lit(job_id).cast("long").alias("job_id"), F.col(index).cast("long").alias("line_index"), body.alias("line"))


#: Rows of a dealt table in one task, about.
TASK_ROWS = 250_000


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A stored table over tasks of about TASK_ROWS rows by the hash of ``keys``, which tell rows apart; one task for each core at least.

    A file's splits say little of where its rows are: those of one row group are one task's. Rows are counted from the files' footers.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, -(-table.count() // TASK_ROWS)), *keys)


def text_payloads(spark: SparkSession, path: str, name: str = "dbscan") -> DataFrame:
    """Each file below ``path`` as one job and one row, for small files; ids follow the file names. ``sources.files`` reads large ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))
    return files.select(F.xxhash64("file").alias("job_id"), F.lit(algorithm(name)).alias("algorithm"), "payload", "file")

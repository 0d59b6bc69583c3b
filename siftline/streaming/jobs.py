"""Jobs: submitting payloads, micro-batches through Structured Streaming, and reading results.

Queues, back-pressure and batch limits are the source's rate limits and the trigger; a batch's jobs are analysed
in one plan and never mix. Results and pages are tables; a job's status is written last.
"""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.config import MAX_BATCH_JOBS, MAX_JOBS, MAX_WAITING, SATURATED, UNSCHEDULED, Config, algorithm
from siftline.operators.report import rendered, report_page, svg_points
from siftline.plans.analysis import Analysis, analyze
from siftline.staging import checkpoint_dir
from siftline.streaming.states import announce

log = logging.getLogger("siftline")

RESULT = "job_id long, algorithm string, status string, error string, cluster_count long, row_count long, dimensions long, mean array<double>, min array<double>, max array<double>, stddev array<double>, entropy double, slope double, outlier_ratio double, trend string, batch_id long, updated_ms long"
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
_KINDS = dict(c.split() for c in RESULT.split(", "))


def _results(found: Analysis, batch_id: int) -> DataFrame:
    done = found.results.withColumns({"batch_id": F.lit(batch_id), "updated_ms": F.unix_millis(F.current_timestamp())})
    return done.select(*(F.col(c).cast(_KINDS[c]).alias(c) for c in _COLUMNS))


def results_of(jobs: DataFrame, config: Config, batch_id: int = 0) -> DataFrame:
    return _results(analyze(jobs, config), batch_id)


def pages_of(found: Analysis, config: Config) -> DataFrame:
    """(job_id, body, svg, html) of an analysis' jobs, failed ones too."""
    drawn = svg_points(found.features, found.labels, found.results.where("status = 'ready'"), found.density, config)
    return rendered(found.results, found.insights, drawn, config)


def stream(payloads: DataFrame, out: str, checkpoint: str, config: Config = Config(), once: bool = False, pages: str | None = None, events: str | None = None) -> StreamingQuery:
    """Analyse a stream of (job_id, algorithm, payload); each batch's results are one folder below ``out``, and its
    charts and report fragments one below ``pages``, where that is given. What happens to its jobs is added to the folder
    ``events``, for ``states.job_states``.

    A batch that is run again replaces its own folders, so results are there once. What a batch staged is removed.
    """

    def told(jobs: DataFrame, *state: str) -> None:
        if events:
            announce(jobs, events, *state)

    def analysed(df: DataFrame, number: int) -> None:
        told(df, "analyzing")
        found = analyze(df, config)
        try:
            if pages:
                told(df, "rendering")
                pages_of(found, config).write.mode("overwrite").parquet(f"{pages}/batch={number}")
            _results(found, number).write.mode("overwrite").parquet(f"{out}/batch={number}")
            told(found.results)
        finally:
            found.close()
        log.info("batch %d is written", number)

    def batch(df: DataFrame, number: int) -> None:
        try:
            analysed(df, number)
        except Exception:
            told(df, "failed", UNSCHEDULED)
            raise

    writer = payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.aggregation_window_ms} milliseconds")).start()


def payload_source(spark: SparkSession, path: str, most: int = MAX_BATCH_JOBS, most_bytes: int | None = None) -> DataFrame:
    """A stream of Parquet files of jobs, ``most`` files in a batch, or files of ``most_bytes`` bytes together."""
    reader = spark.readStream.schema("job_id long, algorithm string, payload string")
    return (reader.option("maxBytesPerTrigger", most_bytes) if most_bytes else reader.option("maxFilesPerTrigger", most)).parquet(path)


def windowed_counts(rows: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: severities counted by event-time window, for streams of rows with ``ts`` and ``severity``."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "severity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


class Engine:
    """Submit payloads and read their status, result and report.

    What a job came to is in tables below ``folder``; the driver keeps each job's state and, while it waits, its
    payload. MAX_WAITING jobs may wait; beyond MAX_JOBS the oldest finished job is forgotten.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), folder: str | None = None):
        self.spark, self.config = spark, config
        self.folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/siftline-engine-{uuid.uuid4().hex}"
        self._next, self._batch, self._open = 1, 0, True
        self._jobs: dict[int, dict] = {}
        log.info("engine is open, results are below %s", self.folder)

    def _set(self, job: int, status: str, error: str = "") -> None:
        self._jobs[job] |= {"status": status, "error": error, "updatedMs": int(time.time() * 1000)}

    def submit(self, payload: str, name: str | None = None) -> int:
        if not self._open:
            raise RuntimeError("the engine is closed")
        if not isinstance(payload, str) or not payload:
            raise ValueError("payload must be a non-empty string")
        job, self._next = self._next, self._next + 1
        waiting = sum("payload" in j for j in self._jobs.values())
        self._jobs[job] = {"algorithm": algorithm(name, self.config.default_algorithm), "updatedMs": 0}
        if waiting < MAX_WAITING:
            self._jobs[job] |= {"payload": payload, "status": "queued", "error": ""}
        else:
            self._set(job, "failed", SATURATED)
        for old in list(self._jobs)[: max(0, len(self._jobs) - MAX_JOBS)]:
            if self._jobs[old]["status"] in ("ready", "failed"):
                del self._jobs[old]
        return job

    def _batches(self) -> Iterator[list[int]]:
        """Waiting jobs in order, MAX_BATCH_JOBS at a time or as many as reach the settings' batch size."""
        some, size = [], 0
        for job in [j for j, x in self._jobs.items() if "payload" in x]:
            some.append(job)
            size += len(self._jobs[job]["payload"].encode())
            if len(some) == MAX_BATCH_JOBS or size >= self.config.min_batch_size_kb * 1024:
                yield some
                some, size = [], 0
        if some:
            yield some

    def run(self) -> None:
        """Analyse what waits."""
        for some in self._batches():
            for job in some:
                self._set(job, "batching")
            rows = [(j, self._jobs[j]["algorithm"], self._jobs[j].pop("payload")) for j in some]
            try:
                self._analyse(some, rows)
            except Exception:
                log.exception("a batch of %d jobs failed", len(some))
                for job in some:
                    self._set(job, "failed", UNSCHEDULED)
            self._batch += 1

    def _analyse(self, some: list[int], rows: list[tuple]) -> None:
        for job in some:
            self._set(job, "analyzing")
        found = analyze(self.spark.createDataFrame(rows, "job_id long, algorithm string, payload string"), self.config)
        try:
            for job in some:
                self._set(job, "rendering")
            at = f"{self.folder}/batch={self._batch}"
            pages_of(found, self.config).write.mode("overwrite").parquet(at)
            for r in self.spark.read.parquet(at).select("job_id", F.get_json_object("body", "$.status").alias("status"), F.get_json_object("body", "$.error").alias("error")).collect():
                self._set(r["job_id"], r["status"], r["error"] or "")
                self._jobs[r["job_id"]]["batch"] = self._batch
        finally:
            found.close()

    def _known(self, job: int | str) -> int:
        number = int(job) if re.fullmatch("[0-9]{1,20}", str(job)) else -1
        if number not in self._jobs or number >= 1 << 64:
            raise KeyError(f"no job {job}")
        return number

    def _read(self, job: int) -> dict | None:
        if "batch" not in self._jobs[job]:
            return None
        r = self.spark.read.parquet(f"{self.folder}/batch={self._jobs[job]['batch']}").where(F.col("job_id") == job).first()
        return json.loads(r["body"]) | {"svg": r["svg"], "html": r["html"]}

    def status(self, job: int | str) -> dict:
        known = self._jobs[self._known(job)]
        return {"jobId": str(job), "status": known["status"], "updatedMs": known["updatedMs"], "error": known["error"]}

    def result(self, job: int | str) -> dict:
        done = self._read(self._known(job))
        keys = ("jobId", "status", "algorithm", "rows", "clusters", "entropy", "trendSlope", "outlierRatio", "html", "svg", "error")
        return {k: done[k] for k in keys} if done else self.status(job)

    def report(self, job: int | str) -> str:
        done = self._read(self._known(job))
        if done is None:
            raise KeyError(f"job {job} has no report")
        return report_page(done, done["insights"], done["svg"])

    def feed(self, job: int | str, wait: float = 0.5) -> Iterator[dict]:
        """Status after status until the job is ready or has failed."""
        while True:
            now = self.status(job)
            yield now
            if now["status"] in ("ready", "failed"):
                return
            time.sleep(wait)

    def info(self) -> str:
        """A page about the engine and how to ask it."""
        calls = "".join(f"<li><code>{c}</code></li>" for c in ("submit(payload, algorithm)", "status(job)", "result(job)", "report(job)", "feed(job)"))
        return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>siftline</title></head><body><h1>siftline</h1><p>{len(self._jobs)} jobs are known.</p><ul>{calls}</ul></body></html>"

    def close(self) -> None:
        """No more jobs are taken, and those that wait are dropped; results stay in their tables."""
        self._open = False
        for job, known in list(self._jobs.items()):
            if known.pop("payload", None) is not None:
                del self._jobs[job]
        log.info("engine is closed")

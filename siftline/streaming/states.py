"""Job states as streaming state: what happened to jobs goes in, each job's state and the registry come out.

Events (job_id, status, error) may come twice and in any order: a state only moves forward, and a job that has failed may
still be ready after a batch was run again. MAX_JOBS slots are the keys, a job's being its id modulo that. Ids are
consecutive, so a slot's next job is the one with which its last becomes the oldest of MAX_JOBS + 1: if it has finished by
then, or when it finishes, it is forgotten. A finished job is also forgotten ``keep`` after its last event, and one of which
nothing was heard for ``patience`` has failed. State lives in RocksDB below the checkpoint, so a restart has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftline.config import MAX_JOBS, STATUSES, UNSCHEDULED

EVENT = "job_id long, status string, error string"
STATE = "job_id long, status string, error string, updated_ms long"
FORGOTTEN = "forgotten"
#: What counts more: a job is ready even if a run before had failed.
ORDER = {s: i for i, s in enumerate((*STATUSES[:4], "failed", "ready"))}
DONE = ("failed", "ready")


def announce(jobs: DataFrame, folder: str, status: str | None = None, error: str = "") -> None:
    """Adds an event for each of ``jobs`` to a folder of events; without ``status`` jobs have their own and their error."""
    own = jobs.select("job_id", F.lit(status), F.lit(error)) if status else jobs.select("job_id", "status", F.coalesce("error", F.lit("")))
    own.toDF("job_id", "status", "error").write.mode("append").parquet(folder)


def events(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """A stream of what ``announce`` wrote, ``files`` files in a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


class Slot(StatefulProcessor):
    """The jobs of one slot: mostly one."""

    def __init__(self, keep_ms: int, patience_ms: int):
        self.keep_ms, self.patience_ms = keep_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id long", "status string, error string, updated_ms long", ttlDurationMs=self.keep_ms)

    def _known(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.jobs.iterator()}

    def _wake(self, known: dict[int, tuple]) -> None:
        """A timer for the job that has waited longest, in place of the slot's former one."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        waiting = [ms for status, _, ms in known.values() if status not in DONE]
        if waiting:
            self.handle.registerTimer(min(waiting) + self.patience_ms)

    def _written(self, changes: dict[int, tuple], known: dict[int, tuple], now: int) -> Iterator[pd.DataFrame]:
        for job, state in changes.items():
            self.jobs.updateValue((job,), state)
        known |= changes
        newest, gone = max(known, default=0), []
        for job in [j for j, (status, _, _) in known.items() if j < newest and status in DONE]:
            self.jobs.removeKey((job,))
            del known[job]
            gone.append((job, FORGOTTEN, "", now))
        self._wake(known)
        rows = [(job, *state) for job, state in sorted(changes.items())] + sorted(gone)
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "status", "error", "updated_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, known, changes = timerValues.getCurrentProcessingTimeInMs(), self._known(), {}
        # an event of a job that the slot has passed says nothing new
        newest = max(known, default=0)
        for part in rows:
            for job, status, error in zip(part["job_id"], part["status"], part["error"], strict=True):
                before = changes.get(job) or known.get(job)
                if ORDER[status] > (ORDER[before[0]] if before else -1) and (before or job >= newest or status not in DONE):
                    changes[int(job)] = status, error or "", now
        yield from self._written(changes, known, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, known = timerValues.getCurrentProcessingTimeInMs(), self._known()
        late = {j: ("failed", UNSCHEDULED, now) for j, (status, _, ms) in known.items() if status not in DONE and ms + self.patience_ms <= now}
        yield from self._written(late, known, now)


def job_states(happened: DataFrame, keep_ms: int = 86_400_000, patience_ms: int = 600_000, slots: int = MAX_JOBS) -> DataFrame:
    """(job_id, status, error, updated_ms): each change of a job's state, of a stream of events; ``forgotten`` is the last one.
    Events without a job, or with an unknown status, are passed over."""
    sound = happened.where(F.col("job_id").isNotNull() & F.col("status").isin(*STATUSES))
    keyed = sound.select(F.pmod("job_id", F.lit(slots)).alias("slot"), "job_id", "status", "error").groupBy("slot")
    return keyed.transformWithStateInPandas(Slot(keep_ms, patience_ms), outputStructType=STATE, outputMode="Append", timeMode="ProcessingTime")


def kept(states: DataFrame, out: str, checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """The changes written below ``out``, each once; a restart goes on from ``checkpoint``. ``once`` is one batch of all that is
    there: with timers by the clock a stream that ends by itself when nothing is left to do would not end."""
    writer = states.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start(out)


def registry(changes: DataFrame, keep_ms: int = 86_400_000, now_ms: int | None = None) -> DataFrame:
    """(job_id, status, error, updated_ms): the jobs that are known, of a table of changes."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for s in ORDER for x in (s, ORDER[s]))), F.col("status")), F.lit(len(ORDER)))
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("status", "error", "updated_ms"), F.struct(rank, "updated_ms")).alias("s")).select("job_id", "s.*")
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    return last.where((F.col("status") != FORGOTTEN) & ((F.col("updated_ms") + keep_ms > now) | ~F.col("status").isin(*DONE)))

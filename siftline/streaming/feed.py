"""A feed that Spark pushes: batches as a listener hears of them, jobs as their states change. Nothing is polled."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Feed(StreamingQueryListener):
    """Events of all of a session's streams as dictionaries; ``kind`` is started, batch, idle, ended or job.
    A batch's ``read`` counts a row as often as its plans read it.

    At most ``most`` events wait for a reader; then the oldest go and are counted in ``lost``. A ``with`` block adds the
    listener and removes it.
    """

    def __init__(self, spark: SparkSession, most: int = 4096):
        self.spark, self.lost = spark, 0
        self._waiting: deque[dict] = deque(maxlen=most)
        self._told = threading.Condition()

    def __enter__(self) -> Feed:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.spark.streams.removeListener(self)

    def push(self, event: dict) -> None:
        with self._told:
            self.lost += len(self._waiting) == self._waiting.maxlen
            self._waiting.append(event)
            self._told.notify_all()

    def onQueryStarted(self, event) -> None:
        self.push({"kind": "started", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.push({"kind": "batch", "query": str(p.id), "batch": p.batchId, "read": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        self.push({"kind": "idle", "query": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.push({"kind": "ended", "query": str(event.id), "error": event.exception or ""})

    def jobs(self, changes: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Pushes a stream of state changes (job_id, status, error, updated_ms), row by row as the driver receives them."""

        def tell(df: DataFrame, number: int) -> None:
            for r in df.toLocalIterator():
                self.push({"kind": "job", "job": r["job_id"], "status": r["status"], "error": r["error"], "updatedMs": r["updated_ms"]})

        writer = changes.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def read(self, wait: float = 1.0) -> Iterator[dict]:
        """Events in the order in which they came, until none has come for ``wait`` seconds."""
        while True:
            with self._told:
                if not self._told.wait_for(lambda: self._waiting, timeout=wait):
                    return
                event = self._waiting.popleft()
            yield event

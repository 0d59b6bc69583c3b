"""Waiting jobs as a stream whose batches close by jobs, by bytes, or when a window ends.

Jobs wait in a spool, a folder of Parquet files (job_id, algorithm, payload, bytes) in which ids are consecutive from 1 on.
An offset is the id of the last job taken. The driver reads ids and sizes only, a row group at a time; payloads are read by
the tasks, file by file. Spark moves a write's files one after another, so admission stops before a missing id until it is there.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftline.config import MAX_BATCH_JOBS, Config

JOBS = "job_id long, algorithm string, payload string"


def spool(jobs: DataFrame, folder: str) -> None:
    """Adds jobs (job_id, algorithm, payload) to a spool; ids go on where the spool's end. A null payload has no bytes."""
    width = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = jobs.select(F.col("job_id").cast("long"), "algorithm", "payload", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("bytes"))
    sized.repartitionByRange(width, "job_id").sortWithinPartitions("job_id").write.mode("append").parquet(folder)


def admitted(spark: SparkSession, folder: str, config: Config = Config(), most: int = MAX_BATCH_JOBS, keep: bool = True, batches: int = 1) -> DataFrame:
    """A stream of a spool's jobs (job_id, algorithm, payload). A batch has ``most`` jobs, or as many as reach the settings'
    batch size, or what came within the settings' window after its first job. Without ``keep``, files go when all their jobs
    are in finished batches. With ``batches`` over 1, Spark takes as many closed batches at once, and a job has its batch's
    number, from 0 on, as ``batch``: each of Spark's own batches costs time, however small."""
    spark.dataSource.register(Spool)
    reader = spark.readStream.format("siftline_spool").option("path", folder).option("jobs", str(most)).option("keep", str(keep)).option("batches", str(batches))
    return reader.option("bytes", str(config.min_batch_size_kb * 1024)).option("windowMs", str(config.aggregation_window_ms)).load()


@dataclass
class Piece(InputPartition):
    """Jobs after ``start`` up to ``end``, in one file; no file where none has them. ``ends`` has the last jobs of batches, of
    which the first is number ``first``, where jobs are to have theirs."""

    start: int
    end: int
    path: str | None
    first: int = 0
    ends: tuple[int, ...] | None = None


class Spool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siftline_spool"

    def schema(self) -> str:
        return JOBS + ", batch long" if int(self.options.get("batches", 1)) > 1 else JOBS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolReader(self.options)


class SpoolReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.folder or not self.folder.startswith("/"):
            raise ValueError("a spool is an absolute path that the driver and all executors share")
        self.most, self.bytes = int(options.get("jobs", MAX_BATCH_JOBS)), int(options.get("bytes", 65536))
        self.window, self.keep = int(options.get("windowMs", 20)) / 1000, options.get("keep", "True").lower() == "true"
        self.batches = int(options.get("batches", 1))
        #: The last offset: its last job and, where Spark takes several batches, how many there were and the last jobs of those it took.
        self.last: dict | None = None
        #: First and last id by file, and of the row group read last its first id and its jobs' bytes.
        self.files: dict[str, tuple[int, int]] = {}
        self.group: tuple[str, int, list[int]] = ("", 0, [])

    def initialOffset(self) -> dict:
        return {"job": 0} if self.batches == 1 else {"job": 0, "batch": 0, "ends": []}

    def _scan(self) -> list[tuple[int, int, str]]:
        """(first, last, path) of the files, in order; files that are being written have other names."""
        names = {f"{self.folder}/{n}" for n in (os.listdir(self.folder) if os.path.isdir(self.folder) else []) if n.endswith(".parquet") and n[0] not in "._"}
        self.files = {p: ids for p, ids in self.files.items() if p in names}
        for path in names - self.files.keys():
            meta = pq.read_metadata(path)
            if meta.num_rows:
                ids = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
                first, last = min(s.min for s in ids), max(s.max for s in ids)
                if last - first + 1 != meta.num_rows:
                    raise ValueError(f"ids in {path} are not consecutive")
                self.files[path] = first, last
        found = sorted((a, b, p) for p, (a, b) in self.files.items())
        for (_, before, one), (first, _, other) in zip(found, found[1:], strict=False):
            if first <= before:
                raise ValueError(f"{one} and {other} both have job {first}")
        return found

    def _bytes(self, job: int, path: str) -> int:
        held, first, sizes = self.group
        if held != path or not first <= job < first + len(sizes):
            with pq.ParquetFile(path) as f:
                at = next(i for i in range(f.num_row_groups) if f.metadata.row_group(i).column(0).statistics.max >= job)
                first = f.metadata.row_group(at).column(0).statistics.min
                sizes = f.read_row_group(at, ["bytes"]).column(0).to_pylist()
            self.group = path, first, sizes
        return sizes[job - first]

    def _taken(self, end: int, size: int, count: int) -> tuple[int, int, int]:
        """The batch after it took what waits: its last job, its bytes and its number of jobs."""
        for first, last, path in self._scan():
            if last <= end:
                continue
            if first > end + 1:
                break
            while end < last and count < self.most and size < self.bytes:
                end, count = end + 1, count + 1
                size += self._bytes(end, path)
        return end, size, count

    def latestOffset(self) -> dict:
        if self.last is None:
            self.last = self.initialOffset()
        end, ends = self.last["job"], []
        while len(ends) < self.batches:
            last, size, count = self._taken(end, 0, 0)
            closes = time.monotonic() + self.window
            # what isn't full waits for its window alone
            while not ends and count and count < self.most and size < self.bytes and (left := closes - time.monotonic()) > 0:
                time.sleep(min(left, 0.01))
                last, size, count = self._taken(last, size, count)
            full = count >= self.most or size >= self.bytes
            if count and (full or not ends):
                end = last
                ends.append(end)
            if not full:
                break
        if ends:
            self.last = {"job": end} if self.batches == 1 else {"job": end, "batch": self.last["batch"] + len(ends), "ends": ends}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # after a restart Spark plans the last batch of its log first: that is where admission goes on
        if self.last is None or self.last["job"] < end["job"]:
            self.last = end
        of = (end["batch"] - len(end["ends"]), tuple(end["ends"])) if self.batches > 1 else ()
        pieces, at = [], start["job"]
        for first, last, path in self._scan():
            if at < end["job"] and first <= at + 1 <= last:
                pieces.append(Piece(at, min(last, end["job"]), path, *of))
                at = pieces[-1].end
        return pieces if at == end["job"] else [*pieces, Piece(at, end["job"], None)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            raise FileNotFoundError(f"no file has the jobs after {partition.start} up to {partition.end}")
        columns = ["job_id", "algorithm", "payload"]
        some = [("job_id", ">", partition.start), ("job_id", "<=", partition.end)]
        table = pq.read_table(partition.path, columns=columns, filters=some, partitioning=None)
        if partition.ends is not None:
            number = np.searchsorted(np.array(partition.ends), table.column("job_id").to_numpy()) + partition.first
            table = table.append_column("batch", pa.array(number, pa.int64()))
        yield from table.to_batches(max_chunksize=64)

    def commit(self, end: dict) -> None:
        if not self.keep:
            for _, last, path in self._scan():
                if last <= end["job"]:
                    os.remove(path)

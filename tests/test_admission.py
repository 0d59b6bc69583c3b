"""Admission by jobs, bytes and the window, exactly once over restarts; job states as streaming state."""

import time

import pytest

from siftline.config import UNSCHEDULED, Config
from siftline.sources.admission import SpoolReader, admitted, spool
from siftline.streaming.feed import Feed
from siftline.streaming.jobs import stream
from siftline.streaming.states import FORGOTTEN, STATE, announce, events, job_states, kept, registry

JOBS = "job_id long, algorithm string, payload string"


def waiting(spark, folder, first, sizes):
    spool(spark.createDataFrame([(i, "dbscan", "x" * n) for i, n in enumerate(sizes, first)], JOBS), folder)


def batches(spark, folder, config=Config(), checkpoint="cp", **more):
    """The jobs of each batch until nothing waits."""
    seen = {}
    jobs = admitted(spark, f"{folder}/in", config, **more)
    q = jobs.writeStream.foreachBatch(lambda df, n: seen.update({n: sorted(r["job_id"] for r in df.collect())})).option("checkpointLocation", f"{folder}/{checkpoint}").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [seen[n] for n in sorted(seen) if seen[n]]


def offsets(folder, **options):
    reader, ends = SpoolReader({"path": str(folder)} | options), [0]
    while (end := reader.latestOffset()["job"]) > ends[-1]:
        ends.append(end)
    return ends


def test_jobs_and_bytes_close_batches(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [10] * 5 + [60_000, 10_000, 70_000, 1])
    assert offsets(f"{tmp_path}/in", jobs="3") == [0, 3, 6, 8, 9]
    assert offsets(f"{tmp_path}/in") == [0, 7, 8, 9]
    assert batches(spark, tmp_path, most=3) == [[1, 2, 3], [4, 5, 6], [7, 8], [9]]
    assert batches(spark, tmp_path, checkpoint="cp2") == [[1, 2, 3, 4, 5, 6, 7], [8], [9]]


def test_spark_takes_several_batches_at_once(spark, tmp_path):
    """Jobs have the batches they would have one by one, over a restart; few of Spark's own batches are needed."""
    waiting(spark, f"{tmp_path}/in", 1, [10] * 5 + [60_000, 10_000, 70_000, 1])
    took = []

    def run_all():
        jobs = admitted(spark, f"{tmp_path}/in", most=3, batches=4)
        q = jobs.writeStream.foreachBatch(lambda df, n: took.append([(r["batch"], r["job_id"]) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [sorted(t) for t in took if t]

    first = [[(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (2, 7), (2, 8)], [(3, 9)]]
    assert run_all() == first
    waiting(spark, f"{tmp_path}/in", 10, [1] * 4)
    assert run_all() == [*first, [(4, 10), (4, 11), (4, 12)], [(5, 13)]]


def test_the_window_closes_a_batch(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [1, 1])
    reader, began = SpoolReader({"path": f"{tmp_path}/in", "windowMs": "300"}), time.monotonic()
    assert reader.latestOffset() == {"job": 2} and time.monotonic() - began >= 0.3
    began = time.monotonic()
    assert reader.latestOffset() == {"job": 2} and time.monotonic() - began < 0.2


def test_a_restart_takes_each_job_once(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [1] * 5)
    assert batches(spark, tmp_path, most=4) == [[1, 2, 3, 4], [5]]
    waiting(spark, f"{tmp_path}/in", 6, [1] * 3)
    assert batches(spark, tmp_path, most=4) == [[6, 7, 8]]


def test_a_failed_batch_comes_again_as_it_was(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [1] * 3)

    def fail(df, n):
        df.count()
        raise OSError("lost")

    q = admitted(spark, f"{tmp_path}/in").writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/cp").start()
    with pytest.raises(Exception, match="lost"):
        q.processAllAvailable()
    waiting(spark, f"{tmp_path}/in", 4, [1] * 2)
    assert batches(spark, tmp_path) == [[1, 2, 3], [4, 5]]


def test_admission_waits_for_a_missing_job_and_refuses_two(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [1])
    waiting(spark, f"{tmp_path}/in", 3, [1])
    assert offsets(f"{tmp_path}/in") == [0, 1]
    waiting(spark, f"{tmp_path}/in", 2, [1])
    assert offsets(f"{tmp_path}/in") == [0, 3]
    waiting(spark, f"{tmp_path}/in", 2, [1])
    with pytest.raises(ValueError, match="both have job 2"):
        offsets(f"{tmp_path}/in")
    assert offsets(f"{tmp_path}/none") == [0]


def test_consumed_files_go_where_they_are_not_kept(spark, tmp_path):
    waiting(spark, f"{tmp_path}/in", 1, [1] * 2)
    assert batches(spark, tmp_path, keep=False) == [[1, 2]]
    waiting(spark, f"{tmp_path}/in", 3, [1] * 2)
    assert batches(spark, tmp_path, keep=False) == [[3, 4]]
    waiting(spark, f"{tmp_path}/in", 5, [1])
    assert batches(spark, tmp_path, keep=False) == [[5]]
    assert [a for a, _, _ in SpoolReader({"path": f"{tmp_path}/in"})._scan()] == [5]


def run(spark, folder, *rows, once=True, out="out", **more):
    announce(spark.createDataFrame(list(rows), "job_id long, status string, error string"), f"{folder}/events")
    q = kept(job_states(events(spark, f"{folder}/events"), **more), f"{folder}/{out}", f"{folder}/cp", once=once)
    if once:
        q.awaitTermination()
    return q


def known(spark, folder, out="out", **more):
    return sorted((r["job_id"], r["status"], r["error"]) for r in registry(spark.read.parquet(f"{folder}/{out}"), **more).collect())


def test_states_move_forward_and_outlive_a_restart(spark, tmp_path):
    run(spark, tmp_path, (1, "queued", ""), (2, "analyzing", ""), (2, "queued", ""), (3, "failed", "lost"), (None, "queued", ""), (4, "unheard", ""))
    assert known(spark, tmp_path) == [(1, "queued", ""), (2, "analyzing", ""), (3, "failed", "lost")]
    run(spark, tmp_path, (1, "batching", ""), (2, "batching", ""), (2, "ready", ""), (2, "failed", "again"), (3, "ready", ""))
    assert known(spark, tmp_path) == [(1, "batching", ""), (2, "ready", ""), (3, "ready", "")]
    changes = [(r["job_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert (2, "batching") not in changes and changes.count((2, "ready")) == 1


def test_a_slot_forgets_its_finished_job_when_the_next_comes(spark, tmp_path):
    run(spark, tmp_path, (1, "ready", ""), (2, "queued", ""), slots=4)
    run(spark, tmp_path, (5, "queued", ""), (6, "queued", ""), slots=4)
    assert known(spark, tmp_path) == [(2, "queued", ""), (5, "queued", ""), (6, "queued", "")]
    run(spark, tmp_path, (2, "ready", ""), (1, "ready", ""), slots=4)
    assert known(spark, tmp_path) == [(5, "queued", ""), (6, "queued", "")]
    assert {(r["job_id"]) for r in spark.read.parquet(f"{tmp_path}/out").where(f"status = '{FORGOTTEN}'").collect()} == {1, 2}


def test_silent_jobs_fail_and_old_ones_are_forgotten(spark, tmp_path):
    q = run(spark, tmp_path, (1, "batching", ""), (2, "ready", ""), once=False, patience_ms=1000)
    try:
        end = time.monotonic() + 60
        while time.monotonic() < end and (1, "failed", UNSCHEDULED) not in (known(spark, tmp_path) if q.recentProgress else []):
            time.sleep(0.5)
    finally:
        q.stop()
    assert known(spark, tmp_path) == [(1, "failed", UNSCHEDULED), (2, "ready", "")]
    assert known(spark, tmp_path, keep_ms=1000, now_ms=int(time.time() * 1000) + 2000) == []


def test_a_streams_jobs_go_from_admission_to_the_feed(spark, tmp_path):
    spool(spark.createDataFrame([(1, "kmeans++", "a=1\na=2"), (2, "dbscan", "\n"), (3, "dbscan", "b=5")], JOBS), f"{tmp_path}/in")
    with Feed(spark) as feed:
        q = stream(admitted(spark, f"{tmp_path}/in", most=2), f"{tmp_path}/out", f"{tmp_path}/stream", events=f"{tmp_path}/events")
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        run(spark, tmp_path, (4, "queued", ""), out="states")
        assert known(spark, tmp_path, out="states") == [(1, "ready", ""), (2, "failed", "no analyzable rows found"), (3, "ready", ""), (4, "queued", "")]
        feed.jobs(spark.readStream.schema(STATE).parquet(f"{tmp_path}/states"), f"{tmp_path}/told").awaitTermination()
        seen = list(feed.read(wait=2))
    assert {(e["job"], e["status"]) for e in seen if e["kind"] == "job"} >= {(1, "ready"), (2, "failed"), (3, "ready"), (4, "queued")}
    assert [e["batch"] for e in seen if e["kind"] == "batch" and e["query"] == str(q.id) and e["read"]] == [0, 1]
    assert [e["kind"] for e in seen if e["kind"] != "job" and e["query"] == str(q.id)][-1] == "ended"
    assert feed.lost == 0


def test_a_full_feed_loses_its_oldest_and_counts_them(spark):
    feed = Feed(spark, most=2)
    for i in range(5):
        feed.push({"kind": "job", "job": i})
    assert [e["job"] for e in feed.read(wait=0)] == [3, 4] and feed.lost == 3

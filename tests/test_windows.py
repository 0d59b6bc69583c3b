"""Event-time streams: late rows dropped and counted, repeated ones once, restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.streaming.windows import late_rows, session_counts, sliding_counts, unique_rows, written

BEGIN = datetime(2024, 1, 1)


def arrived(spark, folder, *batches):
    """Each batch of (minute, id) as a file, after those before."""
    for rows in batches:
        made = spark.createDataFrame([(BEGIN + timedelta(minutes=m), i, "INFO", "api") for m, i in rows], "ts timestamp, id long, severity string, entity string")
        made.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("ts timestamp, id long, severity string, entity string").option("maxFilesPerTrigger", 1).parquet(folder)


def minutes(rows, *more):
    return sorted(((r["start"] - BEGIN).total_seconds() / 60, (r["end"] - BEGIN).total_seconds() / 60, *(r[c] for c in more)) for r in rows)


def test_sliding_windows_drop_and_count_late_rows(spark, tmp_path):
    rows = arrived(spark, f"{tmp_path}/in", [(1, 1), (7, 2), (7, 2)], [(60, 3), (7, 2)], [(61, 8)], [(2, 4), (3, 5), (55, 6)], [(120, 7)])
    q = written(sliding_counts(rows, "10 minutes", "5 minutes", "10 minutes", ["id"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = minutes(spark.read.parquet(f"{tmp_path}/out").collect(), "n")
    assert got == [(-5, 5, 1), (0, 10, 2), (5, 15, 1), (50, 60, 1), (55, 65, 3), (60, 70, 2)]
    assert late_rows(q) == 2


def test_a_restart_goes_on_with_its_windows(spark, tmp_path):
    first = arrived(spark, f"{tmp_path}/in", [(1, 1), (6, 2)])
    written(sliding_counts(first, "10 minutes", "10 minutes", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.schema("n long").parquet(f"{tmp_path}/out").count() == 0
    more = arrived(spark, f"{tmp_path}/in", [(9, 3)], [(40, 4)])
    written(sliding_counts(more, "10 minutes", "10 minutes", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert minutes(spark.read.parquet(f"{tmp_path}/out").collect(), "n") == [(0, 10, 3)]


def test_sessions_end_by_their_gap(spark, tmp_path):
    rows = arrived(spark, f"{tmp_path}/in", [(1, 1), (4, 2), (9, 3)], [(20, 4)], [(90, 5)])
    written(session_counts(rows, "6 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert minutes(spark.read.parquet(f"{tmp_path}/out").collect(), "n") == [(1, 15, 3), (20, 26, 1)]


def test_tables_give_the_same_rows(spark):
    rows = spark.createDataFrame([(BEGIN + timedelta(minutes=m), i, "INFO", "api") for m, i in ((1, 1), (1, 1), (7, 2))], "ts timestamp, id long, severity string, entity string")
    assert unique_rows(rows, ["id"]).count() == 2
    assert minutes(sliding_counts(rows, "10 minutes", "10 minutes", keys=["id"]).collect(), "n") == [(0, 10, 2)]
    assert minutes(session_counts(rows, "3 minutes").collect(), "n") == [(1, 4, 2), (7, 10, 1)]
    assert rows.where(F.col("id") > 5).count() == sliding_counts(rows.where("id > 5"), "10 minutes", "5 minutes").count() == 0

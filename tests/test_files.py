"""Files of many splits as numbered lines."""

import random

from pyspark.sql import functions as F

from siftline.sources.files import engine_file_lines, file_jobs, profiler_file_lines, split_lines
from siftline.sources.lines import engine_lines, profiler_lines, text_payloads


def written(folder, n=3):
    r = random.Random(4)
    folder.mkdir()
    for k in range(n):
        lines = [r.choice(["", "  ", "\t", "x\r", f" a={r.random()} é ", "y" * r.randint(0, 400), "\u3000"]) for _ in range(900 * k)]
        (folder / f"part {k}.log").write_bytes("\n".join(lines).encode() + (b"" if k == 1 else b"\n"))
    (folder / "long.log").write_bytes(b"z" * 9000 + b"\nend")
    (folder / "none.log").write_bytes(b"\n\n")


def test_splits_number_lines_as_whole_files_do(spark, tmp_path):
    written(tmp_path / "in")
    path, sizes = str(tmp_path / "in"), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    whole = text_payloads(spark, path)
    want = {name: {tuple(r) for r in view(whole).withColumnRenamed(number, "n").select("job_id", "n", "line").collect()} for name, view, number in (("engine", engine_lines, "row_id"), ("profiler", profiler_lines, "line_index"))}
    for size in ("1000", "40000", "128m"):
        for key in sizes:
            spark.conf.set(key, size)
        try:
            many = split_lines(spark, path).select("file", "block").distinct().count()
            # input_file_name and _metadata write a path alike but for blanks
            named = whole.select("job_id", F.url_decode(F.regexp_extract("file", "([^/]*)$", 1)).alias("name"))
            for name, view, number in (("engine", engine_file_lines, "row_id"), ("profiler", profiler_file_lines, "line_index")):
                got = view(spark, path).withColumn("name", F.url_decode(F.regexp_extract("file", "([^/]*)$", 1))).drop("job_id").join(named, "name")
                assert sorted((r["job_id"], r[number], r["line"]) for r in got.collect()) == sorted(want[name])
            assert engine_file_lines(spark, path, 5).groupBy("file").count().where("count > 5").count() == 0
            assert many > 100 if size == "1000" else many >= 4
        finally:
            for key in sizes:
                spark.conf.unset(key)
    assert {r["file"].rsplit("/", 1)[1] for r in file_jobs(engine_file_lines(spark, path), "KMEANS").collect()} == {"part%201.log", "part%202.log", "long.log"}


def test_lines_of_files_are_not_shuffled(spark, tmp_path):
    written(tmp_path / "in")
    plan = engine_file_lines(spark, str(tmp_path / "in"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan

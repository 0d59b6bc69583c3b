"""What a task holds doesn't grow with the table: no grouping sorts all rows, and tables are dealt by their rows."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import profile as p
from siftline.operators.charts import line_columns
from siftline.operators.fields import fields, parsed, rows
from siftline.sources import lines


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("growth") / "parsed")
    line = F.concat(F.lit('{"level":"'), F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.lit('","svc":"'), F.when(F.col("id") % 3 == 0, "unknown").otherwise("s"), F.lit('","v":'), F.col("id") % 7, F.lit("}"))
    parsed(spark.range(200).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("line_index"), line.alias("line"))).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groupings_of_all_fields_do_not_sort(read):
    long = fields(read)
    points = long.where("key = 'v'").select("job_id", "key", F.lit("c").alias("color"), "line_index", F.col("num").alias("value"))
    for df in (p.key_counts(long), p.field_coverage(long), p.category(long, rows(read)), p.entity_key(long), line_columns(points, 10)):
        assert "SortAggregate" not in plan(df)


def test_first_seen_is_the_first_line_and_field(spark):
    rows_ = [(1, i, at, k, "number", 1.0) for k, i, at in (("a", 5, 2), ("a", 5, 1), ("b", 5, 0), ("c", 2**62, 3), ("d", 7, 0))]
    df = spark.createDataFrame(rows_, "job_id long, line_index long, field_pos int, key string, type string, num double")
    got = p.field_coverage(df).orderBy("pos").collect()
    assert [r["label"] for r in got] == ["a", "b", "d", "c"]


def test_line_columns_ties_go_to_the_earlier_point(spark):
    points = [(1, "k", "c", i, v) for i, v in ((0, 3.0), (1, 1.0), (2, 9.0), (3, 1.0), (4, 9.0), (5, 4.0))]
    df = spark.createDataFrame(points, "job_id long, key string, color string, line_index long, value double")
    got = {(r["line_index"], r["value"]) for r in line_columns(df, 1).collect()}
    assert got == {(0, 3.0), (5, 4.0), (1, 1.0), (2, 9.0)}


def test_entities_are_computed_once(read):
    found = p.entity_histogram(rows(read))
    assert plan(found).count("pod,container]") == 1
    assert [(r["pos"], r["label"], r["value"]) for r in found.collect()] == [(1, "s", 133)]


def test_later_category_histograms_are_made_only_where_needed(spark):
    """A job with severities needs no other histogram; a job without goes on to the next one."""
    from siftline.plans.analysis import Profile

    jobs_ = spark.createDataFrame([(1,), (1,), (2,)], "job_id long")
    bars = lambda *rows_: lambda: spark.createDataFrame(list(rows_), "job_id long, label string, value long")
    got = p.category_histogram(jobs_, bars((1, "a", 2)), bars((1, "b", 1), (2, "c", 1)), lambda: pytest.fail("not needed"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 2), (2, "c", 1)]
    profile = Profile(spark.createDataFrame([(1, 0, '{"level":"warn","v":1}')], "job_id long, line_index long, line string"))
    assert [(r["label"], r["value"]) for r in profile.category_histogram.collect()] == [("WARN", 1)]
    assert not {"entity", "low_cardinality", "schemas", "key_counts", "format_coverage"} & profile.__dict__.keys()


def test_dealt_by_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    monkeypatch.setattr(lines, "TASK_ROWS", 50)
    got = lines.dealt(spark.read.parquet(path), "id")
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert got.rdd.getNumPartitions() == 20 and sum(sizes) == 1000 and max(sizes) < 100

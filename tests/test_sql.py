"""SQL functions give what the library's columns give."""

from pyspark.sql import functions as F

from siftline.functions.numbers import fnv1a64, line_hash_feature
from siftline.functions.parsing import json_fields
from siftline.functions.sql import register

LINES = ['{"a":1,"b":{"c":"x","d":[1,2]},"e":null,"a":2}', "{}", "plain a=1", "", None, '{"k":true} {"k":1}', '{"u":"é","n":-1.5e3}']


def test_sql_functions_equal_columns(spark):
    register(spark)
    register(spark)
    lines = spark.createDataFrame(list(enumerate(LINES)), "i long, line string")
    got = spark.sql("SELECT i, json_fields(line) AS f, fnv1a64(line) AS h, line_hash(line) AS x FROM {t} ORDER BY i", t=lines).collect()
    assert got == lines.select("i", json_fields("line").alias("f"), fnv1a64("line").alias("h"), line_hash_feature("line").alias("x")).orderBy("i").collect()
    rows = spark.sql("SELECT i, key, num FROM (SELECT i, json_fields(line) AS f FROM {t}), LATERAL inline(f) WHERE key = 'a'", t=lines)
    assert [tuple(r) for r in rows.collect()] == [(0, "a", 2.0)]


def test_json_fields_needs_no_python(spark):
    register(spark)
    plan = spark.sql("SELECT json_fields(line) FROM {t}", t=spark.range(1).select(F.col("id").cast("string").alias("line")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

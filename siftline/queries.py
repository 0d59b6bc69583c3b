"""Queries of the log-analytics operators over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.config import MAX_DIMENSIONS, Config
from siftline.functions.numbers import count_marks, distance_sq, fnv1a64, freeform_numbers, keyed_number
from siftline.staging import checkpoint_dir, run_dir, staged
from siftline.operators import profile as p
from siftline.operators.charts import density_cells, line_columns
from siftline.operators.clustering import cluster, density_bands, spread_kmeans
from siftline.operators.features import feature_vectors
from siftline.operators.fields import fields, parsed, rows
from siftline.operators.insights import insights
from siftline.operators.report import donut_angles, heat_cells, svg_points
from siftline.operators.spread import numbered
from siftline.functions.sql import register
from siftline.operators.summary import balance, cluster_density, cluster_sizes, summary
from siftline.plans.analysis import Profile, analyze, result_json, status_json
from siftline.sources.admission import admitted, spool
from siftline.sources.files import engine_file_lines, profiler_file_lines
from siftline.sources.lines import dealt, engine_lines, json_lines, profiler_lines
from siftline.streaming.jobs import payload_source, stream, windowed_counts
from siftline.streaming.states import announce, events, job_states, kept, registry
from siftline.streaming.windows import late_rows, session_counts, sliding_counts, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The engine's settings in these queries: two keys that the event lines have.
CONFIG = Config(numeric_keys=("value", "props.k", "k"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: plain(f(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Counts as BIGINT and doubles to six decimals, so that two engines agree on them."""
    cast = {"int": lambda c: c.cast("long"), "float": lambda c: F.round(c.cast("double"), 6), "double": lambda c: F.round(c, 6)}
    return df.select(*(cast[t](F.col(f"`{n}`")).alias(n) if t in cast else F.col(f"`{n}`") for n, t in df.dtypes))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines; notes are null for every fourth event."""
    e = F.col
    columns = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "level": e("event_type"),
        "service": F.concat(F.lit("svc"), e("user_id") % 5),
        "user_id": e("user_id"),
        "value": e("value"),
        "ok": e("user_id") % 3 == 0,
        "note": F.when(e("event_id") % 4 != 0, F.concat(F.lit("n"), e("event_id") % 3)),
        "props": F.from_json("props", "k int"),
    }
    return json_lines(dealt(table(spark, d, "events"), "event_id"), "event_id", columns)


def kv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as key-value lines."""
    line = F.format_string("ts=%s level=%s, user=%d ok=%s; hex=0x%s note='a b'", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("event_type"), F.col("user_id"), F.when(F.col("user_id") % 3 == 0, "TRUE").otherwise("false"), F.lower(F.hex(F.col("user_id"))))
    return dealt(table(spark, d, "events"), "event_id").select(F.lit(1).cast("long").alias("job_id"), F.col("event_id").alias("line_index"), line.alias("line"))


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON, key-value and plain lines by turns."""
    both = event_lines(spark, d).join(kv_lines(spark, d).select("line_index", F.col("line").alias("kv")), "line_index")
    turn = F.col("line_index") % 3
    return both.select("job_id", "line_index", F.when(turn == 0, F.col("line")).when(turn == 1, F.col("kv")).otherwise(F.concat(F.lit("event number "), F.col("line_index"))).alias("line"))


_EVENTS = """e AS (
  SELECT event_id AS line_index, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, epoch_us(ts) // 1000 AS ms, event_type AS level, 'svc' || (user_id % 5) AS service,
         user_id, value, user_id % 3 = 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN 'n' || (event_id % 3) END AS note, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k
  FROM events)"""
_LONG = f"""WITH {_EVENTS}, f AS (
  SELECT line_index, 0 AS field_pos, 'timestamp' AS key, 'string' AS type, stamp AS str, NULL::DOUBLE AS num, NULL::BOOLEAN AS b FROM e
  UNION ALL SELECT line_index, 1, 'level', 'string', level, NULL, NULL FROM e
  UNION ALL SELECT line_index, 2, 'service', 'string', service, NULL, NULL FROM e
  UNION ALL SELECT line_index, 3, 'user_id', 'number', NULL, user_id, NULL FROM e
  UNION ALL SELECT line_index, 4, 'value', 'number', NULL, value, NULL FROM e
  UNION ALL SELECT line_index, 5, 'ok', 'boolean', NULL, NULL, ok FROM e
  UNION ALL SELECT line_index, 6, 'note', CASE WHEN note IS NULL THEN 'null' ELSE 'string' END, note, NULL, NULL FROM e
  UNION ALL SELECT line_index, 7, 'props.k', 'number', NULL, k, NULL FROM e)"""


@query(f"WITH {_EVENTS} SELECT 1::BIGINT AS job_id, line_index, stamp AS ts_label, ms::DOUBLE AS ts_ms, upper(level) AS severity, service AS entity, 'json' AS format FROM e")
def row_view(spark, d):
    return rows(parsed(event_lines(spark, d))).select("job_id", "line_index", "ts_label", "ts_ms", "severity", "entity", "format")


@query(_LONG + " SELECT 1::BIGINT AS job_id, line_index, field_pos::BIGINT AS field_pos, key, type, str, round(num, 6) AS num, b AS bool FROM f")
def json_flatten(spark, d):
    return fields(parsed(event_lines(spark, d))).where("key not in ('raw', 'line_index')").select("job_id", "line_index", "field_pos", "key", "type", "str", "num", "bool")


@query(
    f"""WITH {_EVENTS}
  SELECT line_index, 'ts' AS key, 'number' AS type, ms::DOUBLE AS num, NULL AS str FROM e UNION ALL SELECT line_index, 'level', 'string', NULL, level FROM e
  UNION ALL SELECT line_index, 'user', 'number', user_id, NULL FROM e UNION ALL SELECT line_index, 'ok', 'boolean', NULL, NULL FROM e
  UNION ALL SELECT line_index, 'hex', 'number', user_id, NULL FROM e UNION ALL SELECT line_index, 'note', 'string', NULL, 'a b' FROM e"""
)
def kv_coerced(spark, d):
    return fields(parsed(kv_lines(spark, d))).where("key not in ('raw', 'line_index')").select("line_index", "key", "type", "num", "str")


_TURNS = "SELECT count(*) FILTER (event_id % 3 = 0) AS j, count(*) FILTER (event_id % 3 = 1) AS k, count(*) FILTER (event_id % 3 = 2) AS t FROM events"


@query(f"SELECT 1::BIGINT AS job_id, label, value::BIGINT AS value FROM (SELECT unnest(['json', 'kv', 'text']) AS label, unnest([j, k, t]) AS value FROM ({_TURNS}))")
def format_coverage(spark, d):
    return p.format_coverage(rows(parsed(mixed_lines(spark, d)))).drop("pos")


@query(f"SELECT 1::BIGINT AS job_id, (j + k + t)::BIGINT AS n_rows, t::BIGINT AS invalid_rows, 'row index' AS timestamp_key FROM ({_TURNS})")
def line_totals(spark, d):
    return p.totals(rows(parsed(mixed_lines(spark, d))))


@query(
    f"""WITH t AS ({_TURNS}) SELECT 1::BIGINT AS job_id, label, value::BIGINT AS value FROM (SELECT unnest([
    'level | line_index | note | ok | props.k | raw | service | timestamp | user_id | value', 'hex | level | line_index | note | ok | raw | ts | user', 'line_index | message | raw']) AS label, unnest([j, k, t]) AS value FROM t)"""
)
def shape_coverage(spark, d):
    return p.shape_coverage(rows(parsed(mixed_lines(spark, d)))).drop("pos")


@query("SELECT 1::BIGINT AS job_id, upper(event_type) AS label, count(*)::BIGINT AS value FROM events GROUP BY 2")
def severity_histogram(spark, d):
    return p.severity_histogram(rows(parsed(event_lines(spark, d)))).drop("pos")


@query("SELECT 1::BIGINT AS job_id, 'svc' || (user_id % 5) AS label, count(*)::BIGINT AS value FROM events GROUP BY 2")
def entity_histogram(spark, d):
    return p.entity_histogram(rows(parsed(event_lines(spark, d)))).drop("pos")


@query(_LONG + " SELECT 1::BIGINT AS job_id, row_number() OVER (ORDER BY count(*) DESC, min(line_index), min(field_pos))::BIGINT AS pos, key AS label, count(*)::BIGINT AS value FROM f GROUP BY key QUALIFY pos <= 8")
def field_coverage(spark, d):
    return p.field_coverage(fields(parsed(event_lines(spark, d))))


@query(
    _LONG + """ SELECT 1::BIGINT AS job_id, key, count(*)::BIGINT AS present, count(*) FILTER (type = 'null')::BIGINT AS nulls, count(num)::BIGINT AS numbers, count(*) FILTER (type = 'string')::BIGINT AS strings,
  count(b)::BIGINT AS booleans, round(min(num), 6) AS min, round(max(num), 6) AS max, round(avg(num), 6) AS mean, round(stddev_pop(num), 6) AS stddev, count(DISTINCT str)::BIGINT AS distinct_strings FROM f GROUP BY key"""
)
def field_schema(spark, d):
    return p.schemas(fields(parsed(event_lines(spark, d)))).select("job_id", "key", "present", "nulls", "numbers", "strings", "booleans", "min", "max", "mean", "stddev", "distinct_strings")


@query("SELECT 1::BIGINT AS job_id, 1::BIGINT AS pos, 'note' AS label, floor(count(*) FILTER (event_id % 4 = 0) / count(*) * 1000 + 0.5) / 10 AS value FROM events")
def null_ratio(spark, d):
    return Profile(event_lines(spark, d)).null_ratios


#: Keys by how many rows have them, and numeric ones: those with a number in three tenths of the rows.
_KEYS = """, c AS (SELECT key, count(*) AS present, count(num) AS numbers, count(*) FILTER (type = 'string') AS strings, count(b) AS booleans, min(line_index * 100 + field_pos) AS seen FROM f GROUP BY key),
  n AS (SELECT count(*) AS n FROM e), k AS (SELECT key, row_number() OVER (ORDER BY numbers + strings + booleans DESC, seen) - 1 AS rank FROM c, n WHERE numbers >= greatest(1, n * 0.3))"""


@query(_LONG + _KEYS + " SELECT 1::BIGINT AS job_id, key FROM k")
def numeric_keys(spark, d):
    return Profile(event_lines(spark, d)).numeric_keys.select("job_id", "key")


@query(_LONG + " SELECT 1::BIGINT AS job_id, key, str AS label, count(*)::BIGINT AS value FROM f WHERE type = 'string' AND key IN (SELECT key FROM f WHERE type = 'string' GROUP BY key HAVING count(DISTINCT str) BETWEEN 2 AND 12) GROUP BY 2, 3")
def low_cardinality(spark, d):
    return Profile(event_lines(spark, d)).low_cardinality


@query("SELECT 1::BIGINT AS job_id, 'ok' AS key, count(*) FILTER (user_id % 3 = 0)::BIGINT AS true_count, count(*) FILTER (user_id % 3 <> 0)::BIGINT AS false_count FROM events")
def boolean_histogram(spark, d):
    return Profile(event_lines(spark, d)).booleans


@query(_LONG + " SELECT 1::BIGINT AS job_id, key, arg_max(type, n) AS dominant_type, round(sum(n) FILTER (type = 'null') / sum(n) * 100, 6) AS null_rate FROM (SELECT key, type, count(*) AS n FROM f GROUP BY ALL) GROUP BY key")
def stats_grid(spark, d):
    return Profile(event_lines(spark, d)).stats_grid.select("job_id", "key", "dominant_type", F.when(F.col("null_rate") > 0, F.col("null_rate")).alias("null_rate"))


@query(
    _LONG + _KEYS + """, t AS (SELECT key, present, row_number() OVER (ORDER BY present DESC, seen) AS pos FROM c QUALIFY pos <= 8)
  SELECT 1::BIGINT AS job_id, array_to_string(list(key ORDER BY pos) FILTER (present / n >= 0.5)[1:6], ',') AS dominant_keys, arg_min(key, pos) AS primary_key FROM t, n"""
)
def dominant_keys(spark, d):
    return Profile(event_lines(spark, d)).dominant_keys.withColumn("dominant_keys", F.array_join("dominant_keys", ","))


_SEVERITY_KEYS = "['level', 'lvl', 'severity', 'priority', 'log_level']"


@query(_LONG + f" SELECT 1::BIGINT AS job_id, arg_min(key, list_position({_SEVERITY_KEYS}, key)) AS category_key FROM f WHERE type = 'string' AND list_contains({_SEVERITY_KEYS}, key)")
def category_key(spark, d):
    return Profile(event_lines(spark, d)).category


@query("SELECT 1::BIGINT AS job_id, upper(event_type) AS label, count(*)::BIGINT AS value FROM events GROUP BY 2")
def category_histogram(spark, d):
    return Profile(event_lines(spark, d)).category_histogram


def _line_items(spark, d):
    """Line items as JSON lines; discounts are left out where the tax is high, prices where quantities are."""
    item = dealt(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    columns = {"quantity": F.col("l_quantity"), "price": F.when(F.col("l_quantity") < 40, F.col("l_extendedprice")), "discount": F.when(F.col("l_tax") < 0.06, F.col("l_discount")), "tax": F.col("l_tax")}
    return json_lines(item, "id", columns)


_ITEMS = "i AS (SELECT l_quantity AS quantity, CASE WHEN l_quantity < 40 THEN l_extendedprice END AS price, CASE WHEN l_tax < 0.06 THEN l_discount END AS discount, l_tax AS tax FROM lineitem)"
_PAIRS = (("quantity", "price"), ("quantity", "discount"), ("quantity", "tax"), ("price", "discount"), ("price", "tax"), ("discount", "tax"))
_CORR = f"WITH {_ITEMS}, m AS (SELECT avg(quantity) AS quantity, avg(price) AS price, avg(discount) AS discount, avg(tax) AS tax FROM i) " + " UNION ALL ".join(
    f"SELECT least('{x}', '{y}') AS x, greatest('{x}', '{y}') AS y, round(sum((i.{x} - m.{x}) * (i.{y} - m.{y})) / sqrt(sum((i.{x} - m.{x}) ^ 2) * sum((i.{y} - m.{y}) ^ 2)), 6) AS value FROM i, m WHERE i.{x} IS NOT NULL AND i.{y} IS NOT NULL" for x, y in _PAIRS
)


@query(_CORR)
def correlations(spark, d):
    return Profile(_line_items(spark, d)).correlations.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "value")


@query(f"WITH c AS ({_CORR}) SELECT x, y, value FROM c UNION ALL SELECT y, x, value FROM c UNION ALL SELECT k, k, 1.0 FROM (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS k)")
def correlation_heat(spark, d):
    got = Profile(_line_items(spark, d))
    return heat_cells(got.correlations, got.numeric_keys).select("x", "y", "value")


@query(f"WITH c AS ({_CORR}) SELECT x, y FROM c ORDER BY abs(value) DESC LIMIT 3")
def scatter_pairs(spark, d):
    return Profile(_line_items(spark, d)).scatter_pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


@query(_LONG + " SELECT 1::BIGINT AS job_id, key, count(*)::BIGINT AS n_points, round(min(num), 6) AS min, round(max(num), 6) AS max FROM f WHERE type = 'number' GROUP BY key")
def numeric_series(spark, d):
    return p.series_range(Profile(event_lines(spark, d)).series).drop("color")


@query(
    _LONG + _KEYS + """ SELECT 1::BIGINT AS job_id, x.key || ' vs ' || y.key AS key, a.line_index, round(a.num, 6) AS x, round(b.num, 6) AS y
  FROM k x JOIN k y ON x.rank < y.rank JOIN f a ON a.key = x.key JOIN f b ON b.key = y.key AND b.line_index = a.line_index"""
)
def scatter_points(spark, d):
    """Three numeric keys: all three pairs are among the strongest three."""
    return Profile(event_lines(spark, d)).scatter.select("job_id", "key", "line_index", "x", "y")


@query(
    _LONG + """, c AS (SELECT key, line_index, num AS value, (line_index - min(line_index) OVER w) * 100 // (max(line_index) OVER w - min(line_index) OVER w + 1) AS c FROM f WHERE type = 'number' WINDOW w AS (PARTITION BY key)),
  r AS (SELECT key, c, unnest([arg_min({'i': line_index, 'v': value}, line_index), arg_max({'i': line_index, 'v': value}, line_index), arg_min({'i': line_index, 'v': value}, {'v': value, 'i': line_index}), arg_min({'i': line_index, 'v': value}, {'v': -value, 'i': line_index})]) AS p FROM c GROUP BY key, c)
  SELECT DISTINCT 1::BIGINT AS job_id, key, c::BIGINT AS "column", p.i AS line_index, round(p.v, 6) AS value FROM r"""
)
def series_columns(spark, d):
    """Lines of a hundred columns."""
    return line_columns(Profile(event_lines(spark, d)).series, 100).drop("color")


@query(
    _LONG + _KEYS + """, s AS (SELECT x.key || ' vs ' || y.key AS key, a.num AS x, b.num AS y FROM k x JOIN k y ON x.rank < y.rank JOIN f a ON a.key = x.key JOIN f b ON b.key = y.key AND b.line_index = a.line_index),
  g AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM s WINDOW w AS (PARTITION BY key))
  SELECT 1::BIGINT AS job_id, key, least(139, floor((x - lx) * 140 / (hx - lx)))::BIGINT AS cx, least(54, floor((y - ly) * 55 / (hy - ly)))::BIGINT AS cy, count(*)::BIGINT AS n FROM g GROUP BY ALL"""
)
def scatter_cells(spark, d):
    return density_cells(Profile(event_lines(spark, d)).scatter).drop("color")


@query("SELECT 1::BIGINT AS job_id, 'text length' AS key, conv_id * 1000 + turn AS line_index, len(text)::BIGINT AS value FROM conversations")
def text_lengths(spark, d):
    turns = dealt(table(spark, d, "conversations"), "conv_id", "turn").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return Profile(json_lines(turns, "id", {"role": F.col("role"), "text": F.col("text")})).text_lengths.where("key = 'text length'").select("job_id", "key", "line_index", "value")


@query("SELECT 1::BIGINT AS job_id, 'segment' AS key, c_mktsegment AS label, count(*)::BIGINT AS value FROM customer GROUP BY 3")
def donut_values(spark, d):
    return Profile(json_lines(table(spark, d, "customer"), "c_custkey", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})).donuts


@query(
    """WITH c AS (SELECT c_mktsegment AS label, count(*)::BIGINT AS value FROM customer GROUP BY 1)
  SELECT label, value, round((sum(value) OVER (ORDER BY value DESC, label) - value) / sum(value) OVER () * 2 * pi(), 6) AS start, round(sum(value) OVER (ORDER BY value DESC, label) / sum(value) OVER () * 2 * pi(), 6) AS "end" FROM c"""
)
def donut_arcs(spark, d):
    lines = json_lines(table(spark, d, "customer"), "c_custkey", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return donut_angles(Profile(lines).donuts).select("label", "value", "start", "end")


@query(
    _LONG + _KEYS + """, d AS (SELECT f.line_index, k.key, k.rank, f.num - avg(f.num) OVER (PARTITION BY f.key) AS d FROM f JOIN k USING (key) WHERE f.num IS NOT NULL),
  p AS (SELECT a.key AS x, b.key AS y FROM d a JOIN d b ON a.line_index = b.line_index AND a.rank < b.rank GROUP BY ALL HAVING count(*) > 1 AND sum(a.d ^ 2) > 0 AND sum(b.d ^ 2) > 0)
  SELECT 1::BIGINT AS job_id, n::BIGINT AS rows, (SELECT count(*) FROM c)::BIGINT AS fields, (SELECT count(*) FROM k JOIN c USING (key) WHERE numbers >= 2)::BIGINT AS series, (SELECT count(*) FROM p)::BIGINT AS correlations FROM n"""
)
def dashboard_counters(spark, d):
    return Profile(event_lines(spark, d)).counters


def _payloads(spark, d):
    """One job per user and day: its events' lines, every other line blank or empty."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.concat_ws("\n\n  \n", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.concat_ws(" ", F.lit(" v:"), x["value"].cast("string")))).alias("payload"))
    return e.withColumn("algorithm", F.lit("dbscan"))


@query("SELECT user_id AS job_id, (2 * count(*) - 1)::BIGINT AS engine, count(*)::BIGINT AS profiler FROM events GROUP BY 1")
def line_views(spark, d):
    job = _payloads(spark, d)
    a = engine_lines(job).groupBy("job_id").agg((F.max("row_id") + 1).alias("engine"))
    return a.join(profiler_lines(job).groupBy("job_id").agg((F.max("line_index") + 1).alias("profiler")), "job_id")


@query(f"WITH {_EVENTS} SELECT line_index, round(value, 6) AS value, k, user_id::DOUBLE AS first_number FROM e")
def keyed_numbers(spark, d):
    lines = event_lines(spark, d)
    return lines.select("line_index", keyed_number(F.col("line"), "VALUE").alias("value"), keyed_number(F.col("line"), "k").cast("long").alias("k"), freeform_numbers(F.col("line"))[0].alias("first_number"))


@query("SELECT event_id AS line_index, (10 + len(event_type) + len(event_id::VARCHAR))::BIGINT AS bytes, 2::BIGINT AS marks FROM events")
def line_measures(spark, d):
    line = F.concat(F.lit("é=:"), F.col("event_type"), F.lit(" n "), F.col("event_id"), F.lit("..."))
    return table(spark, d, "events").select(F.col("event_id").alias("line_index"), line.alias("line")).select("line_index", F.octet_length("line").alias("bytes"), count_marks(F.col("line")).alias("marks"))


def _written_lines(spark, d):
    """The events' JSON lines as text files, every seventh line empty and every fifth of blanks, in a file for each event type."""
    folder = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    line = F.when(F.col("line_index") % 7 == 0, "").when(F.col("line_index") % 5 == 0, "  ").otherwise(F.concat(F.col("line_index"), F.lit(" "), F.col("line")))
    lines = event_lines(spark, d).select(F.get_json_object("line", "$.level").alias("level"), "line_index", line.alias("value"))
    lines.repartition("level").sortWithinPartitions("level", "line_index").select("level", "value").write.partitionBy("level").text(folder)
    return folder


_FILE_LINES = f"WITH {_EVENTS}, l AS (SELECT level, line_index, row_number() OVER (PARTITION BY level ORDER BY line_index) - 1 AS n FROM e WHERE line_index % 7 <> 0{{}})"


@query(_FILE_LINES.format("") + " SELECT level, n::BIGINT AS row_id, CASE WHEN line_index % 5 > 0 THEN line_index END::BIGINT AS event_id FROM l")
def engine_file_rows(spark, d):
    """Files read split by split; the level is in the file's name, the event's number at a line's begin."""
    got = engine_file_lines(spark, _written_lines(spark, d))
    return got.select(F.regexp_extract("file", "level=([^/]*)", 1).alias("level"), "row_id", F.regexp_extract("line", "^([0-9]+) ", 1).try_cast("long").alias("event_id"))


@query(_FILE_LINES.format(" AND line_index % 5 <> 0") + " SELECT level, n::BIGINT AS line_index, line_index::BIGINT AS event_id FROM l")
def profiler_file_rows(spark, d):
    got = profiler_file_lines(spark, _written_lines(spark, d))
    return got.select(F.regexp_extract("file", "level=([^/]*)", 1).alias("level"), "line_index", F.regexp_extract("line", "^([0-9]+) ", 1).try_cast("long").alias("event_id"))


_FNV = "list_reduce(list_prepend(1469598103934665603::HUGEINT, [ord(c)::HUGEINT FOR c IN string_split({}, '')]), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(f"SELECT event_id, {_FNV.format("event_type || ' ' || event_id")}::DECIMAL(20, 0) AS hash FROM events")
def line_hash(spark, d):
    return table(spark, d, "events").select("event_id", fnv1a64(F.concat_ws(" ", "event_type", "event_id")).alias("hash"))


def _features(spark, d):
    return feature_vectors(event_lines(spark, d).withColumnRenamed("line_index", "row_id"), CONFIG)


#: A third of the lines has all numbers, a third one only (padded), a third none (hashed).
_TURN_LINES = "SELECT event_id AS row_id, event_id % 3 AS turn, CASE event_id % 3 WHEN 1 THEN 'user=' || user_id WHEN 2 THEN event_type || ' at: night=day ' || event_type END AS line, value, user_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events"


@query(
    f"""WITH t AS ({_TURN_LINES}) SELECT row_id,
  round(CASE turn WHEN 0 THEN value::FLOAT::DOUBLE WHEN 1 THEN user_id ELSE ({_FNV.format("coalesce(line, '')")} % 1000000 / 1000.0)::FLOAT::DOUBLE END, 6) AS f0,
  CASE turn WHEN 0 THEN k WHEN 1 THEN user_id ELSE len(line) END::DOUBLE AS f1, CASE turn WHEN 0 THEN user_id WHEN 1 THEN user_id ELSE 2 END::DOUBLE AS f2 FROM t"""
)
def feature_columns(spark, d):
    e = table(spark, d, "events")
    turn = F.col("event_id") % 3
    other = e.select(F.col("event_id").alias("line_index"), F.when(turn == 1, F.concat(F.lit("user="), "user_id")).when(turn == 2, F.concat("event_type", F.lit(" at: night=day "), "event_type")).alias("other"))
    lines = event_lines(spark, d).join(other, "line_index").select("job_id", F.col("line_index").alias("row_id"), F.coalesce("other", "line").alias("line"))
    return feature_vectors(lines, CONFIG).select("row_id", *(F.col("v")[i].alias(f"f{i}") for i in range(3)))


_SUMMARY = f"""WITH {_EVENTS}, v AS (SELECT line_index, value::FLOAT::DOUBLE AS x, k::DOUBLE AS y, user_id::DOUBLE AS z FROM e),
s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(z) AS sz, min(x) AS lx, max(x) AS hx, regr_slope(x, line_index) AS slope FROM v),
o AS (SELECT avg(CASE WHEN ((x - mx) / sx) ^ 2 + ((y - my) / sy) ^ 2 + ((z - mz) / sz) ^ 2 > 9 THEN 1.0 ELSE 0.0 END) AS ratio FROM v, s),
h AS (SELECT -sum(c / n * log2(c / n)) AS entropy FROM (SELECT count(*) AS c FROM v GROUP BY least(31, floor(abs(x)))), s)"""


_EACH = ", ".join(f"[round({f}x{a}, 5), round({f}y{a}, 5), round({f}z{a}, 5)] AS {n}" for f, a, n in (("avg(", ")", "mean"), ("min(", ")", "min"), ("max(", ")", "max"), ("stddev_pop(", ")", "stddev")))


@query(
    _SUMMARY + f""", m AS (SELECT {_EACH} FROM v)
  SELECT n::BIGINT AS row_count, array_to_string(mean, ' ') AS mean, array_to_string(min, ' ') AS min, array_to_string(max, ' ') AS max, array_to_string(stddev, ' ') AS stddev, round(entropy, 5) AS entropy,
  round(slope, 5) + 0.0 AS slope, round(ratio, 5) AS outlier_ratio, CASE WHEN slope > 0.05 THEN 'Rising' WHEN slope < -0.05 THEN 'Falling' ELSE 'Stable' END AS trend FROM s, o, h, m""".replace("array_to_string(", "list_sum(").replace(", ' ') AS", ") AS")
)
def feature_summary(spark, d):
    """The three dimensions' statistics, added up."""
    s = summary(_features(spark, d), 3)
    r = lambda c: F.round(c, 5)
    added = lambda c: F.aggregate(F.transform(c, r), F.lit(0.0), lambda a, x: a + x)
    return s.select("row_count", *(added(c).alias(c) for c in ("mean", "min", "max", "stddev")), r("entropy").alias("entropy"), (r("slope") + 0.0).alias("slope"), r("outlier_ratio").alias("outlier_ratio"), "trend")


def _embedding_features(spark, d):
    """The first eight components of all embeddings, as many as the engine takes, scaled; each label's vectors are a job."""
    v = F.transform(F.slice("embedding", 1, MAX_DIMENSIONS), lambda x: (x * 3).cast("float"))
    rows_ = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("job_id"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return numbered(rows_, "job_id", ["vec_id", "v"], "row_id").select("job_id", "row_id", "v")


_POINTS = "p AS MATERIALIZED (SELECT label::BIGINT AS job, count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1 AS r, [(x::DOUBLE * 3)::FLOAT::DOUBLE FOR x IN embedding[1:8]] AS v FROM embeddings)"
_SQ = "list_sum([(a.v[i] - b.v[i]) ^ 2 FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]])"


def _named(name):
    def run(spark, d):
        return cluster(_embedding_features(spark, d), name, Config(dbscan_min_samples=3))

    run.__name__ = f"cluster_{name.replace('++', '')}"
    return run


_EIGHT = "p AS MATERIALIZED (SELECT label::BIGINT AS job, count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1 AS r, [(x::DOUBLE * 3)::FLOAT::DOUBLE FOR x IN embedding[1:8]] AS v FROM embeddings), sizes AS (SELECT job, count(*) AS n FROM p GROUP BY job)"
_AXES = range(1, MAX_DIMENSIONS + 1)
_APART = "list_sum([({a}[i] - {b}[i]) ^ 2 FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]])"
_MEAN = "[" + ", ".join(f"avg(v[{i}])::FLOAT::DOUBLE" for i in _AXES) + "]"


def _kmeans_sql() -> str:
    """Tables up to ``labels`` (job, r, v, c): three farthest-first centres, then twelve rounds, a table for each."""
    out = [_EIGHT, "k0 AS MATERIALIZED (SELECT job, 0 AS c, v FROM p WHERE r = 0)"]
    far = f"SELECT p.job, p.r, any_value(p.v) AS v, min({_APART.format(a='p.v', b='k.v')}) AS d FROM p JOIN {{0}} k USING (job) GROUP BY p.job, p.r"
    for c in (1, 2):
        out.append(f"k{c} AS MATERIALIZED (SELECT * FROM k{c - 1} UNION ALL SELECT job, {c}, v FROM ({far.format(f'k{c - 1}')}) JOIN sizes USING (job) WHERE n > {c} QUALIFY row_number() OVER (PARTITION BY job ORDER BY d DESC, r) = 1)")
    for i in range(12):
        out.append(f"a{i} AS MATERIALIZED (SELECT p.job, p.r, p.v, k.c FROM p JOIN k{i + 2} k USING (job) QUALIFY row_number() OVER (PARTITION BY p.job, p.r ORDER BY {_APART.format(a='p.v', b='k.v')}, k.c) = 1)")
        out.append(f"m{i} AS (SELECT job, c, {_MEAN} AS m FROM a{i} GROUP BY job, c), k{i + 3} AS MATERIALIZED (SELECT job, c, coalesce(m, v) AS v FROM k{i + 2} LEFT JOIN m{i} USING (job, c))")
    return ", ".join([*out, "labels AS (SELECT * FROM a11)"])


def _gmm_sql() -> str:
    """Eight rounds over unit variances: the parts of a row are columns, the means and weights of a job one row."""
    start = ", ".join(f"max(v) FILTER (r = {c} % n) AS m{c}" for c in range(3))
    out = [_EIGHT, f"s0 AS MATERIALIZED (SELECT job, {start}, 0.34::DOUBLE AS w0, 0.33::DOUBLE AS w1, 0.33::DOUBLE AS w2 FROM p JOIN sizes USING (job) GROUP BY job)"]
    for i in range(8):
        parts = ", ".join(f"w{c} * exp(-0.5 * {_APART.format(a='v', b=f'm{c}')}) AS q{c}" for c in range(3))
        out.append(f"g{i} AS (SELECT p.job, r, v, {parts} FROM p JOIN s{i} USING (job)), e{i} AS MATERIALIZED (SELECT job, r, v, " + ", ".join(f"q{c} / CASE WHEN q0 + q1 + q2 = 0 THEN 1 ELSE q0 + q1 + q2 END AS p{c}" for c in range(3)) + f" FROM g{i})")
        means = ", ".join("[" + ", ".join(f"(sum(p{c} * v[{d}]) / CASE WHEN sum(p{c}) > 0 THEN sum(p{c}) ELSE 1 END)::FLOAT::DOUBLE" for d in _AXES) + f"] AS m{c}" for c in range(3))
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT job, {means}, " + ", ".join(f"sum(p{c}) / count(*) AS w{c}" for c in range(3)) + f" FROM e{i} GROUP BY job)")
    return "WITH " + ", ".join(out) + " SELECT job AS job_id, r AS row_id, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)::BIGINT AS label, 3::BIGINT AS cluster_count FROM e7"


def _birch_sql() -> str:
    """One row after the other joins the nearest of eight leaders in reach or opens one, in the last one's place when all are taken."""
    near = "list_aggregate([{d} FOR j IN range(1, n + 1)], 'min')".format(d=_APART.format(a="leaders[j]", b="v"))
    first = "list_position([{d} FOR j IN range(1, n + 1)], least_far)".format(d=_APART.format(a="leaders[j]", b="v"))
    moved = "[CASE WHEN j = spot THEN [((base[i] * held[spot] + v[i]) / (held[spot] + 1))::FLOAT::DOUBLE FOR i IN [1, 2, 3, 4, 5, 6, 7, 8]] ELSE leaders[j] END FOR j IN range(1, 9)]"
    return f"""WITH RECURSIVE {_EIGHT}, s AS (
  SELECT job, -1::BIGINT AS r, [[0.0::DOUBLE FOR i IN range(8)] FOR j IN range(8)] AS leaders, [0.0::DOUBLE FOR j IN range(8)] AS held, 0::BIGINT AS n, -1::BIGINT AS label FROM sizes
  UNION ALL
  SELECT job, r, {moved}, [held[j] + (j = spot)::INT FOR j IN range(1, 9)], new_n, spot - 1 FROM (
    SELECT *, CASE WHEN near THEN leaders[spot] ELSE v END AS base FROM (
      SELECT *, CASE WHEN near THEN nearest ELSE least(n + 1, 8) END AS spot, CASE WHEN near THEN n ELSE least(n + 1, 8) END AS new_n FROM (
        SELECT *, {first} AS nearest, coalesce(least_far <= 0.2025, false) AS near FROM (
          SELECT s.job, p.r, p.v, leaders, held, n, {near} AS least_far FROM s JOIN p ON p.job = s.job AND p.r = s.r + 1)))))
SELECT job AS job_id, r AS row_id, label::BIGINT AS label, (max(n) OVER (PARTITION BY job))::BIGINT AS cluster_count FROM s WHERE r >= 0"""


def _mean_shift_sql() -> str:
    """Six averages over a flat kernel, a table for each; then rows in order take the first mode in reach or open one."""
    out = [_EIGHT.replace("p AS", "p AS", 1), "x0 AS MATERIALIZED (SELECT job, r, v AS spot FROM p)"]
    for i in range(6):
        mean = "[" + ", ".join(f"avg(p.v[{d}])::FLOAT::DOUBLE" for d in _AXES) + "]"
        out.append(f"y{i} AS (SELECT x.job, x.r, {mean} AS m FROM x{i} x JOIN p ON p.job = x.job AND {_APART.format(a='x.spot', b='p.v')} <= 0.81 GROUP BY x.job, x.r), x{i + 1} AS MATERIALIZED (SELECT job, r, coalesce(m, spot) AS spot FROM x{i} LEFT JOIN y{i} USING (job, r))")
    hit = "list_position([{d} < 0.04 FOR m IN modes], true)".format(d=_APART.format(a="m", b="x6.spot"))
    return f"""WITH RECURSIVE {', '.join(out)}, s AS (
  SELECT job, -1::BIGINT AS r, []::DOUBLE[][] AS modes, -1::BIGINT AS label FROM sizes
  UNION ALL
  SELECT job, r, CASE WHEN hit IS NULL AND len(modes) < 16 THEN list_append(modes, spot) ELSE modes END, coalesce(hit - 1, len(modes)) FROM (
    SELECT s.job, x6.r, x6.spot, modes, nullif({hit}, 0) AS hit FROM s JOIN x6 ON x6.job = s.job AND x6.r = s.r + 1))
SELECT job AS job_id, r AS row_id, label::BIGINT AS label, (max(len(modes)) OVER (PARTITION BY job))::BIGINT AS cluster_count FROM s WHERE r >= 0"""


query(f"WITH {_kmeans_sql()} SELECT job AS job_id, r AS row_id, c::BIGINT AS label, least(3, n)::BIGINT AS cluster_count FROM labels JOIN sizes USING (job)")(_named("kmeans++"))
query(_gmm_sql())(_named("gmm"))
query(_birch_sql())(_named("birch"))
query(_mean_shift_sql())(_named("mean_shift"))
# neighbours are counted among the first 4096 rows; then every place in turn is exchanged with each later one that has more
query(
    f"""WITH RECURSIVE {_POINTS}, f AS (SELECT * FROM p WHERE r < 4096), h AS (SELECT a.job, a.r, count(*) AS c FROM f a JOIN f b USING (job) WHERE {_SQ} <= 0.54 ^ 2 GROUP BY a.job, a.r),
  t AS (SELECT job, list(c ORDER BY r) AS c, count(*) AS n FROM h GROUP BY job), s(job, i, j, o) AS (
    SELECT job, 1::BIGINT, 2::BIGINT, range(1, n + 1) FROM t UNION ALL
    SELECT s.job, CASE WHEN j < n THEN i ELSE i + 1 END, CASE WHEN j < n THEN j + 1 ELSE i + 2 END, CASE WHEN c[o[j]] > c[o[i]] THEN [CASE k WHEN i THEN o[j] WHEN j THEN o[i] ELSE o[k] END FOR k IN range(1, n + 1)] ELSE o END
    FROM s JOIN t USING (job) WHERE i < n),
  b AS (SELECT job, unnest(o) - 1 AS r, (generate_subscripts(o, 1) - 1) // 3 AS label FROM s JOIN t USING (job) WHERE i = n)
  SELECT p.job AS job_id, p.r AS row_id, coalesce(b.label, 0)::BIGINT AS label, (n // 3 + 1)::BIGINT AS cluster_count FROM p JOIN t USING (job) LEFT JOIN b ON b.job = p.job AND b.r = p.r"""
)(_named("optics"))


# seeds: dense rows with no earlier seed in reach; a row belongs to its first seed, if that isn't later than it
query(
    f"""WITH RECURSIVE {_POINTS}, n AS (SELECT a.job, a.r AS i, b.r AS j FROM p a JOIN p b USING (job) WHERE {_SQ} <= 0.2025),
  core AS (SELECT job, i FROM n GROUP BY ALL HAVING count(*) >= 3), s(job, seeds, last) AS (
    SELECT job, [min(i)], min(i) FROM core GROUP BY job UNION ALL
    SELECT s.job, list_append(s.seeds, x.i), x.i FROM s, LATERAL (SELECT min(c.i) AS i FROM core c WHERE c.job = s.job AND c.i > s.last AND NOT EXISTS (SELECT 1 FROM n WHERE n.job = c.job AND n.i = c.i AND list_contains(s.seeds, n.j))) x WHERE x.i IS NOT NULL),
  final AS (SELECT job, arg_max(seeds, last) AS seeds FROM s GROUP BY job), seed AS (SELECT job, unnest(seeds) AS i, unnest(range(len(seeds))) AS k FROM final)
  SELECT p.job AS job_id, p.r AS row_id, coalesce((SELECT min(k) FROM seed JOIN n ON n.job = seed.job AND n.i = seed.i WHERE seed.job = p.job AND n.j = p.r AND seed.i <= p.r), -1)::BIGINT AS label,
         (SELECT count(*) FROM seed WHERE seed.job = p.job)::BIGINT AS cluster_count FROM p"""
)(_named("dbscan"))

query(
    f"""WITH {_POINTS}, f AS (SELECT * FROM p WHERE r < 1024), n AS (SELECT job, count(*) AS n FROM f GROUP BY job),
  c AS (SELECT a.job, a.r AS i, b.r AS j FROM f a JOIN f b ON a.job = b.job AND a.r < b.r QUALIFY row_number() OVER (PARTITION BY a.job ORDER BY {_SQ}, a.r, b.r) = 1)
  SELECT p.job AS job_id, p.r AS row_id, (CASE WHEN p.r >= 1024 THEN 0 WHEN n.n <= 3 THEN p.r WHEN p.r = c.j THEN c.i WHEN p.r > c.j THEN p.r - 1 ELSE p.r END)::BIGINT AS label, (n.n - (n.n > 3)::INT)::BIGINT AS cluster_count
  FROM p JOIN n USING (job) LEFT JOIN c USING (job)"""
)(_named("agglomerative"))


@query(f"WITH {_POINTS}, n AS (SELECT a.job, a.r, count(*) AS c FROM p a JOIN p b USING (job) WHERE a.r < 4096 AND b.r < 4096 AND sqrt({_SQ}) <= 0.54 GROUP BY a.job, a.r) SELECT job AS job_id, r AS row_id, ((row_number() OVER (PARTITION BY job ORDER BY c DESC, r) - 1) // 3)::BIGINT AS label FROM n UNION ALL SELECT job, r, 0 FROM p WHERE r >= 4096")
def cluster_density_bands(spark, d):
    return density_bands(_embedding_features(spark, d), 0.54, 3)


@query(f"WITH {_kmeans_sql()} SELECT job AS job_id, r AS row_id, c::BIGINT AS label FROM labels")
def cluster_kmeans_spread(spark, d):
    return spread_kmeans(staged(_embedding_features(spark, d)))


@query(f"WITH {_POINTS} SELECT a.job AS job_id, a.r AS row_id, round({_SQ}, 6) AS d FROM p a JOIN p b USING (job) WHERE b.r = 0")
def distance_to_first(spark, d):
    f = _embedding_features(spark, d)
    return f.join(f.where("row_id = 0").select("job_id", F.col("v").alias("o")), "job_id").select("job_id", "row_id", distance_sq(F.col("v"), F.col("o")).alias("d"))


def _told(spark, d):
    f = staged(_embedding_features(spark, d))
    labels = staged(cluster(f, "kmeans++", CONFIG))
    counts = labels.groupBy("job_id").agg(F.max("cluster_count").alias("cluster_count"))
    return f, labels, counts, summary(f, MAX_DIMENSIONS).join(counts, "job_id")


_SHARES = f"""WITH {_kmeans_sql()}, share AS (SELECT job, c, count(*) AS n, count(*) / any_value(sizes.n) AS density FROM labels JOIN sizes USING (job) GROUP BY job, c),
spread AS (SELECT job, min(n) AS smallest, max(n) AS largest FROM (SELECT k.job, k.c, count(l.r) AS n FROM k14 k LEFT JOIN labels l ON l.job = k.job AND l.c = k.c GROUP BY k.job, k.c) GROUP BY job)"""


@query(_SHARES + " SELECT job AS job_id, smallest::BIGINT AS smallest, largest::BIGINT AS largest, round(smallest / largest, 6) AS balance FROM spread")
def cluster_balance(spark, d):
    _, labels, counts, _ = _told(spark, d)
    return balance(cluster_sizes(labels, counts))


@query(_SHARES + " SELECT job AS job_id, c::BIGINT AS slot, n::BIGINT AS n, round(density, 6) AS density FROM share")
def cluster_share(spark, d):
    _, labels, counts, _ = _told(spark, d)
    return cluster_density(labels.select("job_id", "label"), counts)


_NUMBERS = ", ".join(f"v[{i}] AS x{i}" for i in _AXES)
_DEVIATION = " + ".join(f"((v[{i}] - avg(v[{i}]) OVER w) / CASE WHEN stddev_pop(v[{i}]) OVER w > 0.0001 THEN stddev_pop(v[{i}]) OVER w ELSE 1 END) ^ 2" for i in _AXES)
_STATS = _SHARES + f""", o AS (SELECT job, {_DEVIATION} AS score, least(31, floor(abs(v[1]))) AS bucket, r, v FROM p WINDOW w AS (PARTITION BY job)),
h AS (SELECT job, 0 - sum(c / n * log2(c / n)) AS entropy FROM (SELECT job, bucket, count(*) AS c FROM o GROUP BY ALL) JOIN sizes USING (job) GROUP BY job),
st AS (SELECT job, count(*) AS n, avg((score > 9)::INT) AS ratio, coalesce(regr_slope(v[1], r), 0) AS slope, min(v[1]) AS l0, max(v[1]) AS h0, min(v[2]) AS l1, max(v[2]) AS h1 FROM o GROUP BY job),
t AS (SELECT *, smallest / largest AS balance, least(3, n) AS clusters, CASE WHEN slope > 0.05 THEN 'Rising' WHEN slope < -0.05 THEN 'Falling' ELSE 'Stable' END AS trend FROM st JOIN h USING (job) JOIN spread USING (job))"""


@query(
    _STATS + """, i AS (SELECT job, unnest([
  {'keep': true, 'title': 'Segmentation', 'detail': printf('%d rows were compressed into %d cluster bands with 8 numeric dimensions.', n, clusters), 'tone': CASE WHEN clusters > 1 THEN 'warm' ELSE 'calm' END},
  {'keep': true, 'title': 'Distribution', 'detail': printf('Entropy landed at %.3f, which suggests a %s categorical spread in the payload.', entropy, CASE WHEN entropy >= 1.25 THEN 'broad' ELSE 'narrow' END), 'tone': CASE WHEN entropy >= 1.25 THEN 'hot' ELSE 'calm' END},
  {'keep': true, 'title': 'Trend', 'detail': printf('The dominant trend is %s with slope %.4f across the primary timeline.', trend, slope), 'tone': CASE WHEN abs(slope) >= 0.05 THEN 'warm' ELSE 'calm' END},
  {'keep': true, 'title': 'Anomaly pressure', 'detail': printf('Outliers account for %.2f%% of the observed rows.', ratio * 100), 'tone': CASE WHEN ratio >= 0.08 THEN 'hot' ELSE 'calm' END},
  {'keep': true, 'title': 'Projection', 'detail': printf('A 2D projection of dim 0 and dim 1 is rendered. Range: [%.2f, %.2f] x [%.2f, %.2f].', l0, h0, l1, h1), 'tone': 'calm'},
  {'keep': ratio >= 0.15, 'title': 'Noise signal', 'detail': printf('High outlier ratio (%.1f%%) indicates noisy or multi-modal data. Consider tuning epsilon or switching to OPTICS/GMM.', ratio * 100), 'tone': 'hot'},
  {'keep': clusters > 1, 'title': 'Balance', 'detail': printf('Cluster balance is %.0f%% (largest %d vs smallest %d). %s', balance * 100, largest, smallest, CASE WHEN balance < 0.3 THEN 'Highly imbalanced — review feature scaling.' ELSE 'Reasonably balanced.' END), 'tone': CASE WHEN balance < 0.3 THEN 'warm' ELSE 'calm' END}
  ]) AS i, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS place FROM t)
SELECT job AS job_id, (row_number() OVER (PARTITION BY job ORDER BY place) - 1)::BIGINT AS pos, i.title AS title, i.detail AS detail, i.tone AS tone FROM i WHERE i.keep"""
)
def insight_list(spark, d):
    _, labels, counts, s = _told(spark, d)
    return insights(s, balance(cluster_sizes(labels, counts)))


@query(
    _STATS + """ SELECT l.job AS job_id, l.r AS row_id, l.c::BIGINT AS label, round(72 + (v[1] - l0) / CASE WHEN h0 - l0 > 0.0001 THEN h0 - l0 ELSE 1 END * 1296, 6) AS cx, round(444 - (v[2] - l1) / CASE WHEN h1 - l1 > 0.0001 THEN h1 - l1 ELSE 1 END * 388, 6) AS cy,
  round(greatest(2.5, least(7.0, 3.0 + (1.0 - density) * 3.5)), 6) AS r, ['#00FF41', '#00E5FF', '#FF0055'][l.c + 1] AS color FROM labels l JOIN t ON t.job = l.job JOIN share s ON s.job = l.job AND s.c = l.c"""
)
def svg_geometry(spark, d):
    f, labels, counts, s = _told(spark, d)
    return svg_points(f, labels, s, cluster_density(labels.select("job_id", "label"), counts))


def _analysed(spark, d):
    """One job per user, every seventh with blank lines only."""
    blank = F.col("job_id") % 7 == 0
    return analyze(_payloads(spark, d).select("job_id", "algorithm", F.when(blank, F.lit("\n\n")).otherwise(F.col("payload")).alias("payload")), CONFIG).results


@query("SELECT user_id AS job_id, CASE WHEN user_id % 7 = 0 THEN '{\"jobId\":\"' || user_id || '\",\"status\":\"failed\",\"updatedMs\":0,\"error\":\"no analyzable rows found\"}' ELSE '{\"jobId\":\"' || user_id || '\",\"status\":\"ready\",\"updatedMs\":0,\"error\":\"\"}' END AS json FROM (SELECT DISTINCT user_id FROM events)")
def status_documents(spark, d):
    return status_json(_analysed(spark, d))


@query("SELECT user_id AS job_id, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, 'dbscan' AS algorithm, (CASE WHEN user_id % 7 = 0 THEN 0 ELSE 2 * count(*) - 1 END)::BIGINT AS rows, CASE WHEN user_id % 7 = 0 THEN 'no analyzable rows found' ELSE '' END AS error, 11::BIGINT AS keys FROM events GROUP BY 1")
def result_documents(spark, d):
    shown = F.from_json("json", "jobId string, status string, algorithm string, rows long, error string")
    keys = F.size(F.json_object_keys("json"))
    return result_json(_analysed(spark, d)).select("job_id", shown.alias("r"), keys.alias("keys")).select("job_id", "r.status", "r.algorithm", "r.rows", "r.error", "keys")


@query("SELECT user_id AS job_id, 'ready' AS status, (2 * count(*) - 1)::BIGINT AS row_count FROM events GROUP BY 1")
def stream_results(spark, d):
    """One job per user through a stream of files, four files in a batch."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/siftline-stream-{uuid.uuid4().hex}"
    _payloads(spark, d).select("job_id", "algorithm", "payload").repartition(8, "job_id").write.parquet(f"{folder}/in")
    stream(payload_source(spark, f"{folder}/in", 4), f"{folder}/out", f"{folder}/state", CONFIG, once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("job_id", "status", "row_count")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, upper(event_type) AS severity, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windowed_severity(spark, d):
    rows_ = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("severity"))
    return windowed_counts(rows_, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _arrivals(spark, d, columns: dict) -> tuple[str, DataFrame]:
    """(folder, stream) of the events in three files, one a batch: those of the first half of days and, twice, every third of
    them; the others; and then again the first hundred, too late."""
    folder = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", *(c.alias(n) for n, c in columns.items()))
    first = F.col("ts") < e.agg(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).first()[0]
    late = table(spark, d, "events").select("event_id").orderBy("ts", "event_id").limit(100)
    # files are read in the order in which they were written
    for part in (e.where(first).union(e.where(first & (F.col("event_id") % 3 == 0))), e.where(~first), e.join(late, "event_id").select(*e.columns)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query(
    """WITH e AS (SELECT ts::TIMESTAMP AS ts, upper(event_type) AS severity FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e),
  w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL (k) DAY AS start, severity FROM e, (SELECT unnest([0, 1]) AS k))
  SELECT start::TIMESTAMP AS start, (start + INTERVAL 2 DAY)::TIMESTAMP AS "end", severity, count(*)::BIGINT AS n, 100::BIGINT AS late FROM w, m WHERE start + INTERVAL 2 DAY <= mark GROUP BY start, severity"""
)
def stream_sliding(spark, d):
    """Two days' windows every day through a stream: repeated events count once, late ones are dropped and counted."""
    folder, rows_ = _arrivals(spark, d, {"severity": F.upper("event_type")})
    q = written(sliding_counts(rows_, "2 days", "1 day", "1 day", ["event_id"]), f"{folder}/out", f"{folder}/state")
    q.awaitTermination()
    got = spark.read.parquet(f"{folder}/out").withColumn("late", F.lit(late_rows(q)))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "severity", "n", "late")


@query(
    """WITH e AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark, min(ts) + (max(ts) - min(ts)) / 2 AS half FROM e),
  a AS (SELECT ts, user_id FROM e UNION ALL SELECT ts, user_id FROM e, m WHERE ts < half AND event_id % 3 = 0),
  b AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, true)::INT AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
  SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", user_id, count(*)::BIGINT AS n FROM c GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT mark FROM m)"""
)
def stream_sessions(spark, d):
    """Users' sessions through a stream; repeated events count as often as they come, late ones don't."""
    folder, rows_ = _arrivals(spark, d, {"user_id": F.col("user_id")})
    written(session_counts(rows_, "6 hours", "1 day", "user_id"), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def _jobs_in_order(spark, d):
    """(job_id, algorithm, payload): a job for each user, numbered from 1 on, its events' ids as lines."""
    lines = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: F.concat(F.lit("id="), x))
    users = table(spark, d, "events").groupBy("user_id").agg(F.concat_ws("\n", lines).alias("payload"))
    users = numbered(users.withColumn("all", F.lit(1)), "all", ["user_id"], "before")
    return users.select((F.col("before") + 1).alias("job_id"), F.lit("dbscan").alias("algorithm"), "payload")


@query(
    """WITH RECURSIVE j AS (SELECT row_number() OVER (ORDER BY user_id) AS id, sum(len(event_id::VARCHAR) + 4) - 1 AS b FROM events GROUP BY user_id),
  g AS (SELECT id, 0 AS batch, 1 AS n, b AS size FROM j WHERE id = 1
    UNION ALL SELECT j.id, CASE WHEN n = 256 OR size >= 65536 THEN batch + 1 ELSE batch END, CASE WHEN n = 256 OR size >= 65536 THEN 1 ELSE n + 1 END, CASE WHEN n = 256 OR size >= 65536 THEN b ELSE size + b END FROM g JOIN j ON j.id = g.id + 1)
  SELECT id::BIGINT AS job_id, batch::BIGINT AS batch, n::BIGINT AS place, size::BIGINT AS size FROM g"""
)
def stream_admission(spark, d):
    """The batch that each job is admitted to, its place there and the bytes so far; all jobs wait when the stream starts."""
    folder = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    spool(_jobs_in_order(spark, d), f"{folder}/in")
    sized = lambda df, n: df.select("job_id", "batch", F.octet_length("payload").alias("bytes")).write.mode("overwrite").parquet(f"{folder}/out/taken={n}")
    q = admitted(spark, f"{folder}/in", CONFIG, batches=1024).writeStream.foreachBatch(sized).option("checkpointLocation", f"{folder}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    # at most 256 jobs a batch
    within = Window.partitionBy("batch").orderBy("job_id")
    return spark.read.parquet(f"{folder}/out").select("job_id", F.col("batch").cast("long").alias("batch"), F.row_number().over(within).alias("place"), F.sum("bytes").over(within).alias("size"))


@query(
    """WITH j AS (SELECT row_number() OVER (ORDER BY user_id) AS id, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
  SELECT id::BIGINT AS job_id, CASE id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN id % 3 = 1 THEN 'lost' ELSE '' END AS error FROM j WHERE id % 3 = 2 OR id > n - 64"""
)
def stream_states(spark, d):
    """States of a job for each user in 64 slots, through a stream that is started again from its checkpoint: all are queued, and
    in the second run a third is ready, a third has failed; the finished ones are forgotten but for the last 64 jobs'."""
    folder = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    jobs_ = staged(_jobs_in_order(spark, d).select("job_id"))
    third = F.col("job_id") % 3
    for some in (jobs_.select("job_id", F.lit("queued").alias("status"), F.lit("").alias("error")), jobs_.where(third != 2).select("job_id", F.when(third == 0, "ready").otherwise("failed").alias("status"), F.when(third == 1, "lost").alias("error"))):
        announce(some, f"{folder}/events")
        kept(job_states(events(spark, f"{folder}/events"), slots=64), f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return registry(spark.read.parquet(f"{folder}/out")).select("job_id", "status", "error")


@query(_LONG + " SELECT line_index, field_pos::BIGINT AS pos, key, type, str, round(num, 6) AS num, b AS bool FROM f")
def sql_json_fields(spark, d):
    """Fields of JSON lines in SQL alone."""
    register(spark)
    return spark.sql("SELECT line_index, pos, f.key, f.type, f.str, f.num, f.bool FROM (SELECT line_index, json_fields(line) AS fields FROM {lines}), LATERAL posexplode(fields) AS x(pos, f)", lines=event_lines(spark, d))

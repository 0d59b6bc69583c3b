"""Profiles of parsed lines: schemas, coverages, histograms, correlations and chart series.

Each function takes tables keyed by job_id and gives one. Counts are grouped with partial sums; ties go to what
appears first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.parsing import ENTITY_KEYS, MESSAGE_KEYS, SEVERITY_KEYS
from siftline.operators.fields import stamped
from siftline.staging import staged

# Chart colours; fixed values.
PALETTE = ("#ffda7b", "#ff8c6a", "#f45d96", "#7ad7ff", "#8ef0b5", "#c8a4ff", "#ffb3c1", "#a0c4ff")
COUNTS = ("nulls", "numbers", "strings", "booleans", "arrays", "objects")


def color(position) -> F.Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(position, F.lit(len(PALETTE))) + 1).cast("int"))


def _own(fields: DataFrame) -> DataFrame:
    return fields.where("key not in ('raw', 'line_index')")


def _seen() -> F.Column:
    """The least line and field position, as one number: the minimum of a struct would sort all rows of a task."""
    place = F.col("line_index").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("field_pos").cast("decimal(10,0)")
    return F.min(place).alias("first_seen")


def _top(counted: DataFrame, limit: int, *by) -> DataFrame:
    order = Window.partitionBy("job_id").orderBy(*by)
    return counted.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def coverage(rows: DataFrame, column: str, limit: int = 1 << 30, without: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, pos, label, value): how often each value of ``column`` occurs, most frequent first; null and those in ``without`` not, where that is given.

    What is left out comes last and is cut off there: a filter of labels would go below the grouping, and compute each twice.
    """
    counted = rows.groupBy("job_id", F.col(column).alias("label")).agg(F.count("*").alias("value"), F.min("line_index").alias("seen"))
    if not without:
        return _top(counted, limit, F.desc("value"), "seen").select("job_id", "pos", "label", "value")
    shown = ~F.coalesce(F.col("label").isin(*without), F.lit(True))
    return _top(counted, limit, F.desc(shown), F.desc("value"), "seen").where(shown).select("job_id", "pos", "label", "value")


def format_coverage(rows: DataFrame) -> DataFrame:
    return coverage(rows, "format")


def shape_coverage(rows: DataFrame, limit: int = 8) -> DataFrame:
    return coverage(rows, "shape_key", limit)


def severity_histogram(rows: DataFrame) -> DataFrame:
    return coverage(rows, "severity")


def entity_histogram(rows: DataFrame) -> DataFrame:
    return coverage(rows, "entity", without=("unknown", "unstructured"))


def field_coverage(fields: DataFrame, limit: int = 8) -> DataFrame:
    counted = _own(fields).groupBy("job_id", F.col("key").alias("label")).agg(F.count("*").alias("value"), _seen())
    return _top(counted, limit, F.desc("value"), "first_seen").select("job_id", "pos", "label", "value")


def totals(rows: DataFrame) -> DataFrame:
    """(job_id, n_rows, invalid_rows, timestamp_key)."""
    return rows.groupBy("job_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("format") == "text").alias("invalid_rows"),
        F.when(F.bool_or(F.col("ts_label").startswith("row ")), "row index").otherwise("timestamp").alias("timestamp_key"),
    )


def dominant_keys(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, dominant_keys, primary_key): of the eight most frequent keys those in half of the rows, six at most."""
    top = field_coverage(fields).join(totals(rows).select("job_id", "n_rows"), "job_id")
    often = F.when(F.col("value") / F.col("n_rows") >= 0.5, F.struct("pos", "label"))
    found = top.groupBy("job_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(often)), lambda x: x["label"]), 1, 6).alias("dominant_keys"), F.min_by("label", "pos").alias("leading"))
    both = totals(rows).select("job_id").join(found, "job_id", "left")
    return both.select("job_id", F.coalesce("dominant_keys", F.array().cast("array<string>")).alias("dominant_keys"), F.coalesce("leading", F.lit("record")).alias("primary_key"))


def key_counts(fields: DataFrame) -> DataFrame:
    """(job_id, pos, key, counts by type, min, max, mean, stddev, first_seen), most filled keys first: one grouping."""
    number = F.when((F.col("type") == "number") & ~F.isnan("num") & (F.abs("num") < float("inf")), F.col("num"))
    kind = lambda t: F.count_if(F.col("type") == t)
    found = _own(fields).groupBy("job_id", "key").agg(
        F.count("*").alias("present"), kind("null").alias("nulls"), F.count(number).alias("numbers"), kind("string").alias("strings"), kind("boolean").alias("booleans"),
        kind("array").alias("arrays"), kind("object").alias("objects"), kind("number").alias("number_types"), F.min(number).alias("min"), F.max(number).alias("max"),
        F.avg(number).alias("mean"), F.stddev_pop(number).alias("stddev"), _seen(),
    )
    order = Window.partitionBy("job_id").orderBy(F.desc(F.col("numbers") + F.col("strings") + F.col("booleans")), "first_seen")
    return found.withColumn("pos", F.row_number().over(order))


def schemas(fields: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``key_counts``, which ``counted`` may be, with distinct_strings."""
    strings = _own(fields).where("type = 'string'").select("job_id", "key", "str").distinct().groupBy("job_id", "key").agg(F.count("*").alias("distinct_strings"))
    return (counted or key_counts(fields)).join(strings, ["job_id", "key"], "left").withColumn("distinct_strings", F.coalesce("distinct_strings", F.lit(0).cast("long")))


def samples(fields: DataFrame, limit: int = 5) -> DataFrame:
    """(job_id, key, samples): each key's first five different values, as JSON."""
    shown = F.coalesce("json", F.when(F.col("type") == "string", F.to_json(F.struct(F.col("str").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("str").alias("v")))) - 6)).when(F.col("type") == "boolean", F.col("bool").cast("string")).when(F.col("type") == "number", F.col("num").cast("string")), F.lit("null"))
    first = _own(fields).select("job_id", "key", shown.alias("value"), "line_index", "field_pos").groupBy("job_id", "key", "value").agg(_seen())
    order = Window.partitionBy("job_id", "key").orderBy("first_seen")
    kept = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return kept.groupBy("job_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("samples"))


def numeric_keys(schema: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, key, rank, mean): keys with a number in three tenths of the rows, in the order of ``key_counts``."""
    enough = schema.join(totals(rows).select("job_id", "n_rows"), "job_id").where(F.col("numbers") >= F.greatest(F.lit(1.0), F.col("n_rows") * 0.3))
    return enough.select("job_id", "key", (F.row_number().over(Window.partitionBy("job_id").orderBy("pos")) - 1).alias("rank"), "mean", "numbers")


#: Numeric keys of a job up to which all pairs are sums of one grouping.
PAIRED_KEYS = 8


def correlations(parsed_lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_id, pos, x, y, value): Pearson's correlation of each pair of numeric keys.

    Means are over all rows that have the key, sums over rows that have both, so with missing values this isn't
    ``corr``. Pairs are made inside each row; no row meets another. The keys, a row for each job, are looked up
    first, while the frame is built: where no job has more than PAIRED_KEYS, a row's deviations become columns and every
    pair's sums are columns of one grouping; else pairs are rows. ``keys`` should be cheap to read again.
    """
    wanted = keys.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "mean"))).alias("keys"))
    most = wanted.agg(F.coalesce(F.max(F.size("keys")), F.lit(0))).first()[0]
    numbers = F.map_from_entries(F.transform(finite_numbers(), lambda f: F.struct(f["key"], f["num"])))
    row = parsed_lines.select("job_id", numbers.alias("numbers")).join(wanted, "job_id")
    if most <= PAIRED_KEYS:
        key = lambda i: F.get("keys", F.lit(i))
        flat = row.select("job_id", *((F.try_element_at("numbers", key(i)["key"]) - key(i)["mean"]).alias(f"d{i}") for i in range(most)))
        pairs = [(i, j) for i in range(most) for j in range(i + 1, most)]
        both = {(i, j): F.col(f"d{i}").isNotNull() & F.col(f"d{j}").isNotNull() for i, j in pairs}
        part = lambda i, j, a, b: F.sum(F.when(both[i, j], F.col(f"d{a}") * F.col(f"d{b}")))
        sums = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), part(i, j, i, j).alias("xy"), part(i, j, i, i).alias("xx"), part(i, j, j, j).alias("yy"), F.count(F.when(both[i, j], 1)).alias("n")) for i, j in pairs]
        if not sums:
            return wanted.where("false").select("job_id", F.lit(0).alias("pos"), F.lit("").alias("x"), F.lit("").alias("y"), F.lit(0.0).alias("value"))
        sums = flat.groupBy("job_id").agg(F.array(*sums).alias("sums")).select("job_id", F.explode("sums").alias("s")).select("job_id", "s.*").join(wanted, "job_id")
        sums = sums.select("job_id", "i", "j", F.get("keys", "i")["key"].alias("x"), F.get("keys", "j")["key"].alias("y"), "xy", "xx", "yy", "n")
    else:
        moved = F.transform(F.filter("keys", lambda k: F.try_element_at("numbers", k["key"]).isNotNull()), lambda k: F.struct(k["rank"].alias("rank"), k["key"].alias("key"), (F.try_element_at("numbers", k["key"]) - k["mean"]).alias("d")))
        moved = row.select("job_id", moved.alias("m"))
        both = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["rank"].alias("i"), b["rank"].alias("j"), a["key"].alias("x"), b["key"].alias("y"), a["d"].alias("dx"), b["d"].alias("dy")))))
        pair = moved.select("job_id", F.explode(both).alias("p")).select("job_id", "p.*")
        sums = pair.groupBy("job_id", "i", "j", "x", "y").agg(F.sum(F.col("dx") * F.col("dy")).alias("xy"), F.sum(F.col("dx") * F.col("dx")).alias("xx"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.count("*").alias("n"))
    kept = sums.where("n > 1 and xx > 0 and yy > 0").withColumn("value", F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return kept.select("job_id", (F.row_number().over(Window.partitionBy("job_id").orderBy("i", "j")) - 1).alias("pos"), "x", "y", "value")


def finite_numbers() -> F.Column:
    """The finite numbers of a parsed line's fields."""
    return F.filter("fields", lambda f: (f["type"] == "number") & ~F.isnan(f["num"]) & (F.abs(f["num"]) < float("inf")))


def numeric_series(parsed_lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_id, key, color, line_index, label, value): points of the numeric keys with two or more, in row order.

    The fields of other keys go inside their row; lines get their label here, where it is read.
    """
    wanted = keys.where("numbers >= 2").groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("key", color(F.col("rank"))))).alias("colors"))
    own = F.filter(finite_numbers(), lambda f: F.map_contains_key("colors", f["key"]))
    points = stamped(parsed_lines.join(wanted, "job_id")).select("job_id", "line_index", F.col("ts_label").alias("label"), "colors", F.explode(own).alias("f"))
    return points.select("job_id", F.col("f.key").alias("key"), F.element_at("colors", F.col("f.key")).alias("color"), "line_index", "label", F.col("f.num").alias("value"))


def _labelled(points: DataFrame, rows: DataFrame) -> DataFrame:
    if "ts_label" in points.columns:
        return points.withColumnRenamed("ts_label", "label")
    return points.join(rows.select("job_id", "line_index", F.col("ts_label").alias("label")), ["job_id", "line_index"])


def series_range(points: DataFrame) -> DataFrame:
    return points.groupBy("job_id", "key", "color").agg(F.count("*").alias("n_points"), F.min("value").alias("min"), F.max("value").alias("max"))


def scatter_pairs(correlated: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_id, pos, x, y): the three strongest pairs, else the first two keys; with three keys also the first and third."""
    strong = correlated.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(F.abs("value")), "pos"))).where("n <= 3").select("job_id", (F.col("n") - 1).alias("pos"), "x", "y")
    by_rank = keys.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("k"))
    counted = by_rank.join(strong.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fallback = counted.where("n = 0 and size(k) >= 2").select("job_id", F.lit(0).alias("pos"), F.col("k")[0]["key"].alias("x"), F.col("k")[1]["key"].alias("y"))
    third = counted.where("size(k) >= 3 and n < 3").select("job_id", F.greatest(F.lit(1), F.col("n")).cast("int").alias("pos"), F.col("k")[0]["key"].alias("x"), F.col("k")[2]["key"].alias("y"))
    every = strong.union(fallback).union(third).withColumn("pair", F.array_sort(F.array("x", "y")))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("job_id", "pair").orderBy("pos"))).where("n = 1").select("job_id", "pos", "x", "y")


def scatter(parsed_lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(job_id, key, color, line_index, x, y, label): points that have both keys, where there are two or more.

    A pair's two numbers stand in one row, so points are made there and none is shuffled; a count of each pair's points,
    a few rows for each job, says which pairs have two.
    """
    number = F.map_from_entries(F.transform(finite_numbers(), lambda f: F.struct(f["key"], f["num"])))
    value = lambda c: F.try_element_at("number", F.col(f"p.{c}"))

    def made(pairs: DataFrame, *more: str) -> DataFrame:
        wanted = pairs.groupBy("job_id").agg(F.collect_list(F.struct("pos", "x", "y")).alias("pairs"))
        lines = parsed_lines.join(wanted, "job_id")
        lines = (stamped(lines) if more else lines).select("job_id", "line_index", *more, number.alias("number"), F.explode("pairs").alias("p"))
        return lines.select("job_id", "line_index", *more, "p.pos", F.col("p.x").alias("kx"), F.col("p.y").alias("ky"), value("x").alias("x"), value("y").alias("y")).where("x is not null and y is not null")

    held = made(pairs).groupBy("job_id", "pos").agg(F.count("*").alias("n")).where("n >= 2").select("job_id", "pos")
    # written, so that its size is known and it is broadcast where it is small
    points = made(staged(pairs.join(held, ["job_id", "pos"])), "ts_label")
    return points.select("job_id", F.concat("kx", F.lit(" vs "), "ky").alias("key"), color(F.col("pos")).alias("color"), "line_index", "x", "y", F.col("ts_label").alias("label"))


def boolean_histogram(fields: DataFrame) -> DataFrame:
    return _own(fields).where("type = 'boolean'").groupBy("job_id", "key").agg(F.count_if("bool").alias("true_count"), F.count_if(~F.col("bool")).alias("false_count"))


def text_lengths(fields: DataFrame, rows: DataFrame, schema: DataFrame) -> DataFrame:
    """(job_id, key, color, line_index, label, value): UTF-16 lengths of message-like strings, two or more and not all empty."""
    known = F.array_position(F.array(*map(F.lit, MESSAGE_KEYS)), F.col("key"))
    alike = schema.where("strings > 0 and (contains(key, 'message') or contains(key, 'msg') or contains(key, 'text'))").where(known == 0).select("job_id", "key", F.row_number().over(Window.partitionBy("job_id").orderBy("pos")).alias("late"))
    label = ["ts_label"] if "ts_label" in fields.columns else []
    text = _own(fields).where("type = 'string'").select("job_id", "line_index", "key", *label, (F.octet_length(F.encode("str", "UTF-16BE")) / 2).cast("long").alias("value"))
    placed = text.join(alike, ["job_id", "key"], "left").withColumn("place", F.when(known > 0, known - 1).otherwise(F.col("late") + len(MESSAGE_KEYS) - 1)).where("place is not null")
    many = placed.groupBy("job_id", "key").agg(F.count("*").alias("n"), F.max("value").alias("most")).where("n >= 2 and most > 0").select("job_id", "key")
    named = _labelled(placed.join(many, ["job_id", "key"]), rows)
    return named.select("job_id", F.concat("key", F.lit(" length")).alias("key"), color(F.col("place") + 3).alias("color"), "line_index", "label", "value")


def null_ratios(schema: DataFrame, rows: DataFrame, limit: int = 10) -> DataFrame:
    """(job_id, pos, label, value): percent of rows with an explicit null, to one decimal."""
    value = F.floor(F.col("nulls") / F.col("n_rows") * 1000 + 0.5) / 10
    found = schema.withColumnRenamed("pos", "rank").join(totals(rows).select("job_id", "n_rows"), "job_id").withColumn("value", value).where("value > 0")
    return _top(found, limit, F.desc("value"), "rank").select("job_id", "pos", F.col("key").alias("label"), "value")


def low_cardinality(fields: DataFrame, schema: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, key, label, value): values of strings with 2 to 12 different ones, fewer than half of the rows."""
    few = schema.join(totals(rows).select("job_id", "n_rows"), "job_id").where("strings > 0 and distinct_strings > 1 and distinct_strings <= 12 and distinct_strings < n_rows * 0.5")
    return _value_counts(fields, few.select("job_id", "key"))


def donuts(fields: DataFrame, schema: DataFrame, limit: int = 3) -> DataFrame:
    """The same for the first three strings with 2 to 10 different values."""
    few = _top(schema.where("strings > 0 and distinct_strings > 1 and distinct_strings <= 10").withColumnRenamed("pos", "rank"), limit, "rank")
    return _value_counts(fields, few.select("job_id", "key"))


def _value_counts(fields: DataFrame, keys: DataFrame) -> DataFrame:
    return fields.where("type = 'string'").join(keys, ["job_id", "key"]).groupBy("job_id", "key", F.col("str").alias("label")).agg(F.count("*").alias("value"))


def stats_grid(schema: DataFrame, limit: int = 8) -> DataFrame:
    """(job_id, pos, key, dominant_type, null_rate, ...) of the first eight keys; the rate is over cells that are there."""
    kinds = F.array(*(F.struct(F.col(c).alias("n"), F.lit(t).alias("t")) for c, t in (("nulls", "null"), ("number_types", "number"), ("strings", "string"), ("booleans", "boolean"), ("arrays", "array"), ("objects", "object"))))
    most = F.array_max(F.transform(kinds, lambda k: k["n"]))
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return schema.where(F.col("pos") <= limit).select("job_id", "pos", "key", F.filter(kinds, lambda k: k["n"] == most)[0]["t"].alias("dominant_type"), "min", "max", "mean", "distinct_strings", (F.col("nulls") / F.greatest(total, F.lit(1)) * 100).alias("null_rate"))


def _first_key(fields: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """(job_id, name): of ``keys`` the first that has a string. Places are grouped, since the minimum of a text would sort all rows."""
    order = F.array(*map(F.lit, keys))
    place = fields.where(F.col("key").isin(*keys)).where("type = 'string'").groupBy("job_id").agg(F.min(F.array_position(order, F.col("key"))).alias("at"))
    return place.select("job_id", F.element_at(order, F.col("at").cast("int")).alias(name))


def category(fields: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, category_key): the severity key that names the category histogram; every row has a severity."""
    found = _first_key(fields, SEVERITY_KEYS, "category_key")
    return totals(rows).select("job_id").join(found, "job_id", "left").select("job_id", F.coalesce("category_key", F.lit("severity")).alias("category_key"))


def category_histogram(jobs: DataFrame, *choices: Callable[[], DataFrame]) -> DataFrame:
    """(job_id, label, value): the first of these histograms that has anything for the job. A later one is made only where
    jobs are left without bars, which is looked up while the frame is built."""
    every = None
    for choice in choices:
        bars = choice().select("job_id", "label", "value")
        part = staged(bars if every is None else bars.join(left, "job_id", "left_semi"))
        every = part if every is None else every.union(part)
        left = staged(jobs.select("job_id").distinct().join(every, "job_id", "left_anti"))
        if left.isEmpty():
            break
    return every


def least_key(few: DataFrame) -> DataFrame:
    """Of ``low_cardinality`` each job's least key."""
    return few.join(few.groupBy("job_id").agg(F.min("key").alias("key")), ["job_id", "key"])


def entity_key(fields: DataFrame) -> DataFrame:
    return _first_key(fields, ENTITY_KEYS, "entity_key")


def counters(rows: DataFrame, schema: DataFrame, keys: DataFrame, correlated: DataFrame) -> DataFrame:
    """(job_id, rows, fields, series, correlations); a numeric key with two numbers or more is a series."""
    count = lambda df, name: df.groupBy("job_id").agg(F.count("*").alias(name))
    out = count(rows, "rows").join(count(schema, "fields"), "job_id", "left").join(count(keys.where("numbers >= 2"), "series"), "job_id", "left").join(count(correlated, "correlations"), "job_id", "left")
    return out.select("job_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "fields", "series", "correlations")))

"""Lines to semi-structured rows and a long table of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.parsing import ENTITY_KEYS, FIELD, MESSAGE_KEYS, SEVERITY_KEYS, TIMESTAMP_KEYS, instant, js_trim, json_fields, kv_fields, let, whole_pairs

#: Times in milliseconds beyond this have no calendar date.
_LAST_DATE = 8.64e15


def _field(key: str, kind: str, num=None, text=None) -> F.Column:
    nothing = F.lit(None)
    return F.struct(
        F.lit(key).alias("key"), F.lit(kind).alias("type"), (nothing if num is None else num).cast("double").alias("num"),
        (nothing if text is None else text).cast("string").alias("str"), nothing.cast("boolean").alias("bool"), nothing.cast("string").alias("json"),
    )


def _once(value: F.Column) -> F.Column:
    """A column that the optimizer can't copy into filters and other columns: a generator's only row."""
    return F.explode(F.array(value))


def parsed(lines: DataFrame) -> DataFrame:
    """(job_id, line_index, line, format, fields) of trimmed lines (job_id, line_index, line).

    format is json for objects, kv for lines with a pair, text for others. fields has the line's own fields, then
    ``raw`` and ``line_index``, and ``message`` where the line has no field; own ones of those names give way.
    """
    out = lines.select("job_id", "line_index", "line", whole_pairs(F.col("line")).alias("_text"))
    either = let(json_fields("_text"), lambda o: F.struct(o.isNotNull().alias("object"), F.coalesce(o, kv_fields(F.col("line"))).alias("own")))
    out = out.select("job_id", "line_index", "line", _once(either).alias("_read"))
    form = F.when(F.col("_read.object"), "json").when(F.size("_read.own") > 0, "kv").otherwise("text")
    out = out.select("job_id", "line_index", "line", form.alias("format"), F.col("_read.own").alias("own"))
    raw, index, message = _field("raw", "string", text=F.col("line")), _field("line_index", "number", num=F.col("line_index")), _field("message", "string", text=F.col("line"))
    added = F.when(F.size("own") == 0, F.array(raw, index, message)).otherwise(F.array(raw, index))
    fields = F.concat(F.filter("own", lambda f: ~f["key"].isin("raw", "line_index")), added).cast(f"array<{FIELD}>")
    return out.select("job_id", "line_index", "line", "format", fields.alias("fields"))


def stamped(parsed_lines: DataFrame) -> DataFrame:
    """``parsed`` lines with ts_ms and ts_label: the first of the time keys whose field is a time, else the line's number.

    Only fields of those names are looked at, mostly one of a line, so a text is read as a time once.
    """
    order = F.array(*map(F.lit, TIMESTAMP_KEYS))
    own = F.filter("fields", lambda f: f["key"].isin(*TIMESTAMP_KEYS) & ((f["type"] == "string") | ((f["type"] == "number") & (F.abs(f["num"]) <= _LAST_DATE))))
    timed = F.transform(own, lambda f: F.struct(F.array_position(order, f["key"]).alias("at"), F.coalesce(f["num"], instant(f["str"])).alias("ms"), f["str"].alias("text")))
    first = F.array_min(F.filter(timed, lambda x: x["ms"].isNotNull()))
    shown = F.date_format(F.timestamp_millis(F.col("_first.ms").cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    label = F.coalesce(js_trim(F.col("_first.text")), F.when(F.col("_first.ms").isNotNull(), shown), F.concat(F.lit("row "), F.col("line_index") + 1))
    out = parsed_lines.withColumn("_first", first)
    return out.select(*parsed_lines.columns, F.coalesce("_first.ms", F.col("line_index").cast("double")).alias("ts_ms"), label.alias("ts_label"))


def rows(parsed_lines: DataFrame) -> DataFrame:
    """(job_id, line_index, raw, format, ts_ms, ts_label, severity, entity, message, shape_key) of ``parsed`` or ``stamped`` lines."""
    out = parsed_lines if "ts_label" in parsed_lines.columns else stamped(parsed_lines)
    named = F.filter("fields", lambda f: (f["type"] == "string") & f["key"].isin(*SEVERITY_KEYS, *ENTITY_KEYS, *MESSAGE_KEYS))
    texts = F.map_from_entries(F.transform(named, lambda f: F.struct(f["key"], f["str"])))
    out = out.select("job_id", "line_index", F.col("line").alias("raw"), "format", "fields", texts.alias("texts"), "ts_ms", "ts_label")

    def first(keys):
        texts_of = F.transform(F.array(*map(F.lit, keys)), lambda k: js_trim(F.try_element_at(F.col("texts"), k)))
        return F.get(F.filter(texts_of, lambda x: x.isNotNull() & (x != "")), 0)

    keys = F.array_sort(F.filter(F.transform("fields", lambda f: f["key"]), lambda k: ~k.startswith("__")))
    is_text = F.col("format") == "text"
    return out.select(
        "job_id", "line_index", "raw", "format", "ts_ms", "ts_label",
        F.coalesce(F.upper(first(SEVERITY_KEYS)), F.when(is_text, "TEXT").otherwise("INFO")).alias("severity"),
        F.coalesce(first(ENTITY_KEYS), F.when(is_text, "unstructured").otherwise("unknown")).alias("entity"),
        F.coalesce(first(MESSAGE_KEYS), js_trim("raw")).alias("message"),
        F.array_join(keys, " | ").alias("shape_key"),
    )


def fields(parsed_lines: DataFrame) -> DataFrame:
    """(job_id, line_index, field_pos, key, type, num, str, bool, json): one row per field; ``stamped`` lines' have ts_label too."""
    label = [c for c in ("ts_label",) if c in parsed_lines.columns]
    return parsed_lines.select("job_id", "line_index", *label, F.posexplode("fields").alias("field_pos", "f")).select("job_id", "line_index", *label, "field_pos", "f.*")


def numeric(field_rows: DataFrame) -> DataFrame:
    """Finite numbers only, line_index included."""
    return field_rows.where("type = 'number' and not isnan(num) and abs(num) < double('Infinity')")


def array_extras(field_rows: DataFrame) -> DataFrame:
    """An extension: ``_length`` and the first three items of array fields."""
    arrays = field_rows.where("type = 'array'").withColumn("items", F.from_json("json", "array<string>"))
    size = arrays.select("job_id", "line_index", F.concat("key", F.lit("._length")).alias("key"), F.size("items").cast("string").alias("value"))
    item = arrays.select("job_id", "line_index", "key", F.posexplode(F.slice("items", 1, 3)).alias("i", "value"))
    return size.union(item.select("job_id", "line_index", F.concat("key", F.lit("["), "i", F.lit("]")).alias("key"), "value"))

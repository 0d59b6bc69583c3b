"""Line parsing: JSON objects, key-value pairs, coercion of values and instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.sources.lines import JS_SPACE, js_trim

# Field names with a meaning, in the order they are looked for; fixed values.
TIMESTAMP_KEYS = ("timestamp", "@timestamp", "ts", "time", "time_local", "event_time", "created_at", "datetime", "date")
SEVERITY_KEYS = ("level", "lvl", "severity", "priority", "log_level")
ENTITY_KEYS = ("service", "svc", "source", "app", "module", "component", "host", "node", "pod", "container")
MESSAGE_KEYS = ("msg", "message", "text", "event", "detail", "description", "error", "reason", "log")

FIELD = "struct<key:string,type:string,num:double,str:string,bool:boolean,json:string>"
#: Objects nested deeper stay as they are.
DEPTH = 5
#: Marks around keys while pairs are cut out; private-use characters that lines don't hold.
_OPEN, _CLOSE = "\ue000", "\ue001"

ISO = r"^[+-]?\d{4,6}(?:-\d\d(?:-\d\d)?)?(?:[T ]\d\d:\d\d(?::\d\d(?:[.,]\d{1,9})?)?\s*(?:Z|[+-]\d\d:?\d\d)?)?$"
MAIL = r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\s+\d{1,2}:\d\d(?::\d\d)?\s*(?:GMT|UTC|Z|[+-]\d{4})?$"


#: Half of a surrogate pair, after an even number of backslashes.
_HALF = r"(?i)((?:^|[^\\])(?:\\\\)*)(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"


def let(value: F.Column, f) -> F.Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` under a name, computed once, in SQL."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _last(found: str) -> str:
    """``last_of_each`` of an array of structs with keys, in SQL, where keys repeat at all."""
    keys = "array_distinct(transform(all_, x -> x.key))"
    return _bound(found, "all_", f"CASE WHEN size({keys}) < size(all_) THEN transform({keys}, k -> element_at(filter(all_, x -> x.key = k), -1)) ELSE all_ END")


def _read(text: str, values: str) -> str:
    """An object's members as a map, null for other texts; JSON as it is written, without other quotes or NaN."""
    return f"from_json({text}, 'map<string,{values}>', map('allowNonNumericNumbers', 'false', 'allowSingleQuotes', 'false'))"


def _members(text: str, level: int, whole: bool) -> str:
    """(key, kind, value as a variant, text of what is no scalar) of an object's text, in order."""
    e, i, s = (f"{c}{level}" for c in "eis")
    # bound, since each branch of a CASE computes its operand again
    kind = _bound(f"substring(schema_of_variant({e}.value), 1, 2)", f"k{level}", f"CASE k{level} WHEN 'ST' THEN 'string' WHEN 'BO' THEN 'boolean' WHEN 'AR' THEN 'array' WHEN 'OB' THEN 'object' WHEN 'VO' THEN 'null' ELSE 'number' END")
    each = lambda more: f"transform(map_entries({_read(text, 'variant')}), ({e}, {i}) -> named_struct('key', {e}.key, 'kind', {kind}, 'v', {e}.value, 's', {more}))"
    return _last(_bound(f"map_values({_read(text, 'string')})", s, each(f"get({s}, {i})")) if whole else each("cast(NULL AS string)"))


def _typed(e: str) -> str:
    """A member as a FIELD."""
    only = lambda kinds, value: f"CASE WHEN {e}.kind IN ({kinds}) THEN {value} END"
    return f"""named_struct('key', {e}.key, 'type', {e}.kind, 'num', {only("'number'", f"cast({e}.v AS double)")}, 'str', {only("'string'", f"cast({e}.v AS string)")},
        'bool', {only("'boolean'", f"cast({e}.v AS boolean)")}, 'json', {only("'array', 'object'", f"{e}.s")})"""


def _flattened(text: str, level: int = 1) -> str:
    """The fields of an object's text, those of objects inside it under dotted keys down to DEPTH."""
    e, f = f"m{level}", f"f{level}"
    if level == DEPTH:
        return f"transform({_members(text, level, True)}, {e} -> {_typed(e)})"
    inner = f"transform({_flattened(f'{e}.s', level + 1)}, {f} -> named_struct('key', concat({e}.key, '.', {f}.key), 'type', {f}.type, 'num', {f}.num, 'str', {f}.str, 'bool', {f}.bool, 'json', {f}.json))"
    return f"flatten(transform({_members(text, level, True)}, {e} -> CASE WHEN {e}.kind = 'object' THEN {inner} ELSE array({_typed(e)}) END))"


def whole_pairs(line: F.Column) -> F.Column:
    """The line with U+FFFD for each escaped half of a surrogate pair."""
    mended = F.regexp_replace(F.regexp_replace(line, _HALF, r"$1\\ufffd"), _HALF, r"$1\\ufffd")
    return F.when(line.contains("\\") & F.lower(line).contains("\\ud"), mended).otherwise(line)


def json_sql(line: str) -> str:
    """``json_fields`` as SQL."""
    # what follows an object can't close both an array and an object around it; mostly the object's first brace closes it
    ends = f"(locate('}}', {line}) = length({line}) OR (json_array_length(concat('[', {line}, ']')) = 1 AND size(json_object_keys(concat('{{\"x\":', {line}, '}}'))) = 1))"
    plain = lambda whole: f"transform({_members(line, 0, whole)}, m -> {_typed('m')})"
    found = f"CASE WHEN locate('{{', {line}, 2) > 0 THEN {_last(_flattened(line))} WHEN contains({line}, '[') THEN {plain(True)} ELSE {plain(False)} END"
    return f"CASE WHEN startswith({line}, '{{') AND endswith({line}, '}}') AND {ends} THEN {found} END"


def json_fields(line: str) -> F.Column:
    """The fields of a column of lines that are JSON objects, null for anything else: variants tell the values' types.

    Nested objects have dotted keys; arrays, and objects below DEPTH keys, stay whole, as Spark writes their text. Of
    equal keys the last value counts, in the first one's place, where the session lets variants have them, as
    ``session.prepared`` does. A number beyond all doubles is infinite, inside other values the string Infinity.
    """
    return F.expr(json_sql(line))


def _iso(text: F.Column) -> F.Column:
    day = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d\d$"), F.concat(text, F.lit("-01"))).otherwise(F.translate(text, ",", "."))
    end = F.when(text.rlike(r"\d\d:\d\d.*(?:Z|[+-]\d\d:?\d\d)$"), "").when(text.contains(":"), "Z").otherwise("T00:00:00Z")
    return F.unix_millis(F.concat(day, end).try_cast("timestamp"))


def _mail(text: F.Column) -> F.Column:
    """Day, month, year, hour, minute, second and zone, taken apart once."""
    part = r"^(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{4})\s+(\d{1,2}:\d\d)(:\d\d)?.*$"
    plain = F.regexp_replace(text, part, "$1 $2 $3 $4$5")
    full = F.when(text.rlike(r":\d\d:\d\d"), plain).otherwise(F.concat(plain, F.lit(":00")))
    zone = F.coalesce(F.nullif(F.regexp_extract(text, r"([+-]\d{4})$", 1), F.lit("")).try_cast("int"), F.lit(0))
    minutes = F.signum(zone) * (F.floor(F.abs(zone) / 100) * 60 + F.abs(zone) % 100)
    return F.unix_millis(F.try_to_timestamp(F.initcap(full), F.lit("d MMM yyyy H:mm:ss"))) - minutes * 60000


#: Day forms that people write: 2024/01/02, 1/2/2024 (month first) and Jan 2, 2024, each with a time or without.
_CLOCK = r"(?:,?\s+(\d{1,2}:\d\d)(:\d\d)?)?"
SLASHED, AMERICAN = rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_CLOCK}$", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_CLOCK}$"
WRITTEN = rf"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_CLOCK}$"


def _civil(text: F.Column, pattern: str, order: tuple[int, int, int], form: str) -> F.Column:
    """The time of a text of one of the forms above; ``order`` has the places of year, month and day in the pattern."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    clock = F.concat(F.when(part(4) == "", "0:00").otherwise(part(4)), F.when(part(5) == "", ":00").otherwise(part(5)))
    return F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", part(order[0]), F.initcap(part(order[1])), part(order[2]), clock), F.lit(form)))


def instant(c: F.Column) -> F.Column:
    """Milliseconds since 1970 of a time in ISO-8601, mail style or one of the written day forms, UTC where no zone is
    given; null for others."""
    return let(
        js_trim(c),
        lambda text: F.when(text.rlike(ISO), _iso(text).cast("double"))
        .when(text.rlike(MAIL), _mail(text).cast("double"))
        .when(text.rlike(SLASHED), _civil(text, SLASHED, (1, 2, 3), "y M d H:mm:ss").cast("double"))
        .when(text.rlike(AMERICAN), _civil(text, AMERICAN, (3, 1, 2), "y M d H:mm:ss").cast("double"))
        .when(text.rlike(WRITTEN), _civil(text, WRITTEN, (3, 1, 2), "y MMM d H:mm:ss").cast("double")),
    )


NUMERIC = r"(?i)^-?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?$"
HEX = r"(?i)^0x[0-9a-f]+$"


def hex_number(digits: F.Column) -> F.Column:
    """The value of hexadecimal digits of any length, in double precision."""
    padded = F.lpad(digits, 32, "0")
    high, low = F.substring(padded, 1, 16), F.substring(padded, 17, 16)
    each = [F.conv(x, 16, 10).cast("decimal(20,0)").cast("double") for x in (high, low)]
    return F.when(F.length(digits) <= 32, each[0] * F.lit(float(1 << 64)) + each[1]).otherwise(F.lit(float("inf")))


def coerced(found: F.Column) -> F.Column:
    """(key, value) pairs as FIELDs; each step binds what the next one uses."""
    quoted = lambda v: (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
    inner = lambda v: F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))
    bare = F.transform(found, lambda p: F.struct(p["key"].alias("key"), F.when(quoted(p["value"]), inner(p["value"])).otherwise(p["value"]).alias("v")))
    shaped = F.transform(bare, lambda p: F.struct(p["key"].alias("key"), p["v"].alias("v"), F.lower(p["v"]).alias("low"), js_trim(p["v"]).alias("t"), F.when(F.lower(p["key"]).isin(*TIMESTAMP_KEYS), instant(p["v"])).alias("ms")))
    number = lambda p: F.coalesce(p["ms"], F.when(p["t"].rlike(NUMERIC), p["t"].try_cast("double")).when(p["t"].rlike(HEX), hex_number(F.substring(p["t"], 3, 1000))))
    known = F.transform(shaped, lambda p: F.struct(p["key"].alias("key"), p["v"].alias("v"), p["low"].alias("low"), number(p).alias("n")))
    kind = lambda p: F.when(p["low"].isin("true", "false"), "boolean").when(p["low"] == "null", "null").when(p["n"].isNotNull(), "number").otherwise("string")
    typed = F.transform(known, lambda p: F.struct(p["key"].alias("key"), kind(p).alias("type"), p["v"].alias("v"), p["low"].alias("low"), p["n"].alias("n")))
    return F.transform(
        typed,
        lambda p: F.struct(
            p["key"].alias("key"),
            p["type"].alias("type"),
            F.when(p["type"] == "number", p["n"]).alias("num"),
            F.when(p["type"] == "string", p["v"]).alias("str"),
            F.when(p["type"] == "boolean", p["low"] == "true").alias("bool"),
            F.lit(None).cast("string").alias("json"),
        ),
    )


def pairs(line: F.Column) -> F.Column:
    """(key, value) of every ``key=value`` or ``key: value`` in order; a value ends where the next key begins."""
    clean = F.translate(line, _OPEN + _CLOSE, "")
    marked = F.regexp_replace(clean, rf"(?:^|[{JS_SPACE},;|])([A-Za-z0-9_.@/-]+)[{JS_SPACE}]*[=:][{JS_SPACE}]*", f"{_OPEN}$1{_CLOSE}")
    parts = F.split(marked, _OPEN, -1)
    cut = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.substring_index(p, _CLOSE, 1).alias("key"), F.regexp_replace(F.substring_index(p, _CLOSE, -1), rf"^[{JS_SPACE}]+|[{JS_SPACE},;|]+$", "").alias("value")),
    )
    return F.filter(cut, lambda p: p["value"] != "")


def last_of_each(found: F.Column) -> F.Column:
    """One pair per key, where the key came first, with its last value."""
    return let(found, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda p: p["key"])), lambda k: F.element_at(F.filter(all_, lambda p: p["key"] == k), -1)))


def kv_fields(line: F.Column) -> F.Column:
    return coerced(last_of_each(pairs(line)))

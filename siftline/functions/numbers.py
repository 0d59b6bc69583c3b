"""Numbers in lines: tokens, keyed values, counts and the line hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.parsing import hex_number, let

#: C's isspace, for a Java character class.
C_SPACE = r"\x20\x09-\x0d"
_DECIMAL = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_NAMED = r"(?i)[+-]?(?:inf(?:inity)?|nan(?:\([A-Za-z0-9_]*\))?)"
_HEX_FLOAT = r"(?i)([+-]?)0x([0-9a-f]*)\.?([0-9a-f]*)(?:p([+-]?\d+))?"


def _value(text: F.Column) -> F.Column:
    """The double that a whole decimal, named or hexadecimal number stands for."""
    named = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    whole, part = F.regexp_extract(text, f"^{_HEX_FLOAT}$", 2), F.regexp_extract(text, f"^{_HEX_FLOAT}$", 3)
    power = F.coalesce(F.regexp_extract(text, f"^{_HEX_FLOAT}$", 4).try_cast("int"), F.lit(0))
    hexed = hex_number(F.concat(whole, part)) * F.pow(F.lit(2.0), power - 4 * F.length(part)) * F.when(text.startswith("-"), -1).otherwise(1)
    return (
        F.when(text.rlike(f"^{_DECIMAL}$"), text.try_cast("double"))
        .when(text.rlike(f"^(?:{_NAMED})$"), named)
        .when(text.rlike(f"^{_HEX_FLOAT}$") & (F.length(F.concat(whole, part)) > 0), hexed)
    )


def token_number(token: F.Column) -> F.Column:
    """The number that a token is, without quotes and brackets around it; null for others. 127 characters count."""
    bare = F.regexp_replace(F.regexp_replace(token, rf"^[{C_SPACE}]+|[{C_SPACE}]+$", ""), r"^[\"'{\[(]+|[\"'}\]),;|]+$", "")
    return let(F.substring(bare, 1, 127), _value)


def freeform_numbers(line: F.Column) -> F.Column:
    """The numbers of a line in order; of a token the part after its last = or : counts."""
    tokens = F.split(line, rf"[{C_SPACE},;|]+")
    return F.array_compact(F.transform(tokens, lambda t: token_number(F.regexp_extract(t, r"([^=:]*)$", 1))))


def prefix_number(text: F.Column) -> F.Column:
    """The number that a text begins with after white space; null where it begins with none."""
    head = F.regexp_extract(text, rf"^[{C_SPACE}]*([+-]?0[xX][0-9a-fA-F]+|{_DECIMAL}|(?i:[+-]?(?:infinity|inf|nan)))", 1)
    return let(F.nullif(head, F.lit("")), _value)


def keyed_number(line: F.Column, key: str, case_sensitive: bool = False) -> F.Column:
    """The number after the first colon that follows ``key``: quoted and in any case, or as it is."""
    at = (F.instr(line, key) if key else F.lit(1)) if case_sensitive else F.instr(F.lower(line), f'"{key.lower()}"')
    rest = let(F.when(at > 0, F.substring(line, at, F.length(line))), lambda r: F.when(F.instr(r, ":") > 0, F.substring(r, F.instr(r, ":") + 1, F.length(r))))
    return prefix_number(rest)


def count_marks(line: F.Column) -> F.Column:
    return F.length(line) - F.length(F.translate(line, "=:", ""))


#: The hash's start, which lacks the canonical one's last digit, and its multiplier; fixed values.
HASH_START, HASH_STEP = 1469598103934665603, 1099511628211


def _fnv(lines: pa.Array) -> np.ndarray:
    """FNV-1a over each line's UTF-8 bytes, a byte position of all lines at a time; nulls as empty lines."""
    lines = lines.cast(pa.large_string()).fill_null("")
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64, len(lines) + 1, lines.offset * 8) if len(lines) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size, h = np.diff(at), np.full(len(lines), HASH_START, np.uint64)
    order = np.argsort(-size, kind="stable")
    held = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for i, n in enumerate(held.tolist()):
        some = order[:n]
        h[some] = (h[some] ^ raw[at[some] + i]) * np.uint64(HASH_STEP)
    return h


@F.arrow_udf(T.DecimalType(20, 0))
def fnv1a64(lines: pa.Array) -> pa.Array:
    """The whole hash of a line, null for null."""
    return pc.if_else(lines.is_valid(), pa.array(_fnv(lines)).cast(pa.decimal128(20, 0)), None)


@F.arrow_udf(T.DoubleType())
def line_hash_feature(lines: pa.Array) -> pa.Array:
    """A line's hash modulo a million, in thousandths, null for null."""
    return pa.array((_fnv(lines) % np.uint64(1_000_000)).astype(float) / 1000.0, mask=~lines.is_valid().to_numpy(zero_copy_only=False))


def distance_sq(a: F.Column, b: F.Column) -> F.Column:
    """Squared Euclidean distance of two float arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)

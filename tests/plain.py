"""Plain versions to compare with."""

import json
import re

from siftline.functions.parsing import DEPTH

_SURROGATE = re.compile("[\ud800-\udfff]")


def _no_constant(name: str):
    raise ValueError(name)


def _sound(text: str) -> str:
    return text if text.isascii() or not _SURROGATE.search(text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _double(value: int | float) -> float:
    try:
        return float(value)
    except OverflowError:  # a whole number beyond all doubles
        return float("inf") if value > 0 else float("-inf")


def _typed(key: str, value) -> tuple:
    """A field as (key, type, num, str, bool, json)."""
    key = _sound(key)
    if value is None:
        return key, "null", None, None, None, None
    if isinstance(value, bool):
        return key, "boolean", None, None, value, None
    if isinstance(value, (int, float)):
        return key, "number", _double(value), None, None, None
    if isinstance(value, str):
        return key, "string", None, _sound(value), None, None
    return key, "array" if isinstance(value, list) else "object", None, None, None, _sound(json.dumps(value, separators=(",", ":"), ensure_ascii=False))


def flatten(value: dict) -> dict:
    """Dotted keys for nested objects; arrays, and objects below ``DEPTH`` keys, stay whole."""
    out, todo = {}, [(iter(value.items()), "", 1)]
    while todo:
        items, prefix, depth = todo[-1]
        for key, item in items:
            name = f"{prefix}{key}"
            if isinstance(item, dict) and depth < DEPTH:
                todo.append((iter(item.items()), f"{name}.", depth + 1))
                break
            out[name] = item
        else:
            todo.pop()
    return out


def parse_object(line: str | None) -> list[tuple] | None:
    """The flattened fields of a line that is a JSON object; None for anything else."""
    if not line or not line.startswith("{"):
        return None
    try:
        value = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return [_typed(k, v) for k, v in flatten(value).items()] if isinstance(value, dict) else None

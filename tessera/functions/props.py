"""Typed property cells: equality never coerces, an explicit null differs from a missing key, doubles compare by bits."""

from __future__ import annotations

import json
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the type tags of stored properties
STRING, INT, DOUBLE, BOOL, NULL = 0, 1, 2, 3, 4

CELL = T.StructType([T.StructField("t", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())])
PROPS = T.MapType(T.StringType(), CELL)
_SLOT = {INT: "i", DOUBLE: "d", STRING: "s", BOOL: "b"}


def cell(value: Any) -> dict:
    """A Python value as a cell; values of other kinds become Null, as arrays and objects do."""
    out: dict = {"t": NULL, "i": None, "d": None, "s": None, "b": None}
    if isinstance(value, bool):
        out |= {"t": BOOL, "b": value}
    elif isinstance(value, int) and -(1 << 63) <= value < 1 << 63:
        out |= {"t": INT, "i": value}
    elif isinstance(value, (int, float)):
        out |= {"t": DOUBLE, "d": float(value)}
    elif isinstance(value, str):
        out |= {"t": STRING, "s": value}
    return out


def props(values: dict[str, Any]) -> dict[str, dict]:
    return {k: cell(v) for k, v in values.items()}


def from_json(text: str) -> dict[str, dict]:
    return props(json.loads(text))


def value(c: dict | None) -> Any:
    """The Python value of a cell; None for Null."""
    return None if c is None or c["t"] == NULL else c[_SLOT[c["t"]]]


def to_json(own: dict[str, dict]) -> str:
    """JSON of a property map; NaN and infinities become null."""

    def plain(c: dict) -> Any:
        v = value(c)
        return None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v

    return json.dumps({k: plain(c) for k, c in own.items()}, ensure_ascii=False, sort_keys=True)


def get(column: str | Column, key: str) -> Column:
    """The cell of a key, null where the key is missing."""
    return F.try_element_at(F.col(column) if isinstance(column, str) else column, F.lit(key))


def has(column: str | Column, key: str) -> Column:
    return get(column, key).isNotNull()


def _bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def equals(column: str | Column, key: str, wanted: Any) -> Column:
    """Whether the property equals a Python value of the same type; Null equals Null, a missing key equals nothing."""
    c, w = get(column, key), cell(wanted)
    same = c["t"] == F.lit(w["t"])
    if w["t"] == DOUBLE:
        d = c["d"]
        if w["d"] != w["d"]:
            same = same & F.isnan(d)
        else:
            sign = d.cast("string").startswith("-")
            same = same & (d == F.lit(w["d"])) & (F.lit(True) if w["d"] else (sign if _bits(w["d"]) < 0 else ~sign))
    elif w["t"] != NULL:
        same = same & (c[_SLOT[w["t"]]] == F.lit(w[_SLOT[w["t"]]]))
    return F.coalesce(same, F.lit(False))


def _compare(column: str | Column, key: str, wanted: Any, than) -> Column:
    """Order within one type: numbers of the same kind and strings; everything else is false."""
    c, w = get(column, key), cell(wanted)
    if w["t"] not in (INT, DOUBLE, STRING):
        return F.lit(False)
    slot = _SLOT[w["t"]]
    return F.coalesce((c["t"] == F.lit(w["t"])) & than(c[slot], F.lit(w[slot])), F.lit(False))


def greater(column: str | Column, key: str, wanted: Any) -> Column:
    return _compare(column, key, wanted, lambda a, b: a > b)


def less(column: str | Column, key: str, wanted: Any) -> Column:
    return _compare(column, key, wanted, lambda a, b: a < b)


def number(column: str | Column, key: str) -> Column:
    """Int and Double values as double; null for other types and missing keys."""
    c = get(column, key)
    return F.when(c["t"] == INT, c["i"].cast("double")).when(c["t"] == DOUBLE, c["d"])


def string(column: str | Column, key: str) -> Column:
    c = get(column, key)
    return F.when(c["t"] == STRING, c["s"])


def packed(**columns: Column) -> Column:
    """A property map from typed columns: whole numbers Int, floats Double, text String, booleans Bool; null values Null."""
    pairs = []
    for key, c in columns.items():
        kind = F.typeof(c)
        tag = F.when(c.isNull(), NULL).when(kind.isin("bigint", "int", "smallint", "tinyint"), INT).when(kind.isin("double", "float"), DOUBLE).when(kind == "boolean", BOOL).otherwise(STRING)
        pairs += [F.lit(key), F.struct(tag.cast("byte").alias("t"), F.when(tag == INT, c.cast("string").try_cast("bigint")).alias("i"), F.when(tag == DOUBLE, c.cast("string").try_cast("double")).alias("d"), F.when(tag == STRING, c.cast("string")).alias("s"), F.when(tag == BOOL, c.cast("string").try_cast("boolean")).alias("b"))]
    return F.create_map(*pairs)

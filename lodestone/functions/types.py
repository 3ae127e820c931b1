"""SQL type names and their Spark types; implicit widening; parsers of typed text."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Type names of the dialect -> Spark type. Lengths of character types are not enforced.
NAMES = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "float": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "real": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "char": T.StringType(), "varchar": T.StringType(), "string": T.StringType(), "text": T.StringType(),
    "bytea": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "interval": T.CalendarIntervalType() if hasattr(T, "CalendarIntervalType") else T.DayTimeIntervalType(),
}
UNSIZED_DECIMAL = (38, 18)


def parse_type(text: str) -> T.DataType:
    """The Spark type of a type name such as DECIMAL(15,2), VARCHAR(25) or VECTOR(3)."""
    m = re.fullmatch(r"\s*([a-z]+(?:\s+precision)?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text.lower())
    if not m:
        raise ValueError(f"unknown type: {text}")
    name, a, b = re.sub(r"\s+", " ", m[1]), m[2], m[3]
    if name in ("decimal", "numeric"):
        return T.DecimalType(int(a), int(b or 0)) if a else T.DecimalType(*UNSIZED_DECIMAL)
    if name == "vector":
        return T.ArrayType(T.DoubleType(), False)
    if name not in NAMES:
        raise ValueError(f"unknown type: {text}")
    return NAMES[name]


def vector_size(text: str) -> int | None:
    m = re.fullmatch(r"\s*vector\s*\(\s*(\d+)\s*\)\s*", text.lower())
    return int(m[1]) if m else None


#: From narrow to wide; what is not in an order together does not widen.
ORDERS = (
    ("void", "boolean", "int", "bigint", "double", "decimal", "string", "binary"),
    ("void", "date", "string"),
    ("void", "interval", "string"),
)


def _kind(t: T.DataType) -> str:
    name = t.simpleString().split("(")[0]
    return "interval" if name.startswith("interval") else name


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that both sides of a CASE or a VALUES column become; an error where there is none."""
    if a == b:
        return a
    x, y = _kind(a), _kind(b)
    if x == y == "decimal":
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    for order in ORDERS:
        if x in order and y in order:
            return a if order.index(x) >= order.index(y) else b
    raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")


#: Fixed unit names of interval text, in months, days and milliseconds.
UNITS = {"year": (12, 0, 0), "month": (1, 0, 0), "mon": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3_600_000), "minute": (0, 0, 60_000), "second": (0, 0, 1000)}


def parse_interval(text: str) -> tuple[int, int, int]:
    """(months, days, milliseconds) of text like '1 year 2 months -3 days'."""
    words = text.lower().split()
    if len(words) % 2:
        raise ValueError(f"invalid interval: {text}")
    total = [0, 0, 0]
    for number, unit in zip(words[::2], words[1::2]):
        per = UNITS.get(unit.removesuffix("s"))
        if per is None:
            raise ValueError(f"invalid interval: {text}")
        for k in range(3):
            total[k] += int(number) * per[k]
    return tuple(total)


def interval_sql(text: str) -> str:
    """A Spark interval expression of mixed units."""
    months, days, ms = parse_interval(text)
    return f"make_interval(0, {months}, 0, {days}, 0, 0, {ms / 1000})"

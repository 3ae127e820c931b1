"""Scalar functions whose semantics Spark's own don't give, as compositions of built-in expressions.

Each exists as a Column function; those that translated statements need exist as SQL text too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def safe_div(a, b) -> Column:
    """a / b; null where b is 0 or null."""
    return _col(a) / F.nullif(_col(b), F.lit(0))


def int_div(a, b) -> Column:
    """The integer quotient, truncated; null where b is 0 or null."""
    b = F.nullif(_col(b), F.lit(0))
    return F.call_function("div", _col(a), b)


def safe_mod(a, b) -> Column:
    """The remainder with the sign of a; null where b is 0 or null."""
    return _col(a) % F.nullif(_col(b), F.lit(0))


def xor(a, b) -> Column:
    """Exclusive or, null if either is."""
    return _col(a) != _col(b)


def substring_from_for(s, start, length=2**31 - 1) -> Column:
    """Characters of s from place `start` (1: the first; 0: one before it; negative: from the end) over `length`
    places; a negative length takes those to the left of the start."""
    s, a, b = _col(s), _col(start).cast("bigint"), _col(length).cast("bigint")
    n = F.char_length(s).cast("bigint")
    begin = F.when(a >= 0, a - 1).otherwise(n + a)
    low, high = F.least(begin, begin + b), F.greatest(begin, begin + b)
    skip = F.greatest(low, F.lit(0))
    return F.substring(s, (F.least(skip, n) + 1).cast("int"), F.least(F.greatest(high - skip, F.lit(0)), n).cast("int"))


def replace_all(s, old, new) -> Column:
    """Every occurrence of old by new; an empty old puts new before each character and at the end."""
    s, old, new = _col(s), _col(old), _col(new)
    spread = F.concat(new, F.array_join(F.transform(F.split(s, ""), lambda ch: F.concat(ch, new)), ""))
    return F.when((old == "") & (s != ""), spread).when(old == "", new).otherwise(F.replace(s, old, new))


def parse_vector(s) -> Column:
    """'[1, 2, 3]' as array<double>."""
    return F.from_json(_col(s), "array<double>")


def checked_vector(v, size: int) -> Column:
    """v, or an error where it has another length."""
    v = _col(v)
    return F.when(v.isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} dimensions, not "), F.size(v).cast("string"))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _doubles(v) -> Column:
    return _col(v).cast("array<double>")


def l2_distance(a, b) -> Column:
    """The Euclidean distance."""
    square = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def cosine_distance(a, b) -> Column:
    """1 less the cosine; null where either is of length 0."""
    a, b = _doubles(a), _doubles(b)
    return F.lit(1.0) - _dot(a, b) / F.nullif(F.sqrt(_dot(a, a) * _dot(b, b)), F.lit(0.0))


def negative_inner_product(a, b) -> Column:
    return -_dot(_doubles(a), _doubles(b))


def parse_blob(s) -> Column:
    r"""Bytes of text in which \xHH stands for one byte; other text stands for its UTF-8. `\x` must be followed by
    two hexadecimal digits, and a backslash otherwise by an `x`."""
    s = _col(s)
    bad = F.rlike(F.regexp_replace(s, F.lit(r"\\x[0-9A-Fa-f]{2}"), F.lit("")), F.lit(r"\\"))
    parts = F.regexp_extract_all(s, F.lit(r"(?s)\\x([0-9A-Fa-f]{2})|([^\\]+)"), F.lit(0))
    hexes = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("\\x")), F.upper(F.substring(p, 3, 2))).otherwise(F.hex(F.encode(p, "utf-8"))))
    return F.when(bad, F.raise_error(F.lit("invalid escape in bytes"))).otherwise(F.unhex(F.array_join(hexes, "")))


def show_blob(b) -> Column:
    r"""Text of bytes: printable ASCII as it is (but for the backslash), others as \xHH."""
    hexes = F.regexp_extract_all(F.hex(_col(b)), F.lit("(..)"), F.lit(1))
    shown = F.transform(hexes, lambda h: F.when((F.conv(h, 16, 10).cast("int").between(32, 126)) & (h != "5C"), F.decode(F.unhex(h), "utf-8")).otherwise(F.concat(F.lit("\\x"), h)))
    return F.array_join(shown, "")


def parse_bool(s) -> Column:
    """'true' and 'false' in any case; an error otherwise."""
    low = F.lower(_col(s))
    return F.when(low == "true", True).when(low == "false", False).when(low.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.concat(F.lit("invalid boolean: "), low)))


#: SQL text of the same, for translated statements; lambda variables start with an underscore.
SQL_TEXT = {
    "substr": "substring({s}, CAST(least(greatest(least({st}, {st} + {b}), 0L), CAST(length({s}) AS BIGINT)) + 1 AS INT), CAST(least(greatest(greatest({st}, {st} + {b}) - greatest(least({st}, {st} + {b}), 0L), 0L), CAST(length({s}) AS BIGINT)) AS INT))",
    "replace": "CASE WHEN {o} = '' AND {s} <> '' THEN concat({n}, array_join(transform(split({s}, ''), _ch -> concat(_ch, {n})), '')) WHEN {o} = '' THEN {n} ELSE replace({s}, {o}, {n}) END",
    "dot": "aggregate(zip_with(CAST({a} AS ARRAY<DOUBLE>), CAST({b} AS ARRAY<DOUBLE>), (_x, _y) -> _x * _y), 0D, (_s, _v) -> _s + _v)",
    "<->": "sqrt(aggregate(zip_with(CAST({a} AS ARRAY<DOUBLE>), CAST({b} AS ARRAY<DOUBLE>), (_x, _y) -> (_x - _y) * (_x - _y)), 0D, (_s, _v) -> _s + _v))",
    "blob": r"unhex(array_join(transform(regexp_extract_all({s}, '(?s)\\\\x([0-9A-Fa-f]{{2}})|([^\\\\]+)', 0), _p -> if(startswith(_p, '\\x'), upper(substring(_p, 3, 2)), hex(encode(_p, 'utf-8')))), ''))",
}


def substr_sql(s: str, a: str, b: str) -> str:
    start = f"(if(CAST({a} AS BIGINT) >= 0, CAST({a} AS BIGINT) - 1, length({s}) + CAST({a} AS BIGINT)))"
    return SQL_TEXT["substr"].format(s=s, st=start, b=f"CAST({b} AS BIGINT)")


def replace_sql(s: str, old: str, new: str) -> str:
    return SQL_TEXT["replace"].format(s=s, o=old, n=new)


def blob_sql(s: str) -> str:
    return SQL_TEXT["blob"].format(s=s)


def distance_sql(operator: str, a: str, b: str) -> str:
    dot = lambda x, y: SQL_TEXT["dot"].format(a=x, b=y)
    if operator == "<->":
        return SQL_TEXT["<->"].format(a=a, b=b)
    if operator == "<=>":
        return f"(1D - {dot(a, b)} / nullif(sqrt({dot(a, a)} * {dot(b, b)}), 0D))"
    return f"(- {dot(a, b)})"

"""Joins, selections and orders as plans that Catalyst finishes.

Nothing here chooses a physical strategy unless asked: `hint` names one ("broadcast", "merge",
"shuffle_hash", "shuffle_replicate_nl")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def _names(keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in keys]


def equi_condition(left: DataFrame, right: DataFrame, keys, null_safe: bool = False) -> Column:
    """Equality of key columns: names, or pairs of a left and a right name. null_safe: null equals null."""
    terms = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in _names(keys)]
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def join(left: DataFrame, right: DataFrame, keys=(), how: str = "inner", residual: Column | None = None, null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Any join: equality of keys, a further condition (residual) or both, or neither (cross).

    With keys, Spark hashes or sorts; without, it compares all pairs of rows, so the smaller side should be
    small. A residual belongs to the join: for outer kinds, rows that fail it stay unmatched."""
    if how not in KINDS:
        raise ValueError(f"how must be one of {', '.join(KINDS)}")
    if hint:
        right = right.hint(hint)
    cond = equi_condition(left, right, keys, null_safe) if keys else None
    if residual is not None:
        cond = residual if cond is None else cond & residual
    if cond is None:
        return left.crossJoin(right) if how in ("inner", "cross") else left.join(right, F.lit(True), KINDS[how])
    return left.join(right, cond, KINDS["inner" if how == "cross" else how])


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row in order of each combination of keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + n in order: each task keeps that many, so nothing is sorted as a whole."""
    out = df.orderBy(*order)
    return out.offset(offset).limit(n) if offset else out.limit(n)


def running(df: DataFrame, value: str, out: str, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """The sum of value over the rows so far, by rows (ties count one by one), in each partition."""
    w = (Window.partitionBy(*partition) if partition else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def assert_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error at a null in one of the columns."""
    ok = F.lit(True)
    for x in columns:
        ok = ok & F.when(F.col(x).isNull(), F.raise_error(F.lit(f"null in column {x}"))).otherwise(F.lit(True))
    return df.where(ok)

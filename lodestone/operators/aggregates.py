"""Aggregates beside Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value, key) -> Column:
    """The value at the smallest key: what `first` means once an order is named."""
    return F.min_by(value, key)


def last_by(value, key) -> Column:
    return F.max_by(value, key)


def count_distinct_with_null(value: str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(F.col(value)) + F.coalesce(F.max(F.col(value).isNull().cast("int")), F.lit(0))


def average(value) -> Column:
    """The mean as a double, of whole numbers too."""
    return F.avg(value).cast("double")


def salted_sum(df: DataFrame, keys: list[str], value: str, out: str, salts: int = 16) -> DataFrame:
    """Sums of a key that holds most rows, in two steps. Spark's own partial sums make this needless for sums;
    it serves values that don't combine before the exchange."""
    salt = F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), F.lit(salts))
    part = df.groupBy(*keys, salt.alias("_salt")).agg(F.sum(value).alias("_part"))
    return part.groupBy(*keys).agg(F.sum("_part").alias(out))


def column_statistics(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls and distinct values (estimated within 2 %), in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(df.columns):
        aggs += [F.sum(F.col(f"`{name}`").isNull().cast("long")).alias(f"z{i}"), F.approx_count_distinct(F.col(f"`{name}`"), 0.02).alias(f"d{i}")]
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col("n").alias("rows"), F.coalesce(f"z{i}", F.lit(0)).alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, name in enumerate(df.columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")

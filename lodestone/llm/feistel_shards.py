"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

The position of a row in the shuffled order is a bijection of its number, so shard and slot follow by
arithmetic, without a sort of random keys, and can be computed (or inverted) for any row alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import c, free_names, global_row_number

ROUNDS = 4
#: A walk leaves the domain's padding with probability over 1/2 a step, so this many steps never run out.
STEPS = 256


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half for numbers below n."""
    bits = max(2, (max(1, n) - 1).bit_length())
    return bits // 2, bits - bits // 2


def round_keys(seed: int) -> list[int]:
    """One key a round, by the splitmix64 step."""
    keys, x, m = [], seed & ((1 << 64) - 1), (1 << 64) - 1
    for _ in range(ROUNDS):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        keys.append((z ^ (z >> 31)) >> 1)
    return keys


def feistel_sql(x: str, n: int, seed: int) -> str:
    """SQL for one pass of the network over the bits that hold n numbers. The halves swap their widths each round."""
    left, right = widths(n)
    steps = ", ".join(f"struct({k}L AS k, {(1 << (left if i % 2 == 0 else right)) - 1}L AS mask)" for i, k in enumerate(round_keys(seed)))
    start = f"struct(shiftrightunsigned({x}, {right}) AS l, {x} & {(1 << right) - 1}L AS r)"
    return f"aggregate(array({steps}), {start}, (s, p) -> struct(s.r AS l, s.l ^ (xxhash64(s.r, p.k) & p.mask) AS r), s -> shiftleft(s.l, {right}) | s.r)"


def permuted(x: str, n: int, seed: int):
    """The place of number x (0 to n-1) in the permutation of n numbers: passes are repeated until the value is below n."""
    once = feistel_sql("v", n, seed)
    walk = f"aggregate(sequence(2, {STEPS}), {feistel_sql(x, n, seed)}, (v, i) -> if(v < {n}L, v, {once}))"
    return F.expr(f"aggregate(array({walk}), CAST(NULL AS BIGINT), (a, v) -> if(v < {n}L, v, raise_error('cycle walk did not end')))")


def feistel_shards(df: DataFrame, shards: int, order_by: list[str], seed: int = 2024) -> DataFrame:
    """df's columns and row_number, position, shard (0 to shards-1), slot (gapless from 0 in each shard).

    Row numbers follow order_by (nulls first, ties by a hash of the row; rows equal in all columns take
    their places in any order). Shard sizes differ by one at most. An empty table gives an empty result.
    Columns of df that have an output's name are replaced."""
    if shards < 1:
        raise ValueError("at least one shard")
    names = ["row_number", "position", "shard", "slot"]
    number, place = free_names(df, "_number", "_place")
    rows = global_row_number(df, order_by, number)
    n = rows.count()
    at = permuted(f"`{number}`", max(n, 1), seed)
    rows = rows.withColumn(place, at)
    rest = [c(x) for x in df.columns if x.lower() not in names]
    return rows.select(*rest, F.col(number).alias("row_number"), F.col(place).alias("position"), F.pmod(F.col(place), F.lit(shards)).cast("int").alias("shard"), F.floor(F.col(place) / F.lit(shards)).cast("long").alias("slot"))


def op10_feistel_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = feistel_shards(slim, 40, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

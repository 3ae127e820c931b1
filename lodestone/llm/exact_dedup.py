"""Exact duplicates by content sort.

Normalised texts are range-partitioned at sampled splitters of their first characters (then hash and
salt), sorted externally within partitions, and runs of neighbours that are equal in full are groups.
A text that holds a large share of all rows is salted, so that its run is spread over partitions; such
texts are few (a bound follows from the number of partitions), and their totals are joined back as a
broadcast of that bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import c, free_names, partitions, row_hash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 16
#: Keys with more than 1/(SHARE * partitions) of the rows are salted; there are at most SHARE * partitions of them.
SHARE = 4


def normalised(text):
    """A-Z in lower case, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """df's columns and keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the smallest (or, keep="largest", largest) id stays. A null text
    counts as empty. Null ids stand behind all others; of rows with equal text and id one stays. keep_id is
    null where all ids of the group are. An empty table gives an empty result. Columns of df that have an
    output's name are replaced; other columns pass through."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = df.sparkSession
    n = partitions(spark)
    out = ["keep_id", "group_size", "kept", "text_sha256"]
    norm, h, prefix, salt, salts, tie, best, size, rank, hot_h, hot_sha, hot_best, hot_size, sha = free_names(
        df, "_norm", "_h", "_prefix", "_salt", "_salts", "_tie", "_best", "_size", "_rank", "_hot_h", "_hot_sha", "_hot_best", "_hot_size", "_sha"
    )
    extreme = F.min if keep == "smallest" else F.max

    keyed = df.withColumn(norm, normalised(c(text_col))).withColumn(h, F.xxhash64(F.col(norm)))
    # Texts in so many copies that a single task would feel it.
    counted = df.select(F.xxhash64(normalised(c(text_col))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = df.count()
    most = max(1, total // (SHARE * n))
    hot = [(r.h, -(-r.n // most)) for r in counted.where(F.col("n") > most).collect()] if total else []

    hot_keys = spark.createDataFrame(hot, f"`{hot_h}` long, `{salts}` long")
    if hot:
        keyed = keyed.join(F.broadcast(hot_keys), F.col(h) == F.col(hot_h), "left").drop(hot_h)
        keyed = keyed.withColumn(salt, F.when(F.col(salts).isNull(), F.lit(0)).otherwise(F.pmod(F.hash(c(id_col)).cast("long"), F.col(salts)))).drop(salts)
    keyed = keyed.withColumn(prefix, F.substring(F.col(norm), 1, PREFIX)).withColumn(tie, row_hash(df))
    split_by = [prefix, h, salt] if hot else [prefix, h]
    ranged = keyed.repartitionByRange(n, *split_by)

    by = Window.partitionBy(*split_by, norm)  # the range exchange has placed these together
    ordered = by.orderBy(c(id_col).asc_nulls_last() if keep == "smallest" else c(id_col).desc_nulls_last(), F.col(tie))
    runs = (
        ranged.withColumn(rank, F.row_number().over(ordered))
        .withColumn(best, extreme(c(id_col)).over(by))
        .withColumn(size, F.count(F.lit(1)).over(by))
        .withColumn(sha, F.sha2(F.col(norm), 256))
    )
    mine = F.col(rank) == 1
    if hot:
        totals = (
            df.withColumn(norm, normalised(c(text_col)))
            .withColumn(hot_h, F.xxhash64(F.col(norm)))
            .join(F.broadcast(hot_keys.select(hot_h)), hot_h, "left_semi")
            .groupBy(hot_h, norm)
            .agg(extreme(c(id_col)).alias(hot_best), F.count(F.lit(1)).alias(hot_size))
            .select(hot_h, F.sha2(F.col(norm), 256).alias(hot_sha), hot_best, hot_size)
        )
        runs = runs.join(F.broadcast(totals), (F.col(h) == F.col(hot_h)) & (F.col(sha) == F.col(hot_sha)), "left")
        mine = mine & (F.col(hot_size).isNull() | F.col(best).eqNullSafe(F.col(hot_best)))
        best_col, size_col = F.when(F.col(hot_size).isNull(), F.col(best)).otherwise(F.col(hot_best)), F.coalesce(F.col(hot_size), F.col(size))
        # Null ids share one salt, and a salt without any other id must not keep a second row.
        mine = mine & (c(id_col).eqNullSafe(best_col))
    else:
        best_col, size_col = F.col(best), F.col(size)
    rest = [c(n) for n in df.columns if n.lower() not in out]
    return runs.select(*rest, best_col.alias("keep_id"), size_col.alias("group_size"), mine.alias("kept"), F.col(sha).alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

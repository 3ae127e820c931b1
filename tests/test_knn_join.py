import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import vector_index as V


def all_pairs(queries, df, k, metric):
    """The definition, by the expressions of functions.scalar."""
    pairs = df.crossJoin(queries).withColumn("distance", V.DISTANCES[metric](F.col("v"), F.col("qv")))
    w = Window.partitionBy("qk").orderBy(F.col("distance").asc_nulls_last(), "k")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qk", "k", "distance", "rank")


def rows(df):
    return sorted((repr(r.qk), r["rank"], r.k, None if r.distance is None else "nan" if math.isnan(r.distance) else r.distance + 0.0) for r in df.collect())


def vectors(seed):
    """Random ones, equal ones, ties (a lattice), nulls, other lengths, zeros, and numbers at the ends of doubles."""
    r = random.Random(seed)
    found = [[r.gauss(0, 1) for _ in range(3)] for _ in range(120)] + [[0.25, -1.0, 2.0]] * 40
    found += [[float(r.randrange(-1, 2)) for _ in range(3)] for _ in range(120)]
    found += [None, [], [], [1.0], [1.0, None, 2.0], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 1.0], [-math.inf, 0.0, 1.0], [1e200, 1e200, 1.0], [1e-200, 1e-200, 0.0], [1e-170, 0.0, 0.0], [1e75, 1.0, 1e75], [1e8, 1e8, 1e8], [1e8, 1e8, 1e8 + 1]]
    r.shuffle(found)
    return found


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("k,groups,blocks", [(5, 1, 1), (1, 4, 3), (300, 2, 2)])
def test_odd_vectors(spark, monkeypatch, metric, k, groups, blocks):
    a, b = vectors(1), vectors(2)
    a += b[:30]
    q = spark.createDataFrame([(i, v) for i, v in enumerate(a[::3])], "qk long, qv array<double>").localCheckpoint()
    df = spark.createDataFrame([(f"é{i % 250}" if i % 50 else None, v) for i, v in enumerate(b)], "k string, v array<double>").localCheckpoint()
    monkeypatch.setattr(V, "GROUP_BYTES", -(-q.count() * 24 // groups))
    monkeypatch.setattr(V, "BLOCK_BYTES", 1 if blocks > 1 else 1 << 40)
    got = V.knn_join(q, df, "qk", "qv", "k", "v", k, metric)
    got, want = rows(got), rows(all_pairs(q, df, k, metric))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r for r, s in zip(got, want) if r != s] == []


def test_groups_meet_blocks_without_broadcast(spark, sf, monkeypatch):
    """Before, all queries were broadcast and every pair was a row of a nested-loop join."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("k"), F.col("embedding").alias("v"))
    q = e.where("k % 20 = 0").select(F.col("k").alias("qk"), F.col("v").alias("qv"))
    monkeypatch.setattr(V, "GROUP_BYTES", 5000, raising=False)
    monkeypatch.setattr(V, "BLOCK_BYTES", 20_000, raising=False)
    got = V.knn_join(q, e, "qk", "qv", "k", "v", 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    assert rows(got) == rows(all_pairs(q, e, 5, "l2"))


def test_rows_without_distance_tie_by_key(spark):
    """A null vector and vectors of length 0 have no cosine distance alike; later blocks of rows don't change that."""
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 1, F.array(F.lit(0.0), F.lit(0.0))).alias("v"))
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "qk long, qv array<double>")
    got = V.knn_join(q, df, "qk", "qv", "k", "v", 4, "cosine")
    assert [(r.qk, r.k) for r in got.orderBy("qk", "rank").collect()] == [(n, k) for n in (1, 2, 3) for k in range(4)]
    assert got.where("distance is not null").count() == 0


def test_no_rows(spark):
    e = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    q = e.select(F.col("k").alias("qk"), F.col("v").alias("qv"))
    assert V.knn_join(q.limit(0), e, "qk", "qv", "k", "v", 2).count() == 0
    assert V.knn_join(q, e.limit(0), "qk", "qv", "k", "v", 2).count() == 0
    assert V.knn_join(q, e, "qk", "qv", "k", "v", 0).count() == 0
    assert V.knn_join(q, e, "qk", "qv", "k", "v", 2).first().distance == 0.0

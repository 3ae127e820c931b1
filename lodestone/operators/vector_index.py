"""Nearest neighbours: exact, and by an inverted-list (IVF-Flat) index.

The index clusters a bounded sample, assigns every row to its nearest centroid, and is written partitioned by
list, so that a probe reads only the lists it needs. With as many probes as lists the answer is exact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import cosine_distance, l2_distance, negative_inner_product

DISTANCES = {"l2": l2_distance, "cosine": cosine_distance, "ip": negative_inner_product}
#: Rows that the centroids are fitted on.
SAMPLE = 100_000
#: knn_join: bytes of vectors in a group of queries, and in a block of rows where there are partitions enough.
GROUP_BYTES, BLOCK_BYTES = 32 << 20, 2 << 20


def knn(df: DataFrame, vector_col: str, query: list[float], k: int, metric: str = "l2", key: str | None = None, nulls_first: bool = False) -> DataFrame:
    """The k rows nearest to query, with `distance`, ties by key: a scan that keeps k rows a task."""
    d = DISTANCES[metric](F.col(vector_col), F.lit([float(x) for x in query]))
    d_order = F.col("distance").asc_nulls_first() if nulls_first else F.col("distance").asc_nulls_last()
    order = [d_order] + ([F.col(key)] if key else [])
    return df.withColumn("distance", d).orderBy(*order).limit(k)


def knn_join(queries: DataFrame, df: DataFrame, query_key: str, query_col: str, key: str, vector_col: str, k: int, metric: str = "l2") -> DataFrame:
    """For each row of queries the k nearest rows of df: query_key, key, distance, rank; ties by key, rows without a
    distance last.

    All pairs are met, as exact neighbours of vectors of many dimensions ask for: groups of queries that fit
    GROUP_BYTES times blocks of rows, a task each. A task holds its group and streams its block, pairs are met by
    products of matrices (nearest.py), and only what can be among a query's k nearest leaves a task. Each row is sent
    once a group, each query once a block; blocks are as many as rows have BLOCK_BYTES by Spark's estimate, and at
    most the shuffle partitions."""
    from .nearest import search

    DISTANCES[metric]
    q = queries.select(F.col(query_key).alias("_qk"), F.col(query_col).alias("_v"))
    rows = df.select(F.col(key).alias("_k"), F.col(vector_col).alias("_v"))
    if {dict(x.dtypes)["_v"] for x in (q, rows)} != {"array<float>"}:
        q, rows = (x.withColumn("_v", F.col("_v").cast("array<double>")) for x in (q, rows))
    many, longest = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    groups = max(1, -(-many * 8 * max(longest, 1) // GROUP_BYTES))
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    blocks = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimate // BLOCK_BYTES)))
    null = lambda x, name: F.lit(None).cast(x.schema[name].dataType).alias(name)
    of = lambda name, n: F.pmod(F.xxhash64(name, "_v"), F.lit(n)).cast("int")
    group, block = of("_qk", groups), of("_k", blocks) * groups
    met = q.select(F.explode(F.sequence(group, group + (blocks - 1) * groups, F.lit(groups))).alias("_cell"), F.lit(0).alias("_side"), "_qk", null(rows, "_k"), "_v")
    met = met.union(rows.select(F.explode(F.sequence(block, block + (groups - 1))).alias("_cell"), F.lit(1).alias("_side"), null(q, "_qk"), "_k", "_v"))
    met = met.repartitionById(blocks * groups, F.col("_cell")).sortWithinPartitions("_cell", "_side", "_k")
    kinds = T.StructType([T.StructField("_qk", q.schema["_qk"].dataType), T.StructField("_k", rows.schema["_k"].dataType), T.StructField("distance", T.DoubleType())])
    most = max(k, 1)
    ranked = met.mapInArrow(lambda batches: search(batches, most, metric), kinds)
    w = Window.partitionBy("_qk").orderBy(F.col("distance").asc_nulls_last(), "_k")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_qk").alias(query_key), F.col("_k").alias(key), "distance", "rank")


@dataclass
class IvfFlat:
    """An index: rows with their list (a table partitioned by list), and the lists' centroids (as many as lists)."""

    rows: DataFrame
    centroids: list[list[float]]
    vector_col: str
    metric: str

    @staticmethod
    def build(df: DataFrame, vector_col: str, nlists: int, metric: str = "l2", path: str | None = None, seed: int = 1) -> IvfFlat | None:
        """Fit centroids on at most SAMPLE rows and assign every row; None if fewer than two have a vector. path: where
        the index is written; without, it is a plan. Rows without a vector are in list -1, which every search reads."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        vec = F.col(vector_col).cast("array<double>")
        if metric == "cosine":
            norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v))
            vec = F.transform(vec, lambda x: x / F.nullif(norm, F.lit(0.0)))
        full = df.where(F.col(vector_col).isNotNull())
        total = full.count()
        if total < 2:
            return None
        nlists = min(nlists, total)
        fit_on = full.sample(min(1.0, SAMPLE / total), seed).limit(SAMPLE) if total > SAMPLE else full
        model = KMeans(k=nlists, seed=seed, maxIter=15, featuresCol="_f").fit(fit_on.select(array_to_vector(vec).alias("_f")))
        centroids = [[float(x) for x in v] for v in model.clusterCenters()]
        near = F.array_min(F.array(*[F.struct(l2_distance(vec, F.lit(v)).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(centroids)])).getField("i")
        rows = df.withColumn("_list", F.when(F.col(vector_col).isNull(), -1).otherwise(near))
        if path:
            # Some tasks a list, so that a large one is not one task's; a task writes few lists' files.
            rows.repartition("_list", F.pmod(F.xxhash64(vector_col), F.lit(8))).write.mode("overwrite").partitionBy("_list").parquet(path)
            rows = df.sparkSession.read.parquet(path)
        return IvfFlat(rows, centroids, vector_col, metric)

    def lists_for(self, query: list[float], nprobe: int) -> list[int]:
        """The lists whose centroids are nearest to query; on the driver, over as many numbers as there are lists."""
        import math

        q = [float(x) for x in query]
        if self.metric == "cosine":
            n = math.sqrt(sum(x * x for x in q)) or 1.0
            q = [x / n for x in q]
        far = [(sum((a - b) ** 2 for a, b in zip(q, v)), i) for i, v in enumerate(self.centroids)]
        return [i for _, i in sorted(far)[:nprobe]]

    def search(self, query: list[float], k: int, nprobe: int, key: str | None = None, nulls_first: bool = False) -> DataFrame:
        """The k nearest rows among those of the nprobe nearest lists: other lists' files are not read. Rows without a
        vector come last, or first as in a plain ORDER BY."""
        some = self.rows.where(F.col("_list").isin([-1, *self.lists_for(query, nprobe)]))
        return knn(some, self.vector_col, query, k, self.metric, key, nulls_first).drop("_list")

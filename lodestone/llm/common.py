"""What the operators share: the shared scratch folder, cut lineage, free column names, row numbers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_shipped: set[str] = set()
_memories: list[dict] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(_own_root[app])
    return _own_root[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and lost executors lose nothing."""
    path = path or scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """For what runs Python on executors: Arrow batches of few rows (documents may be long, and a batch is held
    in memory whole), and this package on the workers' path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).parents[1]
        archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))  # Spark serves it to all executors
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def claim(cache: dict | None = None) -> None:
    """Called by a task before it uses its module's memory of words (or one of its own: None). A worker that has
    served other operators before drops theirs, so that it holds one at a time."""
    for other in _memories:
        if other is not cache and other:
            other.clear()
            _give_back()
    if cache is not None and not any(other is cache for other in _memories):
        _memories.append(cache)


def _give_back() -> None:
    """Freed memory to the system: a worker stays, and what it keeps counts against its executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def free_names(df: DataFrame, *bases: str) -> list[str]:
    return [free_name(df, b) for b in bases]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def c(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame):
    """A hash of all columns that can be hashed, to order rows that tie elsewhere."""
    cols = [c(n) for n, t in df.dtypes if "map<" not in t and t not in ("variant", "void")]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def global_row_number(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df with the gapless number (from 0) of each row in ascending order of keys, ties by a hash of the row.

    One range exchange; partition sizes (one number a partition) give the offsets. Written once, so that
    both passes see the same order."""
    spark = df.sparkSession
    tie, mid = free_names(df, "_tie", "_mid")
    order = [c(k) for k in keys] + [F.col(tie)]
    ranged = (
        df.withColumn(tie, row_hash(df))
        .repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .drop(tie)
        .withColumn(mid, F.monotonically_increasing_id())
    )
    kept = saved(ranged, "rownum")
    part = F.shiftright(F.col(mid), 33)
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    rows, at = [], 0
    for p, n in counts:
        rows.append((p, at))
        at += n
    pcol, ocol = free_names(df, "_part", "_offset")
    offsets = spark.createDataFrame(rows, f"`{pcol}` long, `{ocol}` long")  # a row for each partition
    joined = kept.withColumn(pcol, part).join(F.broadcast(offsets), pcol)
    number = (F.col(ocol) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).alias(out)
    return joined.select(*[c(n) for n in df.columns], number)

"""Tables from parquet folders and delimited text; delimited text as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The driver's tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """t.orders is the DataFrame of <folder>/orders.parquet; only what a query selects is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names=TABLES) -> None:
    """A temporary view for each table."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", quote: str = '"', escape: str | None = None, header: bool = False) -> DataFrame:
    """Rows of delimited text. An empty field is null whatever its type; one delimiter may stand at the end of a
    line; a line of another number of fields is an error. Nothing is inferred, so the file is read once."""
    probe = T.StructType([*schema.fields, T.StructField("_end", T.StringType()), T.StructField("_bad", T.StringType())])
    probe = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.BinaryType, T.ArrayType)) else f.dataType) for f in probe.fields])
    reader = spark.read.schema(probe).option("sep", delimiter).option("quote", quote).option("header", header).option("nullValue", "").option("emptyValue", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    reader = reader.option("escape", escape or quote)
    rows = reader.csv(path)
    # Too few fields (the one behind the last delimiter may be missing) or too many make the record corrupt.
    n = len(schema.fields)
    split_at = "[" + ("\\" if delimiter in "\\^]" else "") + delimiter + "]"
    fields = F.size(F.split(F.regexp_replace(F.col("_bad"), f"{quote}[^{quote}]*{quote}", ""), split_at))
    wrong = F.col("_bad").isNotNull() & ~((fields == n) | ((fields == n + 1) & F.coalesce(F.col("_end") == "", F.lit(True))))
    from ..functions.scalar import parse_blob, parse_vector

    def own(f):
        if isinstance(f.dataType, T.BinaryType):
            return parse_blob(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return parse_vector(F.col(f"`{f.name}`")).alias(f.name)
        return F.col(f"`{f.name}`")

    checked = rows.withColumn("_ok", F.when(wrong, F.raise_error(F.concat(F.lit("wrong fields: "), F.col("_bad")))).otherwise(F.lit(True))).where("_ok")
    return checked.select(*[own(f) for f in schema.fields])


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', escape: str | None = None, header: bool = False, single: bool = False) -> int:
    """Write df as delimited text below path and return the number of rows, counted while writing. single: one file,
    written by one task."""
    from ..functions.scalar import show_blob

    cols = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            x = show_blob(x)
        elif isinstance(f.dataType, T.ArrayType):
            x = F.to_json(x)
        elif f.dataType.simpleString().startswith("interval"):
            x = x.cast("string")
        cols.append(x.alias(f.name))
    seen = Observation()
    out = df.select(*cols).observe(seen, F.count(F.lit(1)).alias("n"))
    (out.coalesce(1) if single else out).write.mode("overwrite").option("sep", delimiter).option("quote", quote).option("escape", escape or quote).option("header", header).option("emptyValue", "").csv(path)
    return int(seen.get["n"])

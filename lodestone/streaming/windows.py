"""Event-time windows over a stream of parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(spark, sf_dir: str, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Rows in each window and event type, after all files there are have been read once.

    The result is whole (complete mode): every window's state is kept, and late rows count too."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    counts = (
        stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    )
    name = f"tumbling_{uuid.uuid4().hex}"
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)

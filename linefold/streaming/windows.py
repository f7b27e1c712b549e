"""Windowed counts as a stream. An extension: the batch forms are the operators proper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import own_dir


def windowed_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Per tumbling window and event type: n, sum of values; for batch frames and streams."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if w.isStreaming:
        w = w.withWatermark("ts", "1 hour")
    g = w.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    """Read a Parquet table as a stream, all that is available, and give the final counts.

    Each micro-batch overwrites the result table with the complete state, so a restarted
    batch cannot count twice.
    """
    here = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    folder, name = path.rstrip("/").rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    q = (
        windowed_counts(source, width).writeStream.outputMode("complete").option("checkpointLocation", f"{here}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{here}/out")).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{here}/out")

"""An extension: sliding realised variance of an event stream, with late events dropped by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import shared_folder


def sliding_variance(events: DataFrame, width: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """(event_type, start, n, variance) of value over sliding windows; each window is emitted once, when the watermark passes it."""
    timed = events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("variance"))
    return out.select("event_type", F.col("window.start").alias("start"), "n", "variance")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the events table as it is now, to a table; ends when all is read."""
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that a file and a folder both do
    query = sliding_variance(source).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{where}/out")

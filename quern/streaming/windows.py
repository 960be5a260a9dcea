"""Counts of events in time windows, over tables or streams with late data (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str | None = None) -> DataFrame:
    """win_start, keys and n. `late` is how long a stream's windows wait for late rows; their state ends then."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("win_start"), *keys, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregated stream over all that is there now, and returns its result as a table written to path. Each batch writes the whole result anew, so a batch
    that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    spark = stream.sparkSession
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(stream.schema).parquet(path) if there else spark.createDataFrame([], stream.schema)

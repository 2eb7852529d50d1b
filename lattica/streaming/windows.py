"""Event-time windows over a stream: an extension beside the array operators. A batch run gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of each window; late: how far behind rows of a stream may come."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, n) of each run of a user's events with no longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


def run_once(spark: SparkSession, folder: str, name: str, f, sink: str) -> DataFrame:
    """f over a table read as a stream, until all that is there is done; the complete result."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.endswith(".parquet") else f"{folder}/{name}*.parquet")
    q = f(stream).writeStream.outputMode("complete").format("memory").queryName(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(sink)

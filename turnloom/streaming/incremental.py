"""Sessions and edges over streams of events, for input that arrives all the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.operators import network


def event_sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user of a stream with ``ts`` and ``user_id``; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_events")


def write_scene_edges(rows: DataFrame, tie: list[str], path: str, checkpoint: str, **weights: float) -> StreamingQuery:
    """Scene edges of a stream that delivers whole scenes: each batch's edges are appended as one parquet folder by batch
    number, so a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        network.scene_edges(network.turns(df, tie), **weights).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""An extension: demand that arrives as a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_demand(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Demand of each cell (user_id) in tumbling windows of ts; the watermark bounds the state. Works on streams and tables."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("cell_id")).agg(F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("window_start"), "cell_id", "value")


def stream_access(events: DataFrame, model: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Run a model on the demand of each finished batch of windows."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(model(df.groupBy("cell_id").agg(F.sum("value").alias("value"))), epoch)

    return windowed_demand(events, window, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).start()

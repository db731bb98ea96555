"""The value table of a stream, kept as one folder a micro-batch, and counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaykit.operators.values import value_table


def follow(stream: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's value table to its own folder below ``path``.

    A batch that is repeated after a failure overwrites its folder, so no cell counts twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        value_table(batch.select(*columns) if columns else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    """field, position, native_type, raw, cnt over all batches so far."""
    return spark.read.parquet(path).groupBy("field", "position", "native_type", "raw").agg(F.sum("cnt").alias("cnt"))


def windowed(stream: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """start, key, cnt and (with a value) its sum in event-time windows; rows later than ``delay`` are left out. Works on tables too."""
    t = F.col(time).cast("timestamp") if stream.isStreaming else F.col(time)
    rows = stream.select(t.alias("_t"), F.col(key).alias("key"), *([value.alias("_v")] if value is not None else []))
    if stream.isStreaming:
        rows = rows.withWatermark("_t", delay)
    return rows.groupBy(F.window("_t", width).alias("w"), "key").agg(F.count("*").alias("cnt"), *([F.sum("_v").alias("total")] if value is not None else [])).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "key", "cnt", *(["total"] if value is not None else []))

"""The same operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def resample_stream(df: DataFrame, time: str, step: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Maximum and mean by key and tumbling window; a window is given out once the watermark has passed it. The event time must be a timestamp with time zone."""
    return df.withWatermark(time, late).groupBy(key, F.window(time, step)).agg(F.max(value).alias("peak"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias(time), "peak", "mean")


def dedupe_stream(df: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions_stream(df: DataFrame, time: str, key: str, value: str, threshold: float, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of values at the threshold or above, broken by a gap in time."""
    on = df.withWatermark(time, late).where(F.col(value) >= threshold)
    return on.groupBy(key, F.session_window(time, gap)).agg(F.max(value).alias("peak"), F.count("*").alias("n")).select(key, F.col("session_window.start").alias("onset"), "peak", "n")


def write_batches(df: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> DataStreamWriter:
    """A stream into a Parquet layer, a folder a batch: a batch that is run again after a failure takes its own folder's place, so no row comes twice."""

    def put(rows: DataFrame, batch: int) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/batch={batch}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)

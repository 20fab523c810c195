"""Live observations as Structured Streaming: deduplication, windows, first receipts, late rows flagged."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener


def source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """A folder of files as a stream; progress is kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def deduplicated(stream: DataFrame, keys: list[str], clock: str, delay: str) -> DataFrame:
    """The first row of each key; state is held as long as the watermark's delay, no longer."""
    return stream.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, clock: str, delay: str, width: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Tumbling or sliding counts and sums; late rows beyond the delay go."""
    window = F.window(clock, width, slide) if slide else F.window(clock, width)
    sums = stream.withWatermark(clock, delay).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def flagged(stream: DataFrame, event: str, receipt: str, late_seconds: int) -> DataFrame:
    """Rows with their lag and whether it is beyond the bound; nothing is dropped."""
    lag = F.unix_micros(receipt) - F.unix_micros(event)
    return stream.withColumn("lag_us", lag).withColumn("late", lag > late_seconds * 1_000_000)


def run_to_end(frame: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Work through what is there and read the result back from Parquet; nothing is collected. In complete mode each
    batch writes a version of its own, and the last one is the result."""
    spark = frame.sparkSession
    if mode == "append":
        append_to(frame, path, checkpoint).awaitTermination()
        return spark.read.schema(frame.schema).parquet(path)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")
        last.append(number)

    stream = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/version={max(last)}")


def append_to(frame: DataFrame, path: str, checkpoint: str):
    """Append to Parquet exactly once per batch."""
    return frame.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Heartbeat(StreamingQueryListener):
    """Keeps the last progress of each query by name: batch, rows and watermark; ``stale`` names the silent ones."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.last[event.name or str(event.id)] = {"batch": None, "rows": 0, "watermark": None, "at": time.monotonic()}

    def onQueryProgress(self, event):
        p = event.progress
        self.last[p.name or str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "watermark": p.eventTime.get("watermark"), "at": time.monotonic()}

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def stale(self, seconds: float) -> list[str]:
        return sorted(n for n, p in self.last.items() if time.monotonic() - p["at"] > seconds)


def first_receipts(stream: DataFrame, keys: list[str], clock: str, delay: str, receipt: str) -> DataFrame:
    """Per key the earliest receipt within the watermark's windows of an hour; state goes as the watermark passes."""
    return stream.withWatermark(clock, delay).groupBy(F.window(clock, "1 hour"), *keys).agg(F.min(receipt).alias("first_receipt")).select(*keys, F.col("window.start").alias("hour"), "first_receipt")

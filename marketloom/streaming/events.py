"""Structured Streaming counterparts: ingestion by upsert, duplicates within a watermark, windows, sessions, near duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketloom.sources.tables import upsert


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions that upsert_to wrote under `path`, in order; the last one is the table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}/_SUCCESS"))]


def upsert_to(path: str, keys: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the batch replaces rows of equal keys (its last row of a key wins by ts). Each batch writes a
    new version under `path` and is skipped if that version is complete, so a batch that is run again changes nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = versions(spark, path)
        if number in done:
            return
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        before = [n for n in done if n < number]
        out = upsert(spark.read.parquet(f"{path}/v{before[-1]}"), new, keys) if before else new
        out.write.mode("overwrite").parquet(f"{path}/v{number}")

    return sink


def distinct_within(df: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key; state is dropped behind the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, width: str = "1 day", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type."""
    d = df.withWatermark(ts, delay) if df.isStreaming else df
    d = d.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "15 minutes", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    d = df.withWatermark(ts, delay) if df.isStreaming else df
    return d.groupBy(F.window(ts, width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "30 minutes", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    d = df.withWatermark(ts, delay) if df.isStreaming else df
    return d.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what there is now into a memory table."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q

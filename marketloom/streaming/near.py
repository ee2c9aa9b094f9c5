"""Near duplicates of a stream: each item is decided once, by the items that were kept before it, with bounded state.

1. A stateful operator finds candidates. An item goes to four groups, by the 16-bit blocks of its fingerprint; a pair within three
   bits agrees in one of them. A group's state holds the fingerprints seen there with their first item, packed as one value that
   is read and written once a micro-batch, and forgets each after a time to live. Equal fingerprints share an entry, so thousands
   of equal titles are one.
2. Each micro-batch is resolved as the batch form does: an item goes if a candidate was kept, in a batch before or in this one.
   What is kept is a table by batch; a batch that is run again overwrites its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.operators.evaluation import complete
from marketloom.operators.hotspot import greedy_gone

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EarlierNear(StatefulProcessor):
    """For each item the earlier ones of its group whose fingerprint differs in at most `distance` bits."""

    def __init__(self, distance: int, ttl_ms: int):
        self.distance, self.ttl_ms = distance, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("entries", "packed binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("k", kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        packed = self.seen.get()
        known = np.frombuffer(bytes(packed[0]) if packed else b"", "<i8").reshape(3, -1)
        known = known[:, known[2] + self.ttl_ms > now]
        has = pdf["has"].to_numpy(bool)  # a column of its own, as pandas has no null among whole numbers
        place = np.flatnonzero(has)
        near, fresh = earlier_near(known[:2], pdf["k"].to_numpy("i8")[has], pdf["p"].to_numpy("i8")[has], self.distance)
        if fresh.shape[1]:
            every = np.hstack([known, np.vstack([fresh, np.full(fresh.shape[1], now, "i8")])])
            self.seen.update((every.astype("<i8").tobytes(),))
        lists: list = [[]] * len(pdf)
        for i, found in zip(place, near, strict=True):
            lists[i] = found
        yield pd.DataFrame({"k": pdf["k"].astype("int64"), "near": lists})

    def close(self) -> None:
        return


def earlier_near(known: np.ndarray, k: np.ndarray, p: np.ndarray, distance: int, cells: int = 1 << 20) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of the items k, p, in order, the k of the entries before it within `distance` bits; and the new entries.

    An entry is the first item with its fingerprint: a column of `known` (k and p), or an item here. About `cells` pairs of
    fingerprints are compared at a time.
    """
    prints, first, of = np.unique(p, return_index=True, return_inverse=True)
    new = np.sort(first[~np.isin(prints, known[1])])
    fresh = np.vstack([k[new], p[new]])
    entries = np.hstack([known, fresh])
    since = np.append(np.full(known.shape[1], -1), new)
    near, step = [], max(1, cells // max(1, entries.shape[1]))
    for a in range(0, len(prints), step):
        apart = np.bitwise_count(prints[a : a + step, None].view("u8") ^ entries[1].view("u8"))
        near += [np.flatnonzero(row <= distance) for row in apart]
    return [entries[0][at[since[at] < i]] for i, at in enumerate(near[x] for x in of)], fresh


def candidates(items: DataFrame, key: str, print_col: str, distance: int = 3, ttl_ms: int = 86_400_000, groups: int = 1024) -> DataFrame:
    """k, near (array of earlier k) of a stream, up to four rows an item. `key` is a long that grows in order of arrival.

    A block's values are dealt into `groups` states: a state is called once for each that a micro-batch touches and compares an
    item with all it holds, so few items a batch want few groups, a long time to live wants many: about one for each thousand of
    items that live at a time. Results are the same.
    """
    p = F.col(print_col)
    blocks = F.array(*[F.concat(F.lit(f"{i}:"), (F.shiftrightunsigned(p, 16 * i).bitwiseAND(0xFFFF) % groups).cast("string")) for i in range(4)])
    alone = F.array(F.concat(F.lit("none:"), F.pmod(F.col(key), F.lit(groups)).cast("string")))  # without a fingerprint: kept, and no state
    rows = items.select(F.col(key).cast("long").alias("k"), F.coalesce(p.cast("long"), F.lit(0)).alias("p"), p.isNotNull().alias("has"), F.explode(F.when(p.isNull(), alone).otherwise(blocks)).alias("block"))
    return rows.groupBy("block").transformWithStateInPandas(EarlierNear(distance, ttl_ms), "k long, near array<long>", "Append", "ProcessingTime")


def keep_first(path: str, ttl_ms: int = 86_400_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for candidates(): writes the kept items of each batch to a folder of its own under `path`."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = batch.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).persist()
        try:
            edges = found.select(F.explode("near").alias("a"), F.col("k").alias("b"))
            before = kept_items(spark, path, below=number).where(F.col("at") > F.current_timestamp() - F.expr(f"INTERVAL {ttl_ms // 1000} SECONDS"))
            gone = edges.join(before.select(F.col("k").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct()
            inside = edges.join(found.select(F.col("k").alias("a")), "a", "left_semi")
            inside = inside.join(gone, F.col("a") == F.col("n"), "left_anti").join(gone, F.col("b") == F.col("n"), "left_anti")
            kept = found.select("k").join(gone, F.col("k") == F.col("n"), "left_anti")
            more = greedy_gone(inside)
            if more is not None:
                kept = kept.join(more, F.col("k") == F.col("n"), "left_anti")
            kept.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        finally:
            found.unpersist()

    return sink


def kept_items(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """k, at: the items kept so far, in batches before number `below`."""
    names = [n for n in complete(spark, path) if below is None or n < f"batch={below:012d}"]
    return spark.read.schema("k long, at timestamp").parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], "k long, at timestamp")


def run_near(items: DataFrame, key: str, print_col: str, path: str, distance: int = 3, ttl_ms: int = 86_400_000, groups: int = 1024) -> DataFrame:
    """Runs the stream over what there is now; the kept items so far. `path` holds them and the checkpoint."""
    spark = items.sparkSession
    # With a time to live, Spark would run batches without data for ever.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    was = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        q = candidates(items, key, print_col, distance, ttl_ms, groups).writeStream.foreachBatch(keep_first(f"{path}/kept", ttl_ms))
        q.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    return kept_items(spark, f"{path}/kept")

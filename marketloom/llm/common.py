"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # then lower() touches A-Z only, and is much faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of id and text (binary). Rows that agree in both are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))))


def trim() -> None:
    """Gives freed memory back to the system, as Python and its libraries keep some for later use."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def trim_driver(spark: SparkSession) -> None:
    """The same for the driver, Python and JVM. The JVM lets garbage lie while its heap has room, and what its compiler and plans
    took outside the heap stays with the C library, a share for each thread; over hundreds of short jobs both add up."""
    trim()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.java.lang.System.gc()
    kinds, values = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
    with contextlib.suppress(Py4JJavaError):  # a JVM or a system without it
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` over batches; what it allocated is given back to the system at its end. Python workers outlive their tasks, and
    an executor has several, each of which would keep the most that it ever used."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        trim()

    return run


def parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `most` bytes in a column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most)))
        yield batch.slice(begin, end - begin)
        begin = end


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (tests, local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs in here go as each job ends. Else they stay until the driver collects the job's plan as garbage,
    so that those of several jobs may lie there together."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that a lost executor costs no recomputation from the start."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(df.sparkSession)  # what went through the driver on the way here is no longer needed
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable node for each node of `edges` (a, b: long, undirected, null-free).

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one aggregation and one join, and
    the number of rounds is logarithmic in the size of a component. Returns (node, component); nodes without an edge to
    another node are not listed. An empty input gives an empty result.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, tasks = None, 0
    for _ in range(max_rounds):
        # A round is short where edges are few, so it takes no more tasks than they need.
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:  # a forest of stars is a fixed point
            break
        before, tasks = now, max(8, now.n // 50_000)
        old, e = e, e.coalesce(tasks)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).select(F.col("a").alias("n"), "m")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n")).select("a", "b", "m").coalesce(tasks)
        e = cut(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct().coalesce(tasks))
        forget(old)
    else:
        raise RuntimeError("connected components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())

"""Append-only JSON logs: broken lines are kept apart and counted, the newest lines come first without sorting all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROKEN = "_broken"


def append_log(df: DataFrame, path: str) -> None:
    """Adds the rows as lines, in files of their own."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of `schema`, and _broken: the text of a line that is no such JSON object (then the rest is null)."""
    return spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN).option("mode", "PERMISSIVE").json(path)


def newest(log: DataFrame, ts: str, n: int, *ties: Column | str) -> DataFrame:
    """The n newest lines that are not broken: every task keeps its own n, so nothing else is sorted or moved."""
    return log.where(F.col(BROKEN).isNull()).orderBy(F.desc(ts), *ties).limit(n).drop(BROKEN)


def log_counts(log: DataFrame, ts: str) -> DataFrame:
    """date, lines, broken: lines by date; broken ones, which have none, under a null date."""
    day = F.to_date(ts)
    return log.groupBy(day.alias("date")).agg(F.count_if(F.col(BROKEN).isNull()).alias("lines"), F.count_if(F.col(BROKEN).isNotNull()).alias("broken"))


def divergence_counts(divergent: DataFrame) -> DataFrame:
    """date, n, largest: the log of two sources' divergence, by date."""
    return divergent.groupBy("date").agg(F.count("*").alias("n"), F.max("diff").alias("largest"))


def tag_suspects(bars: DataFrame, divergent: DataFrame) -> DataFrame:
    """bars with `source` marked where the price diverged (code, date); the mark is part of the source from here on."""
    bad = divergent.select("code", "date").distinct().withColumn("_bad", F.lit(True))
    return bars.join(bad, ["code", "date"], "left").withColumn("source", F.when(F.col("_bad"), F.concat("source", F.lit("_suspect"))).otherwise(F.col("source"))).drop("_bad")

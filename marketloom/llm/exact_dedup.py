"""Exact dedup: skew-safe combining, in DataFrame operations only.

1. Texts are combined inside each input partition (Spark's map-side aggregation), so a partition sends one row for each
   different text, however many copies it holds.
2. Those rows are merged in digest groups salted by the partition they come from.
3. The winners of the salts are merged globally.

Both merges group by the digests and by the whole text, so texts are equal only if every character is. Afterwards the
groups are looked up by digest alone: had two different texts the same SHA-256, MD5 and length, two groups would be left
for one key, and the job stops with an error instead of mixing them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, read


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays. Null texts
    count as empty and empty texts are equal to each other. Rows whose id is null belong to their group and are counted,
    and stay only if no row of the group has an id. Rows that share the largest id all stay. Other columns of `df` are
    not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("t"))
    rows = rows.withColumn("sha", F.sha2("t", 256)).withColumn("key", F.concat(F.unhex("sha"), F.unhex(F.md5("t")), F.encode(F.length("t").cast("string"), "utf-8")))
    salted = rows.groupBy("key", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy("key", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = whole.groupBy("key").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    groups = groups.select(
        F.concat("key").alias("k"),
        F.sha1("key").alias("k1"),  # a key of its own, so that the join is dealt anew and its hot partitions can be split
        "keep_id",
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share SHA-256, MD5 and length"))).otherwise(F.col("n")).alias("group_size"),
    )
    rows = rows.select("id", "sha", F.sha1("key").alias("k1"))
    out = rows.join(groups.select("k1", "keep_id", "group_size"), "k1")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), same.alias("kept"), F.col("sha").alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE_SQL = {
    "op1_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
}

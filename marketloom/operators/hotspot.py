"""Text stream items: exact and near duplicates by title, parsing of signals, and their aggregates."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the six blocks of a fingerprint start and end.
_CUTS = (0, 11, 22, 33, 44, 54, 64)


def dedup_exact(df: DataFrame, text: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each text. Only keys and order columns are aggregated, with partial sums, so hot texts are safe."""
    keyed = df.withColumn("_h", F.md5(F.coalesce(F.col(text), F.lit(""))))
    first = keyed.groupBy("_h").agg(F.min(F.struct(*order)).alias("_f"))
    out = keyed.join(first.select(F.unhex("_h").alias("_k"), "_f"), F.unhex("_h") == F.col("_k"))
    return out.where(F.struct(*order) == F.col("_f")).drop("_h", "_k", "_f")


_SPACE = re.compile(r"[ \t-\r]+")


def simhash(text: Column) -> Column:
    """64-bit SimHash of the character pairs of a text without white space, as a signed long; null for texts under two characters.

    In Arrow batches: each distinct pair is hashed once in a task and its votes count as often as it occurs.
    """

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits: dict[int, np.ndarray] = {}
        for s in batches:
            out: list[int | None] = []
            for t in s:
                c = np.frombuffer(_SPACE.sub("", t).encode("utf-32-le"), "<u4").astype(np.int64)
                if len(c) < 2:
                    out.append(None)
                    continue
                pairs, n = np.unique(c[:-1] << 32 | c[1:], return_counts=True)
                for p in pairs.tolist():
                    if p not in bits:
                        h = hashlib.md5((chr(p >> 32) + chr(p & 0xFFFFFFFF)).encode()).digest()[:8]
                        bits[p] = np.unpackbits(np.frombuffer(h, np.uint8)).astype(np.int64) * 2 - 1
                votes = n @ np.stack([bits[p] for p in pairs.tolist()])
                out.append(int(np.packbits(votes > 0).view(">i8")[0]))
            yield pd.Series(out, dtype="Int64")

    return prints(F.coalesce(text, F.lit("")))


def near_pairs(df: DataFrame, key: str, print_col: str, distance: int = 3) -> DataFrame:
    """(a, b) with a < b whose fingerprints differ in at most `distance` <= 3 bits. By the pigeonhole principle such a
    pair agrees in three of six blocks of 10 or 11 bits, so it meets by one of 20 keys of 30 bits or more; equal
    fingerprints meet only through their first row."""
    firsts = df.where(F.col(print_col).isNotNull()).groupBy(print_col).agg(F.min(key).alias("_k"))
    p = F.col(print_col)
    masks = F.array(*[F.lit(sum(((1 << _CUTS[i + 1]) - (1 << _CUTS[i])) for i in c) - ((1 << 64) if 5 in c else 0)).cast("long") for c in combinations(range(6), 3)])
    bands = firsts.select("_k", p, F.posexplode(F.transform(masks, lambda m: p.bitwiseAND(m))).alias("band", "v")).withColumnsRenamed({"_k": "k", print_col: "p"})
    a, b = bands.alias("a"), bands.alias("b")
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.k") < F.col("b.k")) & (F.bit_count(F.col("a.p").bitwiseXOR(F.col("b.p"))) <= distance))
    pairs = near.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    same = df.join(firsts, print_col).where(F.col("_k") < F.col(key)).select(F.col("_k").alias("a"), F.col(key).alias("b"))
    return pairs.unionByName(same)


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a checkpoint in the session's shared folder; a temporary one only where it names none."""
    s = df.sparkSession
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marketloom-"))
    return df.checkpoint(eager=True)


def greedy_gone(edges: DataFrame) -> DataFrame | None:
    """n: what goes if each node, in order, is kept unless a smaller neighbour was. edges: a < b. None for no edges.

    Rounds of joins: a node without a smaller neighbour left is kept, and its larger neighbours go. Rounds are as many as the
    longest chain of decisions; most groups need one.
    """
    gone = None
    edges = _cut(edges.select("a", "b").distinct())
    while not edges.isEmpty():
        heads = edges.select(F.col("a").alias("n")).distinct().join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_anti")
        out = _cut(edges.join(heads, F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("n")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = _cut(edges.join(out, F.col("a") == F.col("n"), "left_anti").join(out, F.col("b") == F.col("n"), "left_anti"))
    return gone


def dedup_near(df: DataFrame, key: str, print_col: str, distance: int = 3) -> DataFrame:
    """The rows kept by comparing each, in order of `key`, with those kept before it; rows without a fingerprint stay.

    `key` is unique and not null. Rows with an equal fingerprint share the fate of their first.
    """
    firsts = df.where(F.col(print_col).isNotNull()).groupBy(print_col).agg(F.min(key).alias("_k"))
    gone = greedy_gone(near_pairs(firsts.withColumnRenamed("_k", key), key, print_col, distance))
    kept = firsts if gone is None else firsts.join(gone, F.col("_k") == F.col("n"), "left_anti")
    return df.where(F.col(print_col).isNull()).unionByName(df.join(kept.select(F.col("_k").alias(key)), key, "left_semi").select(df.columns))


def daily_stats(df: DataFrame) -> DataFrame:
    """date: counts by sign of score, and the mean score."""
    n = lambda c: F.count_if(c)
    return df.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), n(F.col("score") > 0).alias("positive"), n(F.col("score") < 0).alias("negative"), n(F.col("score") == 0).alias("neutral"), F.avg("score").alias("avg_score"))


def by_code(df: DataFrame) -> DataFrame:
    """code: the weighted mean score of the items that name it; items without impact weigh 0.1."""
    w = F.when(F.coalesce("impact", F.lit(0.0)) == 0, 0.1).otherwise(F.col("impact"))
    d = df.select(F.explode("codes").alias("code"), "score", w.alias("w"))
    return d.groupBy("code").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("n"))

"""Line dedup over overlapping windows of three consecutive lines.

Every window of a text is hashed; a hash that occurs more than once is a repeated passage. Its first occurrence, by
document id and line, stays; the lines under all later occurrences are removed, overlapping ones merged. A removed line
always has a copy further ahead, so following copies to the front ends at one that stays: no content is lost.

Passages that do not follow lines are removed in the same way by `dedup_passages`, over windows of 51 words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import cut, lean, parts, read, row_key
from marketloom.llm.ngram_join import bitmap, in_bitmap


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(_key, covered): the numbers (from 1) of the lines to remove from each document that has any."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    docs = df.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("id"), lines.alias("ls"))
    joined = lambda i: F.array_join(F.slice("ls", i, window), "\n")
    blank = "\n" * (window - 1)
    hashes = F.transform(F.sequence(F.lit(1), F.size("ls") - (window - 1)), lambda i: F.when(joined(i) != blank, F.md5(joined(i))))
    windows = docs.where(F.size("ls") >= window).select("_key", "id", F.posexplode(hashes).alias("pos", "h")).where("h IS NOT NULL")
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "_key", "pos")
    firsts = windows.groupBy("h").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.withColumn("k", F.unhex("h")).join(firsts.select(F.unhex("h").alias("k"), "first"), "k").where(F.col("first") != at)  # on k: dealt anew, so hot windows can be split
    return later.select("_key", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("line")).groupBy("_key").agg(F.collect_set("line").alias("covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """df with text_col rewritten and two more columns, n_lines and n_removed (long).

    Lines end at \\n and count as equal when identical. Texts of fewer lines than a window are left alone, and windows of
    empty lines are never repeated passages. Null texts count as empty, and become so. Rows with null ids come after all
    others; rows that agree in id and text are one document, and stay alike. Columns of `df` named like the new ones are
    replaced; others go along. An empty table gives an empty result.
    """
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed", "_key", "covered")]
    gone = repeated_lines(df, id_col, text_col, window)
    rows = df.select(*rest, row_key(id_col, text_col).alias("_key")).join(gone, "_key", "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("covered", i + 1)), "\n")
    new = F.when(F.col("covered").isNull(), text).otherwise(kept)
    counts = [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed")]
    return rows.select(*[new.alias(c) if c == text_col else F.col(c) for c in rest], *counts)


_WORDS = re.compile(r"[^ \t-\r]+")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MAX_ROWS = 200_000
_PART_BYTES = 1 << 20  # of texts whose words are held at once; a word takes several times its bytes


def _rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of n numbers: polynomials modulo 2^64, from differences of running sums."""
    size = len(h)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:size], dtype=np.uint64)])
    x = (total[n:] - total[:-n]) * down[: size - n + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two hashes of each word, for each text in turn."""
    words = [_WORDS.findall(t.lower()) for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    codes, names = pd.factorize(flat) if len(flat) else (np.zeros(0, int), flat)
    a, b = (pd.util.hash_array(names, hash_key=key, categorize=False)[codes] if len(flat) else np.zeros(0, np.uint64) for key in ("0123456789abcdef", "fedcba9876543210"))
    at = 0
    for ws in words:
        yield a[at : at + len(ws)], b[at : at + len(ws)]
        at += len(ws)


def _leads(a: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of half windows, for each window the place of the least half window in it): equal windows, equal leads."""
    half = words // 2 + 1
    grams = _rolling(a, half, _BASES[0])
    span = words - half + 1
    return grams, np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)


def _marks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(_key, f): the distinct leads of each text (column t)."""
    for whole in batches:
        for batch in parts(whole, "t", _PART_BYTES):
            keys, fs, n = [], [], 0
            for key, (a, _) in zip(batch.column("_key"), _hashed(batch.column("t").to_pylist()), strict=True):
                if len(a) >= words:
                    grams, lead = _leads(a, words)
                    keys.append((key.as_py(), len(f := grams[np.unique(lead)])))
                    fs.append(f)
                    n += len(f)
            if n:
                yield pa.record_batch({"_key": pa.array([k for k, m in keys for _ in range(m)], pa.binary()), "f": pa.array(np.concatenate(fs).view(np.int64))})


def _may_be_in(keys: DataFrame) -> Column:
    """Whether a row's _key may be one of `keys`, by a bitmap; so that other rows need no exchange."""
    wanted = bitmap(keys.select(F.xxhash64("_key").alias("k")), "k")

    @F.pandas_udf("boolean")
    def may_be(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(wanted.value, k.to_numpy()))

    return may_be(F.xxhash64("_key"))


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """(_key, starts): where (from 0) the windows of `words` words start that occur before, in each document that has any.

    A window's lead is its least hash over half windows, so windows that are equal have equal leads: those whose lead
    occurs once are passed over before the exchange. Windows are told apart by 128-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("id"), text.alias("t")).where(F.length("t") >= 2 * words - 1)
    kind = docs.schema["id"].dataType.simpleString()

    @lean
    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _marks(batches, words)

    @lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "t", _PART_BYTES):
                rows, found = [], batch.column("fs")
                for i, (a, b) in enumerate(_hashed(batch.column("t").to_pylist())):
                    grams, lead = _leads(a, words)
                    pos = np.flatnonzero(np.isin(grams.view(np.int64)[lead], found[i].values.to_numpy(zero_copy_only=False)))
                    rows.append((np.full(len(pos), i), pos, _rolling(a, words, _BASES[0])[pos], _rolling(b, words, _BASES[1])[pos]))
                i, pos, h, g = (np.concatenate(c) for c in zip(*rows, strict=True))
                for k in range(0, len(i), _MAX_ROWS):
                    cut = slice(k, k + _MAX_ROWS)
                    docs_at = pa.array(i[cut])
                    yield pa.record_batch({"h": pa.array(h[cut].view(np.int64)), "g": pa.array(g[cut].view(np.int64)), "_key": batch.column("_key").take(docs_at), "id": batch.column("id").take(docs_at), "pos": pa.array(pos[cut].astype(np.int32))})

    marks = docs.mapInArrow(leads, "_key binary, f long")
    twice = marks.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f")
    found = cut(marks.join(twice, "f").groupBy("_key").agg(F.collect_set("f").alias("fs")))
    out = docs.where(_may_be_in(found)).join(found, "_key").select("_key", "id", "t", "fs").mapInArrow(windows, f"h long, g long, _key binary, id {kind}, pos int")
    w = Window.partitionBy("h", "g").orderBy(F.col("id").isNull(), "id", "_key", "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = out.withColumns({"_first": F.first("_key").over(w), "_pos": F.first("pos").over(w)})
    return first.where((F.col("_first") != F.col("_key")) | (F.col("_pos") != F.col("pos"))).groupBy("_key").agg(F.collect_set("pos").alias("starts"))


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """df with text_col rewritten and two more columns, n_words and n_removed (long).

    Every run of `words` words or more that occurs before, wherever it starts and ends in lines, goes with the white
    space after it; its first occurrence, by id and place, stays. Words end at ASCII white space; case does not count.
    Nulls, repeated rows, clashing columns and empty tables are as for dedup_lines.
    """
    rest = [c for c in df.columns if c not in ("n_words", "n_removed", "_key", "starts", "_new")]
    gone = cut(repeated_words(df, id_col, text_col, words))

    @F.pandas_udf("text string, n_words long, n_removed long")
    @lean
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, starts in batches:
            out = []
            for t, at in zip(text, starts, strict=True):
                spans = [m.start() for m in _WORDS.finditer(t)]
                n = len(spans)
                if at is None:
                    out.append((t, n, 0))
                    continue
                edge = np.zeros(n + 1, np.int64)
                edge[at] += 1
                np.add.at(edge, np.asarray(at) + words, -1)
                off = np.cumsum(edge[:n]) > 0
                spans.append(len(t))
                turn = np.flatnonzero(np.diff(np.concatenate([[True], off, [True]]).astype(np.int8)))  # where kept runs start and end
                kept = "".join(t[spans[a] : spans[b]] for a, b in zip(turn[::2], turn[1::2], strict=True))
                out.append((t[: spans[0]] + kept, n, int(off.sum())))
            yield pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    rewrite = rewrite.asNondeterministic()  # else filters on its results run it once more
    few, text = _may_be_in(gone), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(*rest, row_key(id_col, text_col).alias("_key"))
    told = rows.where(few).join(gone, "_key", "left").withColumn("_new", rewrite(text, F.col("starts"))).drop("starts")
    n_words = F.regexp_count(text, F.lit(_WORDS.pattern)).cast("long")
    same = rows.where(~few).withColumn("_new", F.struct(text.alias("text"), n_words.alias("n_words"), F.lit(0).cast("long").alias("n_removed")))
    rows = told.unionByName(same)
    return rows.select(*[F.col("_new.text").alias(c) if c == text_col else F.col(c) for c in rest], "_new.n_words", "_new.n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cut(dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"))  # read three times
    out = dedup_passages(lines)
    return out.select("doc_id", "n_words", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup, "op6_passage_dedup": op6_passage_dedup}
ORACLE_SQL = {
    "op6_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT doc_id, k, ls FROM d),
w AS (SELECT doc_id, k, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w FROM u, unnest(range(1, len(ls) - 1)) AS x(i)),
r AS (SELECT k, i, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, k, i) AS n FROM w WHERE w <> chr(10) || chr(10)),
c AS (SELECT k, list(DISTINCT i + j) AS covered FROM r, unnest(range(0, 3)) AS y(j) WHERE n > 1 GROUP BY k),
o AS (SELECT doc_id, len(ls) AS n_lines, coalesce(len(covered), 0) AS n_removed,
  CASE WHEN covered IS NULL THEN t ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(covered, i)), lambda i: ls[i]), chr(10)), '') END AS kept
  FROM d LEFT JOIN c USING (k))
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM o
"""
}

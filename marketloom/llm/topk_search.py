"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: a term is a dimension. Candidates are packed into blocks of bounded size, a
table in the shared folder; so are queries. The stated query set is searched in waves: the query blocks of a wave, of
`wave_bytes` at most, are sent to all tasks, and each candidate block, which never moves, meets them one after the other. For
each term, the weights of the queries that have it are scattered over the term's postings into a dense score array (queries x
candidates of the block); a partition selection then keeps k candidates for each query and block, a task merges those of its
blocks, and a window those of the tasks. Every wave writes its part of the result to a table of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import cut, forget, read, shared_dir

EXACT = 2**53  # below this, sums of products of integers are exact in float64
TILE = 32
FOUND = "query_id long, vec_id long, score long"


def integer_weights(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors that are null or hold a null or non-finite component."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda v: F.floor(x(v) * F.lit(scale))))


def _blocks(rows: DataFrame, number: str, size: int) -> DataFrame:
    """Packs rows (number, id, w) into one row per block: ids and weights as little-endian int64, padded to the widest vector."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        width = max(map(len, pdf["w"]), default=0)
        m = np.zeros((len(pdf), width), dtype="<i8")
        for i, w in enumerate(pdf["w"]):
            m[i, : len(w)] = w
        return pd.DataFrame({number: [key[0]], "width": [width], "ids": [pdf["id"].to_numpy(dtype="<i8").tobytes()], "w": [m.tobytes()]})

    return rows.groupBy(number).applyInPandas(pack, f"{number} long, width int, ids binary, w binary")


def _unpack(ids: bytes, w: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(w, dtype="<i8").reshape(len(ids), width)


def _accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of every query (row of q) against every candidate (row of c), a term at a time; exact.

    A tile of queries at a time, so that its scores stay in the cache while the terms go by.
    """
    terms = min(q.shape[1], c.shape[1])
    q, c = q[:, :terms], c[:, :terms]
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    bound = most(q) * most(c) * max(terms, 1)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < EXACT else object
    score = np.zeros((len(q), len(c)), dtype=kind)
    q, postings = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
    full = [bool(np.all(c[:, t] != 0)) for t in range(terms)]
    part = np.empty((TILE, len(c)), dtype=kind)
    for i in range(0, len(q), TILE):
        tile = score[i : i + TILE]
        for t in range(terms):
            weights = q[i : i + TILE, t, None]
            have = np.flatnonzero(weights)
            if len(have) == len(tile) and full[t]:
                tile += np.multiply(weights, postings[t], out=part[: len(tile)])
            elif len(have):
                posting = np.flatnonzero(postings[t])
                if 2 * len(have) > len(tile) and 2 * len(posting) > len(c):
                    tile += np.multiply(weights, postings[t], out=part[: len(tile)])
                else:
                    tile[np.ix_(have, posting)] += np.multiply.outer(q[i + have, t], postings[t, posting])
    return score


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id, in no order; a partition first, then a sort of what may be at the edge."""
    if len(ids) > k:
        edge = sorted(scores, reverse=True)[k - 1] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= edge], scores[scores >= edge]  # with all ties at the edge
        if len(ids) > k:
            first = np.lexsort((ids, [-x for x in scores]))[:k]
            ids, scores = ids[first], scores[first]
    return ids, scores


def top_k_search(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = 2048, query_rows: int = 512, wave_bytes: int = 32 << 20
) -> DataFrame:
    """The k best candidates of every query row by integer inner product: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; a query's own id is no candidate for it; with fewer candidates than k, all are returned.
    Rows whose vector is null or holds a null or non-finite component take no part, nor do rows with a null id. Vectors
    of different lengths are compared over the terms both have; an empty vector scores 0. Repeated ids are candidates
    (and queries) as often as they occur. Scores beyond a long saturate. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), integer_weights(F.col(vector_col), scale).alias("w"), is_query.alias("q")).where("id IS NOT NULL AND w IS NOT NULL")
    total, wanted, width = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    n_blocks, n_query = max(1, -(-total // block_rows)), max(1, -(-wanted // query_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    candidates = cut(_blocks(rows.select("id", "w", deal(n_blocks).alias("cb")), "cb", block_rows))
    queries = cut(_blocks(rows.where("q").select("id", "w", deal(n_query).alias("qb")), "qb", query_rows))
    # Blocks are dealt by hash, so a wave may hold a little more than its share of rows.
    wave = max(1, wave_bytes // (8 * (width + 1) * query_rows))
    tasks = max(1, min(n_blocks, 4 * spark.sparkContext.defaultParallelism))
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    for at in range(0, n_query, wave):
        _search_wave(candidates, queries.where(F.col("qb").between(at, at + wave - 1)), k, tasks, f"{folder}/wave-{at}")
    forget(candidates, queries)
    best = spark.read.schema(FOUND).parquet(f"{folder}/wave-*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_wave(candidates: DataFrame, queries: DataFrame, k: int, tasks: int, path: str) -> None:
    """Writes k candidates for each query of a wave and task (FOUND)."""
    sent = candidates.sparkSession.sparkContext.broadcast([(bytes(r.ids), bytes(r.w), r.width) for r in queries.orderBy("qb").collect()])  # wave_bytes
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = np.empty(0, dtype=np.int64)
        blocks = [_unpack(*b) for b in sent.value]
        best = [[(nothing, nothing)] * len(q_ids) for q_ids, _ in blocks]
        for pdf in batches:
            for r in pdf.itertuples():
                ids, c = _unpack(r.ids, r.w, r.width)
                for (q_ids, q), kept in zip(blocks, best, strict=True):
                    s = _accumulate(q, c)
                    for i, qid in enumerate(q_ids):
                        others = np.flatnonzero(ids != qid)
                        found, v = _best(ids[others], s[i, others], k)
                        v = np.array([min(max(int(x), low), high) for x in v], dtype=np.int64)
                        kept[i] = _best(np.concatenate([kept[i][0], found]), np.concatenate([kept[i][1], v]), k)
        for (q_ids, _), kept in zip(blocks, best, strict=True):
            if kept:
                found = np.concatenate([ids for ids, _ in kept]), np.concatenate([v for _, v in kept])
                yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(ids) for ids, _ in kept]), "vec_id": found[0], "score": found[1]})

    candidates.repartition(tasks, "cb").mapInPandas(score, FOUND).write.parquet(path)
    sent.destroy()


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_topk_search": op9_topk_search}
ORACLE_SQL = {
    "op9_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}

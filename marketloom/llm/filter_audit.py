"""Audit of how document filters interact: what each of them removes, in every order in which they can be applied.

Duplicates, which one of the filters removes, are found by refining a partition of the documents:

1. One pass over the texts gives each document its length in code points, a hash of each of its blocks (the first 256 code
   points, then up to 4096, up to 65536, and the rest) and a mask of the filters it fails.
2. Documents are split by length; those alone in their class are dropped. The rest is split by the hash of the first block,
   and so on: each round deals only what is left of the round before, as narrow rows without texts.
3. The texts of the classes that are left are read again and compared whole: grouped by class and text, which Spark combines
   where the texts are, so that a task sends a text once, however many copies it has. All but the least id are marked.

The marks complete the masks. Counting masks by part is the only aggregation; orders and steps are worked out from at most 32
counts a part, so nothing grows with the number of orders times documents.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import cut, forget, lean, read
from marketloom.llm.ngram_join import bitmap, in_bitmap

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Where blocks of code points start; the last one reaches to the end.
STARTS = (0, 256, 4096, 65536)
CLASS = ["n", *[f"h{i}" for i in range(len(STARTS))]]

_UPPER = bytes(range(65, 91))
_SPECIAL = b"#$%&*|"


def text_mask(text: str) -> int:
    """The filters that a text fails by itself: A, B, C and D as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at the six white space characters of ASCII
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), len(raw) > len(raw.translate(None, _SPECIAL)))
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def block_hashes(text: str, digest: int = 16) -> list[bytes]:
    """A hash of each block; blocks behind the end are empty."""
    ends = [*STARTS[1:], max(len(text), STARTS[-1])]
    return [hashlib.blake2b(text[a:b].encode("utf-8", "surrogatepass"), digest_size=digest).digest() if a < len(text) or not a else b"" for a, b in zip(STARTS, ends, strict=True)]


def _refine(rows: DataFrame) -> DataFrame:
    """The rows of classes with two rows or more, after all rounds."""
    live = rows.select(*CLASS)
    for k in range(1, len(CLASS) + 1):
        twice = live.groupBy(*CLASS[:k]).agg(F.count("*").alias("c")).where("c > 1").drop("c")
        left = cut(live.join(twice, CLASS[:k], "left_semi"))
        if k > 1:
            forget(live)
        live = left
    return live


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", digest: int = 16) -> DataFrame:
    """One row per input row: id, part, mask (int; bit i is set if the row fails filter i of FILTERS).

    A: under 200 words; B: fewer distinct words than half its words; C: more than 2 % of code points in A-Z; D: any of
    #$%&*|; E: identical to the text of a smaller id. Words are runs of other characters than ASCII white space. Null texts
    count as empty and are equal to each other, a null part is the empty string. Null ids are larger than all others and not
    than each other; rows that share the least id of a text all pass E. Long texts count whole. Other columns are not read.
    An empty table gives an empty result. `digest` is the hashes' size in bytes; results do not depend on it, for whole
    texts are compared.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hashes = ", ".join(f"{c} binary" for c in CLASS[1:])

    def described(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("t").to_pylist()
        blocks = [block_hashes(t, digest) for t in texts]
        return [pa.array([len(t) for t in texts], pa.int64()), *[pa.array([b[i] for b in blocks], pa.binary()) for i in range(len(STARTS))], pa.array([text_mask(t) for t in texts], pa.int32())]

    @lean
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), *described(b)], ["id", "part", *CLASS, "mask"])

    rows = cut(docs.mapInArrow(describe, f"id {kind}, part string, n long, {hashes}, mask int"))
    left = _refine(rows)
    wanted = bitmap(left.select(F.xxhash64(*CLASS).alias("k")).distinct(), "k")

    @lean
    def may_be_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(wanted.value, batch.column("k").to_numpy())
            yield batch.filter(pa.array(np.asarray(keep, bool)))

    # Classes by hash again, where the texts are: only texts that may have a copy go through the exchange.
    names = ["id", "part", "t", *CLASS, "mask"]

    @lean
    def describe_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), b.column("t"), *described(b)], names)

    whole = docs.mapInArrow(describe_texts, f"id {kind}, part string, t string, n long, {hashes}, mask int")
    whole = whole.withColumn("k", F.xxhash64(*CLASS))
    copies = whole.mapInArrow(may_be_copies, whole.schema).select(*names)
    groups = copies.groupBy(*CLASS, "t").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    by_class = groups.groupBy(*CLASS).agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.max("size").alias("size"))
    by_class = cut(by_class.where("size > 1"))
    mixed = by_class.where("texts > 1").select(*CLASS)  # different texts with equal hashes: as good as never
    plain = rows.join(by_class.where("texts = 1").select(*CLASS, "least"), CLASS, "left")
    if mixed.isEmpty():
        out = plain.select("id", "part", "mask", "least")
    else:
        again = copies.join(mixed, CLASS, "left_semi")
        exact = again.join(again.groupBy(*CLASS, "t").agg(F.min("id").alias("least")), [*CLASS, "t"])
        out = plain.join(mixed, CLASS, "left_anti").select("id", "part", "mask", "least").unionByName(exact.select("id", "part", "mask", "least"))
    later = F.coalesce(F.col("id") > F.col("least"), F.col("id").isNull() & F.col("least").isNotNull())
    return out.select("id", "part", (F.col("mask") + F.when(later, DUPLICATE).otherwise(0)).cast("int").alias("mask"))


def _steps() -> list[dict]:
    """Every order and step with the masks that are kept, removed there, or fail there after removal."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, bit in enumerate(order):
            before = sum(1 << b for b in order[:k])
            masks = range(1 << len(FILTERS))
            fails = [m for m in masks if m >> bit & 1]
            out.append({
                "filter_order": "".join(FILTERS[b] for b in order), "step": k + 1, "bit": bit,
                "kept": [m for m in masks if not m & (before | 1 << bit)],
                "removed": [m for m in fails if not m & before],
                "redundant": [m for m in fails if m & before],
            })
    return out


def interactions(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. masks: id, part, mask of failure_masks; labels: id_col, quality, toxic.

    A document is good (toxic) if any label row of its id says so; null or missing labels say neither. Without documents
    there is no part and no row.
    """
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = masks.join(of, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(zero("good")).alias("good"), F.sum(zero("toxic")).alias("toxic"))
    every = range(1 << len(FILTERS))
    spread = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in every]).alias(c)
    by_part = counts.groupBy("part").agg(spread("n"), spread("good"), spread("toxic"))
    kind = "array<struct<filter_order:string,step:int,bit:int,kept:array<int>,removed:array<int>,redundant:array<int>>>"
    rows = by_part.select("*", F.explode(F.from_json(F.lit(json.dumps(_steps(), separators=(",", ":"))), kind)).alias("s"))
    total = lambda c, over: F.aggregate(over, F.lit(0).cast("long"), lambda a, m: a + F.get(F.col(c), m))
    orders = len(list(itertools.permutations(FILTERS)))
    # Of the orders, a document that fails j filters is removed by each of these in orders / j.
    share = F.array(*[F.lit(0 if not m else orders // m.bit_count()) for m in every])
    mine = F.filter(F.array(*[F.lit(m) for m in every]), lambda m: m.bitwiseAND(F.expr("shiftleft(1, s.bit)")) > 0)
    shapley = F.aggregate(mine, F.lit(0).cast("long"), lambda a, m: a + F.get("n", m) * F.get(share, m))
    return rows.select(
        "part", "s.filter_order", "s.step", total("n", F.col("s.kept")).alias("kept"), total("n", F.col("s.removed")).alias("removed"), total("n", F.col("s.redundant")).alias("redundant"),
        F.get("n", F.expr("shiftleft(1, s.bit)")).alias("unique_fails"), total("good", F.col("s.removed")).alias("good_lost"), total("toxic", F.col("s.removed")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(failure_masks(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
  CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
c(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c, c d, c e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INT) AS step, substr(filter_order, k, 1) AS filter, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, filter, n, good, toxic, fails, contains(fails, filter) AS here, translate(fails, before, '') = fails AS there FROM m, s),
g AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (there AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (there AND here), 0) AS removed,
  coalesce(sum(n) FILTER (here AND NOT there), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter), 0) AS unique_fails,
  coalesce(sum(good) FILTER (there AND here), 0) AS good_lost, coalesce(sum(toxic) FILTER (there AND here), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g
"""
}

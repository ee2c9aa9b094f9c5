"""Audit of how far sources differ in their use of terms, by a systolic rotation over compressed vectors.

1. Terms are counted where the texts are, by language and source; Spark sums the counts. A term is kept in a language if it
   occurs in enough of its documents.
2. The kept terms of a language are dealt into shards of bounded width. In a shard, every group (a source of the language) is
   a sparse vector of counts; a few groups form a cell, which is one compressed row. The terms that a group uses more than its
   language does are ranked there by a heap for each group, and the heaps of the shards merged.
3. The cells of a shard stay where they are and play a round-robin tournament: in each round every cell meets one other, whose
   compressed vectors are sent to it. A meeting works out the distances of all pairs of groups in both directions. The sums of
   a pair over the shards are added up.

What a task holds is one meeting: two cells of at most CELL groups and WIDTH terms. Only rounds up to `wave` are on their
way at a time; the sums of a wave are written before the next one starts.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import cut, forget, lean, read

SCALE, PRIOR = 1_000_000_000, 5
CELL, WIDTH, MOST_COUNTS = 4, 16384, 200_000

#: Letters stay (A-Z in lower case) and so do all bytes of other code points than ASCII's; the rest separates terms.
_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def probability(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    below = total + PRIOR * terms
    if below < 2**63 // SCALE:
        return 1 + (counts + PRIOR) * SCALE // below
    if below < 2**63 // 1000:  # long division, three digits at a time
        whole, rest = np.divmod(counts + PRIOR, below)
        for _ in range(3):
            digit, rest = np.divmod(rest * 1000, below)
            whole = whole * 1000 + digit
        return 1 + whole
    return np.array([1 + SCALE * (int(c) + PRIOR) // below for c in counts], dtype=np.int64)


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). Nulls count as empty."""
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = df.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "t"))

    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(part)), "source": pa.array([source] * len(part)), "term": pa.array(part, pa.binary()).cast(pa.string()),
                    "n": pa.array([n[x] for x in part], pa.int64()), "docs": pa.array([docs[x] for x in part], pa.int64()),
                })

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "t")), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").translate(_TERMS).split()
                n, docs = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held > MOST_COUNTS:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    out = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def opponent(me: Column, turn: Column, players: Column) -> Column:
    """Whom a player (from 0) meets in a turn of a round-robin tournament, by the circle method. There are one less than `players`
    turns, or as many if their number is odd; then one player has no opponent and gets the number `players`."""
    last = players + players % 2 - 1
    other = F.pmod(turn - me, last)
    return F.when(me == last, F.pmod(turn * ((last + 1) / 2).cast("int"), last)).when(other == me, last).otherwise(other)


def _pack(groups: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> bytes:
    """Groups (number, total, terms, places in order, counts) as one compressed text."""
    head = np.array([len(groups), *[x for number, total, terms, at, _ in groups for x in (number, total, terms, len(at))]], dtype="<i8")
    body = [x.astype("<i8") for *_, at, n in groups for x in (np.diff(at, prepend=0), n)]
    flat = np.concatenate([head, *body])
    return zlib.compress(flat.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)  # by planes: the upper ones are zeros


def _unpack(blob: bytes, width: int) -> list[tuple[int, np.ndarray]]:
    """(number, probability of each of the shard's terms) of each group."""
    flat = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    out, at = [], 1 + 4 * int(flat[0])
    for number, total, terms, size in flat[1:at].reshape(-1, 4):
        dense = np.zeros(width, np.int64)
        dense[np.cumsum(flat[at : at + size])] = flat[at + size : at + 2 * size]
        out.append((int(number), probability(dense, int(total), int(terms))))
        at += 2 * int(size)
    return out


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, cell: int = CELL, width: int = WIDTH, wave: int = 64
) -> DataFrame:
    """For each group (lang, source): part, item, value, rank.

    Terms are runs of letters A-Z (in lower case) and of code points beyond ASCII. Each language keeps the terms that occur
    in `least_docs` of its documents. A group gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the
    sum of its counts over the V kept terms; a language does the same with its own counts. Part `pair` has the sum of |p - q|
    over the kept terms for each other source of the language, part `term` the kept terms that the group holds and whose p
    is above the language's, by p - q, the first `top` of them. Ties go by the item's UTF-8 bytes. All arithmetic is exact.

    Null texts, languages and sources are empty strings. Groups without terms take part, and in a language without kept
    terms all distances are 0. Repeated rows count as often as they occur, long texts count whole, other columns are not
    read. A language with one source has no pairs. An empty table gives an empty result.
    """
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    counts = cut(term_counts(df, text_col, lang_col, source_col))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "lang_n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    shards = F.ceil(F.col("terms") / width).cast("int")

    # Terms get a shard by their hash and a place in it; shards are of about `width` terms.
    placed = kept.join(size, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), shards).cast("int"))
    placed = placed.withColumn("place", (F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).cast("int"))
    entries = cut(counts.select("lang", "source", "term", "n").join(placed.select("lang", "term", "lang_n", "shard", "place"), ["lang", "term"]))
    widths = kept.join(size, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard")).agg(F.count("*").cast("int").alias("width"))

    groups = df.select(empty(lang_col, "lang"), empty(source_col, "source")).distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    roster = groups.join(totals, ["lang", "source"], "left").join(size, "lang", "left").select(
        "lang", "source", zero("total"), zero("terms"), zero("lang_total"), (F.row_number().over(by_lang.orderBy("source")) - 1).alias("number"), F.count("*").over(by_lang).alias("players"),
    )
    roster = cut(roster.withColumns({"cell": F.floor(F.col("number") / cell).cast("int"), "cells": F.ceil(F.col("players") / cell).cast("int")}))
    same = ["lang", "source", "total", "terms", "lang_total", "number", "cell", "cells"]
    bare = roster.select(*same, F.explode(F.sequence(F.lit(0), F.greatest(shards, F.lit(1)) - 1)).alias("shard")).join(widths, ["lang", "shard"], "left")
    # A bare row for each group and shard: groups without entries meet others, too.
    rows = entries.join(roster.select(*same), ["lang", "source"]).unionByName(bare, allowMissingColumns=True)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        """A cell's compressed row, and the first terms of each of its groups."""
        table = table.sort_by([("number", "ascending"), ("place", "ascending")])
        col = {c: table.column(c).to_numpy() for c in ("number", "total", "terms", "lang_total", "n", "lang_n", "place")}
        edges = np.flatnonzero(np.diff(col["number"], prepend=-1))
        packed, firsts = [], []
        for a, b in zip(edges, [*edges[1:], len(table)], strict=True):
            b -= 1  # the bare row comes last, as its place is null
            total, terms = int(col["total"][a]), int(col["terms"][a])
            n = col["n"][a:b].astype(np.int64)
            packed.append((int(col["number"][a]), total, terms, col["place"][a:b].astype(np.int64), n))
            if b > a:
                over = probability(n, total, terms) - probability(col["lang_n"][a:b].astype(np.int64), int(col["lang_total"][a]), terms)
                names = table.column("term").slice(a, b - a)
                at = np.flatnonzero(over > 0)
                best = heapq.nsmallest(top, ((-int(over[i]), names[i].as_py().encode()) for i in at))
                firsts += [(table.column("source")[a].as_py(), name.decode(), -v) for v, name in best]
        lang, shard, number, cells = (x.as_py() for x in key)
        head = {"lang": lang, "shard": shard, "cell": number, "cells": cells}
        out = [head | {"blob": _pack(packed), "width": max((w for w in table.column("width").to_pylist() if w), default=0)}]
        return pa.Table.from_pylist(out + [head | {"source": s, "item": i, "value": v} for s, i, v in firsts], schema=settled)

    settled = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("cell", pa.int32()), ("cells", pa.int32()), ("blob", pa.binary()), ("width", pa.int32()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    cells = cut(rows.groupBy("lang", "shard", "cell", "cells").applyInArrow(settle, "lang string, shard int, cell int, cells int, blob binary, width int, source string, item string, value long"))

    # The tournament. Of two that meet, the one that stays is the lower if their numbers' sum is even; a cell meets itself, too.
    home = cells.where("blob IS NOT NULL").select("lang", "shard", "cell", "cells", "blob", "width")
    turns = home.agg(F.max("cells")).first()[0] or 0
    turns += turns % 2 - 1  # an odd number, as one more player makes them even
    even = F.col("cells") + F.col("cells") % 2
    other = opponent(F.col("cell"), F.col("turn"), F.col("cells"))
    stays = F.when((F.col("cell") + F.col("other")) % 2 == 0, F.least("cell", "other")).otherwise(F.greatest("cell", "other"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        row, out = table.to_pylist()[0], []
        mine = _unpack(row["blob"], row["width"])
        guests = mine if row["guest"] == row["cell"] else _unpack(row["guest_blob"], row["width"])
        for a, p in mine:
            for b, q in guests:
                if guests is not mine or a < b:
                    out.append({"lang": row["lang"], "a": a, "b": b, "value": int(np.abs(p - q).sum())})
        return pa.Table.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())]))

    sums = []
    for first in range(-1, turns, wave):
        # Turn -1 is the meeting of each cell with itself.
        all_turns = F.sequence(F.lit(first), F.least(F.lit(first + wave - 1), even - 2))
        guests = home.where(F.lit(first) <= even - 2).select("*", F.explode(all_turns).alias("turn")).withColumn("other", F.when(F.col("turn") < 0, F.col("cell")).otherwise(other))
        guests = guests.where((F.col("other") < F.col("cells")) & ((F.col("other") == stays) & (F.col("other") != F.col("cell")) | (F.col("turn") < 0)))
        guests = guests.select("lang", "shard", F.col("other").cast("int").alias("cell"), F.col("cell").alias("guest"), F.when(F.col("turn") >= 0, F.col("blob")).alias("guest_blob"))
        met = home.drop("cells").join(guests, ["lang", "shard", "cell"])
        met = met.groupBy("lang", "shard", "cell", "guest").applyInArrow(meet, "lang string, a long, b long, value long")  # one meeting at a time
        sums.append(cut(met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))))
    pairs = sums[0] if sums else home.sparkSession.createDataFrame([], "lang string, a long, b long, value long")
    for more in sums[1:]:
        pairs = pairs.unionByName(more)
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = roster.select("lang", F.col("number").cast("long").alias("a"), "source")
    both = both.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    out = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    out = out.unionByName(cells.where("item IS NOT NULL").select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("int"))
    forget(counts, kept, entries)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE_SQL = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(t, '[A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS m FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT *, sum(n) OVER x AS total, sum(m) OVER x AS lang_total, count(*) OVER x AS v FROM e WINDOW x AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (total + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (m + 5) // (lang_total + 5 * v) AS q FROM f),
pv AS (SELECT lang, source, list(CAST(p AS BIGINT) ORDER BY term) AS p FROM p GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(list_sum(list_transform(range(1, len(x.p) + 1), lambda i: abs(x.p[i] - y.p[i]))), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv x ON x.lang = a.lang AND x.source = a.source LEFT JOIN pv y ON y.lang = b.lang AND y.source = b.source),
o AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o
QUALIFY part = 'pair' OR rank <= 50
"""
}

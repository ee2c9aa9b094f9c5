"""N-gram Jaccard join: exact links between the shingle sets of texts, and the groups they form.

Equal sets are one class. n-grams have a global order: rarer ones first, by a frequency sketch of a sample, then by hash; a
first match of two sets lies in their prefixes. A group of near copies has links between most of its pairs, so pairs are not
listed. Instead:

* Sets that may link meet in clusters: each n-gram of a prefix shared by sets of like size connects them to one hub. Chance
  companions are left out: linked sets share at least k n-grams of their prefixes, so either may forget hubs that stand for fewer than
  k/2 of its own without losing the other.
* In a cluster a set is written as its difference from the cluster's consensus (the n-grams most members have). The
  difference of two sets is that of their differences: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. With a(x) = (100 + t) |dx| -
  (100 - t) |x|, x and y link when a(x) + a(y) <= 2 (100 + t) |dx & dy|.
* Where a(x) + a(y) <= 0 alone, x and y also link to the member of least a: these links form a star.
* Other links need common n-grams in the differences. Those that several sets of a cluster have are partitioned vertically:
  their order (number of sets, then hash) is cut into ranges of equal weight, a set into a segment for each range; partial
  overlaps are counted range by range and summed per pair. Candidate pairs share an n-gram of their prefixes in that order. Of
  n-grams that the same sets share one counts; its sets are first compared with one of them, then only those that are not yet
  in one component.

So no link between different texts is lost, and a group of copies costs about as much as its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import connected_components, cut, forget, lean, read, row_key, trim

SKETCH_BITS, SAMPLE_ROWS = 20, 8192  # the frequency sketch: 2**20 counters of 4 bytes, whatever the input
MOST_BITS = 1 << 29  # the largest bitmap: 64 MB
FRAGMENTS = 4


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of a text of fewer words, one for the whole sequence.

    Words are runs of bytes other than space and \\t to \\r, with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _k(n, t: int):
    """n-grams that linked sets share in their prefixes at least; works on numbers and columns."""
    return 1 + n * (100 - t) // 400


def prefix_size(n: int, t: int) -> int:
    return n - -(-n * t // 100) + _k(n, t)


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of the n-grams of about SAMPLE_ROWS texts by the first bits of their hashes. The order they give decides how
    many n-grams are compared, and never the result."""
    many = texts.count()

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total[(shingle_hashes(t, n) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1  # once for each text
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "c": total[at]})

    sample = texts.sample(min(1.0, SAMPLE_ROWS / max(many, 1)), seed=1)
    found = sample.mapInPandas(count, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()  # a row for each counter
    total = np.zeros(1 << SKETCH_BITS, np.int32)
    total[found.column("at").to_numpy()] = np.minimum(found.column("c").to_numpy(), 2**31 - 1)
    return total


def bitmap(values: DataFrame, c: str):
    """A broadcast bitmap of the low bits of a long column's values, for filters before an exchange: 16 bits a value, and
    MOST_BITS at most. It lets all values through that are in it, and few others; if it fills up, more, which costs time only."""
    n = values.count()
    bits = min(max(1 << 16, 1 << (16 * n).bit_length()), MOST_BITS)
    at = F.col(c).bitwiseAND(F.lit(bits - 1))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << 16, bool)
        block[pdf["p"]] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(block).tobytes()]})

    blocks = values.select(F.shiftright(at, 16).alias("block"), at.bitwiseAND(0xFFFF).cast("int").alias("p")).groupBy("block").applyInPandas(pack, "block long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for b in blocks:
        out[b.block * 8192 : (b.block + 1) * 8192] = np.frombuffer(b.bits, np.uint8)
    return values.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _rekey(c: str):
    """A join key other than the grouping key, so that the join is dealt anew and hot partitions can be split."""
    return F.col(c).bitwiseXOR(F.lit(0x5DEECE66D))


def ngram_jaccard_join(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles (long), class_id, component_id, kept, row_key (see common.row_key).

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles, exactly. class_id is
    the smallest id of equal sets, component_id the smallest reachable by links; both are the row's own id if its set is
    empty (null or wordless texts), for it links with nothing. kept marks one document of each component, that with the
    smallest id. Rows with null ids take part, and get a null class_id or component_id only if no row of it has an id. Rows
    with equal ids are told apart by their texts; repeated rows get equal results. Texts count whole, however long. Other
    columns are not read. An empty table gives an empty result. 0 < percent < 100. n-grams are told apart by 64-bit hashes
    within a pair of sets, sets by 128-bit ones.
    """
    spark, t = df.sparkSession, percent
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = row_key(id_col, text_col)
    docs = df.select(F.col(id_col).alias("id"), key.alias("doc"), text.alias("t"))
    sketch = spark.sparkContext.broadcast(_sketch(docs.select("t"), n))  # of fixed size

    @lean
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["t"]:
                s = shingle_hashes(text, n)
                if len(s):
                    often = sketch.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.argsort(often, kind="stable")[: prefix_size(len(s), t)]
                    out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), s[first].view(np.int64)))
                else:
                    out.append((None, 0, []))
            pdf = pdf[["id", "doc"]].copy()
            pdf["set"], pdf["n"], pdf["prefix"] = [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]
            yield pdf
        _WORDS.clear()

    # Equal sets are one class, told apart by 128-bit digests; its node is the number of one of its rows.
    base = cut(docs.mapInPandas(describe, f"id {id_type}, doc binary, set binary, n int, prefix array<long>").withColumn("row", F.monotonically_increasing_id()))
    leads = base.where("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("node")).select(F.xxhash64("set").alias("k"), F.col("set").alias("lead"), "node")
    # Rows without a set find nothing, and are spread.
    joined = base.withColumn("k", F.coalesce(F.when(F.col("set").isNotNull(), F.xxhash64("set")), F.col("row"))).join(leads, "k", "left").where("set IS NULL OR set = lead")
    rows = cut(joined.select("id", "doc", "n", F.when(F.col("set").isNotNull(), F.col("node")).alias("node"), "row", F.when(F.col("row") == F.col("node"), F.col("prefix")).alias("prefix")))
    forget(base)
    classes = rows.where("row = node").select("node", "n", "doc", "prefix")

    # Fragments of the global order: which n-grams of the prefixes are shared, and the hub of each.
    often = classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1").select("h")
    often = cut(often)
    known = bitmap(often, "h")

    @lean
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["prefix"] = [p[in_bitmap(known.value, p)] for p in pdf["prefix"]]
            yield pdf

    posted = classes.select("node", "n", "prefix").mapInPandas(keep, "node long, n int, prefix array<long>").select("node", "n", F.explode("prefix").alias("h"))
    met = cut(posted.withColumn("k", _rekey("h")).join(often.select(_rekey("h").alias("k")), "k", "left_semi").select("node", "n", "h"))
    # Linked sets are in the same band of sizes or in neighbouring ones, so each is posted in its own and the next.
    band = F.floor(F.log("n") / (math.log(100 / t) * (1 + 1e-9))).cast("int")
    posted = met.withColumn("band", F.explode(F.array(band, band + 1))).select("node", "n", "band", F.xxhash64("h", "band").alias("h"))
    shared = posted.groupBy("h").agg(F.min("node").alias("hub"), F.count("*").alias("sets")).where("sets > 1").select(_rekey("h").alias("k"), "hub")
    hubs = posted.withColumn("k", _rekey("h")).join(shared, "k").groupBy("node", "n", "band", "hub").agg(F.count("*").alias("c"))
    fewest = F.lit(1) + F.floor(F.ceil(F.col("n") * t / 100) * (100 - t) / 400)  # _k of the smallest set that may link
    w = Window.partitionBy("node", "band").orderBy("c", "hub")
    hubs = hubs.withColumn("sum", F.sum("c").over(Window.partitionBy("node", "band"))).withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hubs = hubs.where((F.col("sum") >= fewest) & (F.col("upto") > F.floor((fewest - 1) / 2)))
    clusters = connected_components(hubs.select(F.col("node").alias("a"), F.col("hub").alias("b"))).select("node", F.col("component").alias("cluster"))
    clusters = cut(clusters)
    forget(often, met)

    # Differences from the cluster's first member, in groups of bounded size that hold a copy of it.
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    members = clusters.withColumn("k", _rekey("cluster")).join(sizes.select(_rekey("cluster").alias("k"), "m"), "k").drop("k")
    salts = F.ceil(F.col("m") / 64).cast("int")
    salt = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), salts).cast("int")))
    members = members.select("node", "cluster", "m", F.explode(salt).alias("salt")).join(classes.select("node", "doc"), "node")
    members = cut(members)
    wanted = bitmap(members.select(F.xxhash64("doc").alias("k")).distinct(), "k")

    @F.pandas_udf("boolean")
    def may_be(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(wanted.value, k.to_numpy()))

    texts = docs.select("doc", "t").where(may_be(F.xxhash64("doc"))).join(members, "doc")

    handled = [0]  # rows of a task since it gave memory back

    def differ(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        handled[0] += len(pdf)
        if handled[0] > 1024:
            handled[0] = 0
            _WORDS.clear()
            trim()
        pdf = pdf.drop_duplicates("node")
        sets = {node: shingle_hashes(text, n) for node, text in zip(pdf["node"], pdf["t"], strict=True)}
        cluster, salt = key
        lead, out = sets[cluster], []
        for node, s in sets.items():
            if node != cluster or salt == 0:
                out.append([cluster, node, len(s), np.setxor1d(s, lead, assume_unique=True).view(np.int64), [], []])
        if out:  # the n-grams that a quarter of the group or more have
            h, c = np.unique(np.concatenate([x[3] for x in out]), return_counts=True)
            many = (c > 1) & (4 * c >= len(out))
            out[0][4:] = [h[many], c[many]]
        return pd.DataFrame(out, columns=["cluster", "node", "n", "d", "h", "c"])

    raw = cut(texts.groupBy("cluster", "salt").applyInPandas(differ, "cluster long, node long, n int, d array<long>, h array<long>, c array<long>"))
    votes = raw.select("cluster", F.explode(F.arrays_zip("h", "c")).alias("v")).groupBy("cluster", "v.h").agg(F.sum("v.c").alias("c"))
    most = votes.join(sizes.where("m > 2"), "cluster").where("2 * c > m").groupBy("cluster").agg(F.collect_list("h").alias("p"))  # at most twice a mean difference
    none = F.array().cast("array<bigint>")
    diffs = raw.withColumn("k", _rekey("cluster")).join(most.select(_rekey("cluster").alias("k"), "p"), "k", "left").withColumn("p", F.coalesce("p", none))
    d = F.concat(F.array_except("d", "p"), F.array_except("p", "d"))
    diffs = diffs.select("cluster", "node", "n", d.alias("d")).withColumn("a", ((100 + t) * F.size("d") - (100 - t) * F.col("n")).cast("long"))
    least = diffs.groupBy("cluster").agg(F.min(F.struct("a", "node")).alias("least")).select(_rekey("cluster").alias("k"), "least")
    diffs = cut(diffs.withColumn("k", _rekey("cluster")).join(least, "k").select("cluster", "node", "a", "d", F.col("least.node").alias("star"), (F.col("a") + F.col("least.a")).alias("gap")))
    forget(raw, members)
    star = diffs.where("gap <= 0 AND node <> star").select(F.col("node").alias("a"), F.col("star").alias("b"))

    # Links of sets outside the star, by common n-grams of the differences. A set that needs more of them than it has can't link.
    outside = diffs.where("gap > 0").select("cluster").distinct()
    need = F.greatest(F.ceil(F.col("gap") / (2 * (100 + t))), F.lit(1))
    rest = diffs.join(outside, "cluster", "left_semi").withColumn("size", F.size("d") - need + 1).where("size > 0")
    listed = rest.select("node", F.explode(F.transform("d", lambda h: F.xxhash64("cluster", h))).alias("h"))
    often = listed.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = cut(listed.withColumn("k", _rekey("h")).join(often.select(_rekey("h").alias("k"), "sets"), "k").select("node", "h", "sets"))

    # The global order of these n-grams is by sets, then hash; n-grams of one set come before all others and match nothing.
    own = Window.partitionBy("node")
    # Of two sets the one of less a needs a shorter prefix (index), as a(x) + a(y) is 2 a(x) then at least.
    index = F.least("size", F.size("d") - F.ceil(F.col("a") / (100 + t)) + 1).alias("index")
    about = rest.select("node", "a", (F.col("gap") > 0).alias("out"), F.size("d").alias("nd"), "size", index)
    listed = shared.join(about, "node").withColumn("has", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("sets", "h")) + F.col("nd") - F.col("has"))
    prefixes = cut(listed.where("place <= size").select("h", "node", "a", "out", "has", (F.col("place") <= F.col("index")).alias("index")))
    # N-grams with the same sets say the same, so one of them stays; so a passage of many n-grams is compared once.
    same = [F.bit_xor(F.xxhash64("node", "index")).alias("s1"), F.bit_xor(F.xxhash64("node", "index", F.lit(1))).alias("s2"), F.count("*").alias("m"), F.min(F.struct("a", "node", "has")).alias("first"), F.bool_or("out").alias("any_out"), F.bool_or("index").alias("any_index")]
    one = prefixes.groupBy("h").agg(*same).where("m > 1 AND any_out AND any_index").groupBy("s1", "s2", "m", "first").agg(F.min("h").alias("h"))
    listed = cut(prefixes.withColumn("k", _rekey("h")).join(one.select(_rekey("h").alias("k"), "first", "m"), "k").drop("k"))

    # Vertical partitioning: the order is cut into ranges of equal weight, and a set into a segment for each.
    order = F.least("sets", F.lit(1 << 18)) * (1 << 44) + F.shiftrightunsigned("h", 20)
    pivots = shared.agg(F.percentile_approx(order, [i / FRAGMENTS for i in range(1, FRAGMENTS)], 10_000)).first()[0] or []
    part = sum([(order > p).cast("int") for p in pivots], F.lit(0))
    segments = cut(shared.groupBy("node", part.alias("fragment")).agg(F.collect_list("h").alias("s")))

    def links(pairs: DataFrame) -> DataFrame:
        x = segments.select(F.col("node").alias("x"), "fragment", F.col("s").alias("sx"))
        y = segments.select(F.col("node").alias("y"), "fragment", F.col("s").alias("sy"))
        overlaps = pairs.join(x, "x").join(y, ["y", "fragment"]).select("x", "y", "gap", F.size(F.array_intersect("sx", "sy")).alias("o"))
        return overlaps.groupBy("x", "y", "gap").agg(F.sum("o").alias("o")).where(F.col("gap") <= 2 * (100 + t) * F.col("o")).select(F.col("x").alias("a"), F.col("y").alias("b"))

    # First with the set of least a that has the n-gram; then, of sets not yet in one component, those outside the largest of
    # the n-gram's components with all others.
    few = lambda a, b, x, y: a + b <= 2 * (100 + t) * F.least(x, y)
    firsts = listed.where((F.col("node") != F.col("first.node")) & few(F.col("a"), F.col("first.a"), F.col("has"), F.col("first.has")))
    firsts = firsts.select(F.col("node").alias("x"), F.col("first.node").alias("y"), (F.col("a") + F.col("first.a")).alias("gap")).distinct()
    joined = cut(connected_components(star.unionByName(links(cut(firsts)))))
    listed = listed.withColumn("k", _rekey("node")).join(joined.select(_rekey("node").alias("k"), "component"), "k", "left").drop("k")
    listed = cut(listed.select("h", "node", "a", "out", "has", "index", F.coalesce("component", "node").alias("part")))
    largest = listed.groupBy("h", "part").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    listed = listed.withColumn("k", _rekey("h")).join(largest.select(_rekey("h").alias("k"), F.col("top.part").alias("top")), "k").drop("k")
    other = listed.select("h", F.col("node").alias("y"), F.col("a").alias("ay"), F.col("out").alias("yout"), F.col("has").alias("hy"), F.col("index").alias("iy"), F.col("part").alias("ypart"))
    pairs = listed.where("part <> top").join(other, "h").where(few(F.col("a"), F.col("ay"), F.col("has"), F.col("hy")) & F.expr("(out OR yout) AND part <> ypart AND (ypart = top OR node < y) AND (index AND a <= ay OR iy AND ay <= a)"))
    pairs = cut(pairs.select(F.col("node").alias("x"), "y", (F.col("a") + F.col("ay")).alias("gap")).distinct())

    forget(shared, prefixes)
    known_links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = connected_components(known_links.unionByName(links(pairs))).withColumnRenamed("component", "to")
    ids = rows.select("id", "doc", "node", "n", "row")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc")
    own = ids.where("node IS NOT NULL").groupBy("node").agg(F.min(rank).alias("first"))
    own = cut(own.join(linked, "node", "left").select("node", "first", F.coalesce("to", "node").alias("to")))
    names = own.groupBy("to").agg(F.min("first").alias("lead"))
    named = own.withColumn("k", _rekey("to")).join(names.select(_rekey("to").alias("k"), "lead"), "k").select(_rekey("node").alias("k"), F.col("first.id").alias("class_id"), "lead")
    lone = F.col("node").isNull()
    out = ids.withColumn("k", F.coalesce(_rekey("node"), F.col("row"))).join(named, "k", "left")
    pick = lambda c: F.when(lone, F.col("id")).otherwise(F.col(c))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), pick("class_id").alias("class_id"), pick("lead.id").alias("component_id"), (lone | (F.col("doc") == F.col("lead.doc"))).alias("kept"), F.col("doc").alias("row_key"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_ngram_join": op3_ngram_join}
ORACLE_SQL: dict[str, str] = {}

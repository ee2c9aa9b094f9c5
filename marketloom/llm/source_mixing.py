"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source token shares are raised to an exponent and normalised. The exponent is bisected until the mix has a target
entropy, as far as no source is then repeated more often than a limit allows; each Spark job evaluates the 31 points of
five halvings at once over the table of sources. The weights become token budgets, and these whole passes over a source
and a partial one. Partial passes follow a block permutation: rows are dealt into blocks by a hash, blocks are ordered by
another; blocks are taken whole while the budget lasts, and of the block in which it ends, a prefix in hash order. So the
running sum over rows never leaves a block, and the one over blocks has a row for each block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import cut, read

MOST_BROADCAST, SALTS = 10_000, 64
STEPS = 1e4  # the exponent is rounded up to this grid, so that results don't hang on the last bits of a power


def word_count(text: Column) -> Column:
    """Spaces and line ends plus one; 0 for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    spaces = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(spaces(" ") + spaces("\n") + 1).cast("long")


def _bisect(shares: DataFrame, holds: Column, rounds: int = 5, halvings: int = 5) -> float:
    """The least exponent in [0, 1] for which `holds`, a condition on the columns of _at(), which stays true once it is; 1 if it never is."""
    low, high, n = 0.0, 1.0, 2**halvings
    for _ in range(rounds):
        points = [low + (high - low) * i / n for i in range(n)]
        first = _at(shares, points).where(holds).agg(F.min("exponent")).first()[0]
        if first == low == 0.0:
            return 0.0
        high = high if first is None else first
        low = max(p for p in points if p < high)
    return high


def _at(shares: DataFrame, exponents: list[float]) -> DataFrame:
    """For each exponent the mix's entropy, and the passes of the source repeated most where each has one at least."""
    x = shares.select("share", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("exponent")).withColumn("raw", F.pow("share", "exponent"))
    x = x.groupBy("exponent").agg(F.sum("raw").alias("z"), F.sum(F.col("raw") * F.log("raw")).alias("zl"), F.max(F.col("raw") / F.col("share")).alias("most"), F.min(F.col("raw") / F.col("share")).alias("least"), F.count("*").alias("n"))
    return x.select("exponent", (F.log("z") - F.col("zl") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repeats"), F.log("n").alias("full"))


def mix_sources(df: DataFrame, target_entropy: float = 0.95, max_repeats: float = 2.0, budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, text_col: str = "text", block_rows: int = 1024, seed: str = "mix") -> DataFrame:
    """One row per input row: id_col, source_col, n_tokens, weight (of its source), copies (long; 0: not taken).

    target_entropy is a share of that of the uniform mix. max_repeats bounds the passes over any source relative to the
    one repeated least; where the two conflict the limit wins. Without a budget in tokens the mix is the smallest that
    holds every source whole; no row is then dropped. With one, a source gets floor(weight * budget) tokens at most,
    short by less than one row. Rows without tokens get the whole passes of their source; a source
    without any tokens gets one pass, or none if there is a budget. A null source is a source of its own. Rows that
    agree in all columns are dealt alike but may differ in the last, partial pass. Columns of other names are not read.
    An empty table gives an empty result.
    """
    n = word_count(F.col(text_col)) if tokens is None else tokens
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("-"))))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-")).alias("s"), F.col(source_col).alias("source"), n.cast("long").alias("n")).withColumn("h", order)
    totals = cut(rows.groupBy("s").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows")))
    whole = totals.agg(F.sum("total")).first()[0] or 1
    shares = totals.where("total > 0").select("s", "total", (F.col("total") / F.lit(float(whole))).alias("share"))
    for_limit = _bisect(shares, F.col("repeats") <= max_repeats)
    enough = F.col("entropy") <= target_entropy * F.col("full")  # falls as the exponent grows
    for_entropy = _bisect(shares, enough)
    exponent = max(for_limit, for_entropy)
    exponent = -(-round(exponent * STEPS, 3) // 1) / STEPS
    raw = F.pow("share", F.lit(exponent))
    z, most = shares.agg(F.sum(raw), F.max(F.col("total") / raw)).first()
    size = F.lit(float(budget)) / F.lit(z or 1.0) if budget is not None else F.lit(most or 0.0)
    plan = shares.select("s", "total", (raw / F.lit(z or 1.0)).alias("weight"), (size * raw).alias("b"))
    passes = F.floor(F.col("b") / F.col("total") + 1e-9)
    plan = plan.withColumn("passes", passes).withColumn("rest", F.greatest(F.floor(F.col("b") - F.col("passes") * F.col("total") + 1e-3), F.lit(0)))
    plan = totals.select("s", "n_rows").join(plan.select("s", "weight", "passes", "rest"), "s", "left").select("s", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("passes", F.lit(1 if budget is None else 0)).alias("passes"), F.coalesce("rest", F.lit(0)).alias("rest"), F.ceil(F.col("n_rows") / block_rows).alias("n_blocks"))
    plan = cut(plan)
    # The table of sources is broadcast only if it is small; else the rows of a source are spread over salts.
    if plan.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(plan), "s")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["s", "salt"]).drop("salt")
    rows = rows.withColumn("block", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_blocks"))
    blocks = rows.groupBy("s", "block").agg(F.sum("n").alias("tokens"))
    turn = Window.partitionBy("s").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "s", F.lit(":"), F.col("block").cast("string"))), "block")
    blocks = blocks.withColumn("before", F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).select("s", "block", "before")
    inside = Window.partitionBy("s", "block").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["s", "block"]).withColumn("end", F.col("before") + F.sum("n").over(inside))
    extra = (F.col("end") <= F.col("rest")) & (F.col("n") > 0)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), "weight", (F.col("passes") + extra.cast("long")).cast("long").alias("copies"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


QUERIES = {"op8_source_mixing": op8_source_mixing}
ORACLE_SQL = {
    "op8_source_mixing": """
WITH RECURSIVE r AS (SELECT doc_id, source, coalesce('=' || source, '-') AS s, CASE WHEN coalesce(text, '') = '' THEN 0
    ELSE length(text) - length(replace(text, ' ', '')) + length(text) - length(replace(text, chr(10), '')) + 1 END AS n, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
t AS (SELECT s, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_rows FROM r GROUP BY s),
p AS (SELECT s, total, total / (SELECT sum(total) FROM t) AS share FROM t WHERE total > 0),
l AS (SELECT list(share ORDER BY s) AS ps FROM p),
b(i, lo, hi, elo, ehi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL SELECT i + 1, CASE WHEN rep <= 2 THEN lo ELSE m END, CASE WHEN rep <= 2 THEN m ELSE hi END, CASE WHEN ent <= 0.95 * ln(k) THEN elo ELSE em END, CASE WHEN ent <= 0.95 * ln(k) THEN em ELSE ehi END
  FROM (SELECT i, lo, hi, elo, ehi, (lo + hi) / 2 AS m, (elo + ehi) / 2 AS em, len(ps) AS k,
    list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) / x)) / list_min(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) / x)) AS rep,
    ln(list_sum(list_transform(ps, lambda x: pow(x, (elo + ehi) / 2)))) - list_sum(list_transform(ps, lambda x: pow(x, (elo + ehi) / 2) * ln(pow(x, (elo + ehi) / 2)))) / list_sum(list_transform(ps, lambda x: pow(x, (elo + ehi) / 2))) AS ent
    FROM b, l WHERE i < 25)),
e AS (SELECT ceil(round(greatest(hi, ehi) * 1e4, 3)) / 1e4 AS x FROM b WHERE i = 25),
z AS (SELECT sum(pow(share, x)) AS z, max(total / pow(share, x)) AS most FROM p, e),
q AS (SELECT s, total, pow(share, x) / z AS weight, most * pow(share, x) AS bud FROM p, e, z),
q2 AS (SELECT *, CAST(floor(bud / total + 1e-9) AS BIGINT) AS passes FROM q),
pl AS (SELECT t.s, coalesce(weight, 0) AS weight, coalesce(passes, 1) AS passes, coalesce(greatest(CAST(floor(bud - passes * q2.total + 1e-3) AS BIGINT), 0), 0) AS rest, CAST(ceil(n_rows / 1024) AS BIGINT) AS n_blocks FROM t LEFT JOIN q2 USING (s)),
rb AS (SELECT r.*, weight, passes, rest, CAST('0x' || substr(h, 1, 8) AS BIGINT) % n_blocks AS block FROM r JOIN pl USING (s)),
bl AS (SELECT s, block, CAST(sum(n) AS BIGINT) AS tokens FROM rb GROUP BY s, block),
bo AS (SELECT s, block, CAST(sum(tokens) OVER (PARTITION BY s ORDER BY md5('mix:' || s || ':' || block), block ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS before FROM bl),
f AS (SELECT rb.*, before + CAST(sum(n) OVER (PARTITION BY s, block ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM rb JOIN bo USING (s, block))
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, round(weight, 6) AS weight, CAST(passes + CASE WHEN fin <= rest AND n > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM f
"""
}

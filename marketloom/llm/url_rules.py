"""URL filters: fixed host and path rules, and association rules mined by FP-growth for the rest.

The labels are the urls that a fixed rule decides. Each is a transaction of its url's tokens and its verdict; Spark's
FP-growth mines frequent combinations, and those that imply a verdict become rules. Rules below a confidence or support
are dropped, and so is a rule with a shorter one inside it that is as confident, since it could never win. Tokens that occur
in the very same transactions are one item, which any of them stands for, and a token that implies a verdict alone needs no
combinations; so their number does not double with each. A rule is posted in an inverted index under its rarest item; the
distinct token sets of urls are joined with the index on single tokens and then tested for the whole combination.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import ascii_lower, cut, read

#: Host, path and verdict of the rules for op2.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_VERDICT = "verdict="


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null urls and those without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null urls and those without ://."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits host or a domain above it and the path's beginning; else null.
    Of equally long ones (their host and path together) the last in `rules` counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: domain labels, words of the path with their place, the kind of its end, and query keys.
    Numbers count by their presence, so identifiers don't swell the vocabulary. Of a token of more than 64 characters
    a digest of the whole takes the place of the rest, so no two different ones become one."""
    whole = lambda t: F.regexp_replace(F.lower(t), "[0-9]+", "0")
    plain = lambda t: F.when(F.length(whole(t)) <= 64, whole(t)).otherwise(F.concat(F.substring(whole(t), 1, 64), F.lit("~"), F.md5(whole(t))))
    tagged = lambda tag, a: F.transform(F.filter(a, lambda t: t != ""), lambda t: F.concat(F.lit(tag), t))
    plains = lambda a: F.transform(a, plain)
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda kv: plain(F.substring_index(kv, "=", 1)))
    steps = F.transform(F.split(path, "/"), lambda s, i: F.when(s == "", "").otherwise(F.concat(i.cast("string"), F.lit("="), plain(s))))
    parts = F.concat(tagged("host:", plains(F.split(host, r"\."))), tagged("word:", plains(F.split(host, r"[.\-_]"))), tagged("path:", steps), tagged("key:", keys))
    return F.sort_array(F.array_distinct(parts))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7) -> DataFrame:
    """Rules from `labelled` (tokens array<string>, verdict string): (rule_id, tokens, needs, verdict, confidence, support).

    `needs` holds, for each of `tokens`, all tokens that occur in the same rows: one of each is needed. Rows with a null
    verdict take no part; an empty table gives no rules. Equal confidence goes to the larger support, then to the smaller
    rule_id (tokens and verdict as text). FP-growth is fitted on all items of each row that imply no verdict alone, so its
    combinations, of any length, are as many as reach the support.
    """
    salt = lambda n: F.xxhash64(F.lit(n), "tokens", "verdict").cast("decimal(38,0)")
    baskets = cut(labelled.where("verdict IS NOT NULL").groupBy("tokens", "verdict").agg(F.count("*").alias("freq")))
    total = baskets.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    least = max(1, math.ceil(min_support * total * (1 - 1e-12)))  # rows; the margin is that of rounding
    by = baskets.select(F.explode("tokens").alias("t"), "verdict", "freq", salt(1).alias("a"), salt(2).alias("b")).groupBy("t", "verdict").agg(*(F.sum(c).alias(c) for c in ("freq", "a", "b")))
    # Of each token the rows, and those of its most frequent verdict.
    by = by.groupBy("t").agg(F.sum("freq").alias("n"), F.max(F.struct("freq", "verdict")).alias("top"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= least)
    # The tokens of an item share their rows, so they are no more than the longest row has.
    items = cut(by.groupBy("n", "top", "a", "b").agg(F.min("t").alias("item"), F.sort_array(F.collect_list("t")).alias("members")))
    pure = items.where("top.freq = n").select(F.array("item").alias("tokens"), "top.verdict", "n", F.col("n").alias("freq"))
    mixed = items.where("top.freq < n").select("item")
    fit = baskets.select("tokens", "verdict", "freq", F.explode("tokens").alias("item")).join(mixed, "item")
    fit = fit.groupBy("tokens", "verdict", "freq").agg(F.collect_list("item").alias("items"))
    fit = cut(fit.select(F.concat("items", F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("freq").cast("int")))).select("items"))
    counted, n_fit = pure, fit.count()
    if least <= n_fit:
        tasks = 4 * labelled.sparkSession.sparkContext.defaultParallelism  # items are dealt to them with all rows that hold them
        found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_fit, minConfidence=min_confidence, numPartitions=tasks).fit(fit).freqItemsets
        of = F.filter("items", lambda t: t.startswith(_VERDICT))
        found = cut(found.select(F.sort_array(F.filter("items", lambda t: ~t.startswith(_VERDICT))).alias("tokens"), F.substring(F.get(of, 0), len(_VERDICT) + 1, 1 << 30).alias("verdict"), "freq").where(F.size("tokens") > 0))
        every = found.where("verdict IS NULL").select("tokens", F.col("freq").alias("n"))  # a part of a frequent set is frequent
        counted = counted.unionByName(found.where("verdict IS NOT NULL").join(every, "tokens").select(pure.columns))
    rules = counted.select("tokens", "verdict", (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / F.lit(float(max(total, 1)))).alias("support"))
    rules = cut(rules.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("by"))
    parts = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t")).select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("t")).alias("part"))
    beaten = parts.join(shorter, ["part", "verdict"]).where(F.col("by") >= F.col("confidence")).select("tokens", "verdict").distinct()
    rules = rules.join(beaten, ["tokens", "verdict"], "left_anti")
    name = F.concat_ws(" ", "tokens", F.concat(F.lit("-> "), "verdict"))
    with_members = rules.select("tokens", "verdict", "confidence", "support", F.explode("tokens").alias("item")).join(items.select("item", "members"), "item")
    # An item is its smallest token, so members sort as items do.
    out = with_members.groupBy("tokens", "verdict", "confidence", "support").agg(F.sort_array(F.collect_list("members")).alias("needs"))
    return cut(out.select(name.alias("rule_id"), "tokens", "needs", "verdict", "confidence", "support"))


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule for each distinct `tokens` of rows: (tokens, rule_id, verdict); token sets that no rule fits are left out.

    Null and empty token sets fit no rule. Repeated sets have one row. An empty table, or no rules, gives an empty result.
    """
    use = rules.select(F.explode("tokens").alias("item")).groupBy("item").agg(F.count("*").alias("rules"))
    posted = rules.select("rule_id", "needs", "verdict", "confidence", "support", F.posexplode("tokens").alias("at", "item")).join(use, "item")
    rarest = Window.partitionBy("rule_id").orderBy("rules", "item")
    index = posted.withColumn("n", F.row_number().over(rarest)).where("n = 1").select(F.explode(F.get("needs", F.col("at"))).alias("t"), "rule_id", "needs", "verdict", "confidence", "support")
    sets = rows.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("t")).join(index, "t").where(F.forall("needs", lambda any_of: F.arrays_overlap(any_of, F.col("tokens"))))
    best = hits.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule_id", "verdict")).alias("best"))
    return best.select("tokens", "best.rule_id", "best.verdict")


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", **mining) -> DataFrame:
    """One row per input row: id_col, host, path, rule (null where no fixed rule fits), verdict, mined_rule.

    Null urls and those without :// have an empty host and path, fit no rule, and get the default verdict, as do urls
    that no mined rule fits. Ids may be null or repeat; each row is judged by its url alone. Other columns are not read.
    An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "url")
    rows = rows.select("id", "host", "path", fixed_rule(F.col("host"), F.col("path"), rules).alias("fixed"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(rows.select("tokens", "fixed.verdict"), **mining)
    found = match_rules(rows.where("fixed IS NULL"), mined)
    # Token sets are few and may be hot: rows are looked up under a key of their own, so that hot ones can be split.
    key = F.sha1(F.array_join("tokens", " "))
    found = found.select(key.alias("k"), "rule_id", F.col("verdict").alias("by_mined"))
    none = F.concat(F.lit("-"), F.xxhash64("id", "host", "path").cast("string"))  # finds nothing, and spreads the rows
    out = rows.withColumn("k", F.when(F.col("fixed").isNull(), key).otherwise(none)).join(found, "k", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "by_mined", F.lit(default)).alias("verdict"), F.col("rule_id").alias("mined_rule"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


QUERIES = {"op2_url_rules": op2_url_rules}
ORACLE_SQL: dict[str, str] = {}

"""Signals that a language model wrote as JSON: read as VARIANT, checked field by field, codes held against a whitelist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS, IMPACTS = ("positive", "negative", "neutral"), ("high", "medium", "low")


def _text(v: Column, path: str) -> Column:
    return F.trim(F.try_variant_get(v, path, "string"))


def _choice(v: Column, path: str, allowed: tuple[str, ...]) -> Column:
    """One of the allowed texts; the last one for everything else."""
    return F.when(_text(v, path).isin(*allowed), _text(v, path)).otherwise(allowed[-1])


def _number(v: Column, path: str, low: float, high: float) -> Column:
    """A number or a text of one, within bounds and to two places; 0 for anything else."""
    x = F.coalesce(F.try_variant_get(v, path, "double"), _text(v, path).try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), 0.0).otherwise(x)
    return F.round(F.least(F.greatest(x, F.lit(low)), F.lit(high)), 2)


def _names(v: Column, path: str) -> Column:
    """A list of texts, or a text with commas; empty for anything else. Blanks around names and empty names go."""
    listed = F.try_variant_get(v, path, "array<string>")
    split = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.split(_text(v, path), ","))
    return F.filter(F.transform(F.coalesce(listed, split, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def parse_signals(items: DataFrame, raw: str = "raw") -> DataFrame:
    """items with readable, sentiment, sentiment_score, impact, impact_score, sectors and codes read from the JSON text `raw`.

    Text that is no JSON object is unreadable and gives a neutral signal of low impact without names; so does null.
    """
    v = F.try_parse_json(raw)
    readable = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    v = F.when(readable, v)
    return items.withColumns({
        "readable": readable, "sentiment": _choice(v, "$.sentiment", KINDS), "sentiment_score": _number(v, "$.sentiment_score", -1.0, 1.0), "impact": _choice(v, "$.impact", IMPACTS),
        "impact_score": _number(v, "$.impact_score", 0.0, 1.0), "sectors": _names(v, "$.related_sectors"), "codes": _names(v, "$.related_codes"),
    })


def allowed_codes(signals: DataFrame, pool: DataFrame, key: str, own: str | None = None) -> DataFrame:
    """signals whose codes are in the pool (code), in their order; then the codes of the item itself (`own`, an array), as they are.

    key is unique. Codes meet the pool in a semi-join of their own, so the pool may be of any size.
    """
    one = signals.select(key, F.posexplode("codes").alias("_at", "code")).join(pool.select("code").distinct(), "code", "left_semi")
    kept = one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "code"))), lambda x: x["code"]).alias("_kept"))
    none = F.array().cast("array<string>")
    d = signals.join(kept, key, "left").withColumn("codes", F.coalesce("_kept", none)).drop("_kept")
    if own is None:
        return d
    # Codes of the item that are not there yet come after.
    extra = F.array_distinct(F.array_except(F.coalesce(F.col(own), none), F.col("codes")))
    return d.withColumn("codes", F.concat("codes", extra))

"""Feeds of daily values that come at dates of their own, with corrections: one table by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(feed: DataFrame, order: str, on: str = "date") -> DataFrame:
    """Of the rows of a date the last by `order`; rows without a date go. Ties go to the greatest values, so the result is fixed."""
    rest = [c for c in feed.columns if c != on]
    best = feed.where(F.col(on).isNotNull()).groupBy(on).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return best.select(on, *[F.col(f"_r.{c}").alias(c) for c in rest])


def join_feeds(feeds: dict[str, DataFrame], value: str = "value", order: str = "seq", on: str = "date", missing: float | None = 0.0) -> DataFrame:
    """date and a column for each feed: the last value of each date, on every date that any feed has.

    A full outer join of any number of feeds by one union and one aggregation, so one exchange. feeds: on, value, order.
    Dates that a feed lacks, and null values, get `missing` (None: null). Rows without a date go.
    """
    rows = reduce(DataFrame.unionByName, [f.select(on, F.col(value).cast("double").alias("v"), F.col(order).alias("o"), F.lit(k).alias("k")) for k, f in feeds.items()])
    last = lambda k: F.max_by(F.struct("v"), F.when(F.col("k") == k, F.struct("o", "v")))["v"]
    fill = (lambda c: F.coalesce(c, F.lit(missing))) if missing is not None else (lambda c: c)
    return rows.where(F.col(on).isNotNull()).groupBy(on).agg(*[fill(last(k)).alias(k) for k in feeds])

"""Window and cross-section helpers. Missing is NULL, never NaN."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(fn: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """fn over the last n rows of a code, null until n of them are not null."""
    w, x = by_code().rowsBetween(-(n - 1), 0), col(x)
    return F.when(F.count(x).over(w) == n, fn(x).over(w))


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_code())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(x, n).over(by_code())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def xs_zscore(x: Column | str, w: WindowSpec | None = None) -> Column:
    """Cross-section z-score with the population deviation; 0 where that is 0, null where x is."""
    x, w = col(x), w or Window.partitionBy("date")
    z = (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))
    return F.when(x.isNotNull(), F.coalesce(z, F.lit(0.0)))


def xs_rank(x: str, by: tuple[str, ...] = ("date",)) -> Column:
    """Percentage rank with ties averaged; null where x is."""
    x = F.col(x)
    w = Window.partitionBy(*by, x.isNull())
    rank = F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2
    return F.when(x.isNotNull(), rank / F.count(F.lit(1)).over(w))


def spearman_by(df: DataFrame, x: str, y: str, by: tuple[str, ...], least: int = 3) -> DataFrame:
    """Rank correlation of x and y in each group of at least `least` complete rows: by..., ic, n."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    df = df.select(*by, xs_rank(x, by).alias("rx"), xs_rank(y, by).alias("ry"))
    spread = F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0))
    return df.groupBy(*by).agg((F.covar_pop("rx", "ry") / spread).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def ewm(x: Column, alpha: float, place: Column) -> Column:
    """Exponential mean without adjustment, by code: y(1) = x(1), y(t) = (1 - alpha) y(t-1) + alpha x(t); place counts rows from 1.

    Unrolled, so that it needs no recursion: a running sum in each block of rows, and what is left of the block before. A
    block is so long that what is older than that is below a double's precision; so histories may have any length.
    """
    keep = 1 - alpha
    size = math.ceil(42 / alpha)
    block, at = F.floor(place / size).cast("long"), place % size
    term = x * F.when(place == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    inside = Window.partitionBy("code", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("code").orderBy(block).rangeBetween(-1, -1)
    own = F.sum(term * F.pow(F.lit(keep), -at)).over(inside) * F.pow(F.lit(keep), at)
    return own + F.coalesce(F.sum(term * F.pow(F.lit(keep), size - 1 - at)).over(before), F.lit(0.0)) * F.pow(F.lit(keep), at + 1)


def group_transform(df: DataFrame, by: list[str], x: str, fn: Callable[[Column, WindowSpec], Column], to: str | None = None) -> DataFrame:
    """df with `to` (x itself if none): any function of a column and its group's window, so groups of any size need no Python."""
    return df.withColumn(to or x, fn(F.col(x), Window.partitionBy(*by)))

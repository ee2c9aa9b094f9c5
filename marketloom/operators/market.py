"""Market-wide operators: universe, data quality, sector rotation and the sentiment index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import lag, spearman_by


def business_days(a: Column, b: Column) -> Column:
    """Weekdays from a to b, both included; null if either is."""
    return F.when(a <= b, F.size(F.filter(F.sequence(a, b), lambda d: F.weekday(d) < 5))).when(a > b, F.lit(0))


def universe(stocks: DataFrame, bars: DataFrame, date: Column, min_days: int = 60, gap_days: int = 30) -> DataFrame:
    """stocks: code, name, listed_date, delisted. A code is in if it is not special, listed long enough, traded lately and not delisted."""
    last = bars.groupBy("code").agg(F.max("date").alias("last"))
    d = stocks.join(last, "code", "left").withColumn("date", date)
    special = F.upper("name").contains("ST")
    days = F.coalesce(business_days(F.col("listed_date"), F.col("date")) - 1, F.lit(9999))
    idle = F.col("last").isNull() | (F.datediff("date", "last") > gap_days)
    return d.select("date", "code", "name", special.alias("is_st"), days.alias("listed_days"), F.coalesce("delisted", F.lit(False)).alias("delisted"), (~special & (days >= min_days) & ~idle & ~F.coalesce("delisted", F.lit(False))).alias("in_universe"))


def price_jumps(bars: DataFrame, price: str = "close", limit: float = 0.3) -> DataFrame:
    """Bars whose price is off by more than `limit` from the last one of the code that is not null."""
    d = bars.where(F.col(price).isNotNull()).withColumn("prev", lag(price))
    return d.withColumn("jump", F.round(F.col(price) / F.col("prev") - 1, 6)).where(F.abs("jump") > limit).select("code", "date", "jump")


def sector_rotation(panel: DataFrame) -> DataFrame:
    """date, industry: mean change, strength against the market, net inflow, label. The day before is the market's."""
    days = panel.select("date").distinct()
    days = days.withColumn("prev", F.lag("date").over(Window.orderBy("date")))  # one row for each date
    before = panel.select(F.col("code"), F.col("date").alias("prev"), F.col("amount").alias("was"))
    d = panel.join(days, "date").join(before, ["code", "prev"], "left")
    by = d.groupBy("date", "industry").agg(F.avg("ret").alias("change_pct"), F.sum(F.coalesce(F.col("amount") - F.col("was"), F.lit(0.0))).alias("net_inflow"))
    all_ = panel.groupBy("date").agg(F.avg("ret").alias("market"))
    by = by.join(all_, "date").withColumn("rs", F.round(F.col("change_pct") - F.col("market"), 9))
    label = F.when(F.col("rs") > 0.005, "attack").when(F.col("rs") < -0.005, "defend").otherwise("switch")
    return by.select("date", "industry", "change_pct", "rs", "net_inflow", label.alias("rotation_signal"))


def breadth(panel: DataFrame) -> DataFrame:
    """date: share of volume in rising names, and share of rising names (first bars count as not rising)."""
    up = F.coalesce(F.col("ret") > 0, F.lit(False))
    return panel.groupBy("date").agg((F.sum(F.when(up, F.col("vol")).otherwise(0.0)) / F.nullif(F.sum("vol"), F.lit(0.0))).alias("volume_dim"), F.avg(up.cast("double")).alias("price_dim"))


def rolling_percentile(daily: DataFrame, x: str, window: int = 750) -> DataFrame:
    """date, pct: share of the last `window` values up to now that are not above the current one, times 100; 50 for short or constant histories."""
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one row for each date
    d = daily.where(F.col(x).isNotNull()).withColumns({"_all": F.collect_list(x).over(w), "_sd": F.stddev_pop(x).over(w)})
    n = F.size("_all")
    least = F.greatest(F.lit(20), F.floor(F.least(n, F.lit(window)) / 4))
    pct = F.size(F.filter("_all", lambda v: v <= F.col(x))) / n * 100
    return d.select("date", F.when((n < least) | (F.round("_sd", 12) == 0), F.lit(50.0)).otherwise(pct).alias("pct"))


def index_drawdown(panel: DataFrame, n: int = 20) -> DataFrame:
    """date, drawdown of the equal-weighted price from its highest of n dates; null before there are n."""
    d = panel.groupBy("date").agg(F.avg("adj").alias("level"))
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)  # one row for each date
    top = F.when(F.count("level").over(w) == n, F.max("level").over(w))
    return d.select("date", ((F.col("level") - top) / top).alias("drawdown"))


#: Weights of the five dimensions of the sentiment index.
DIMENSIONS = {"volume": 0.25, "price": 0.25, "money": 0.2, "valuation": 0.15, "riskpremium": 0.15}


def sentiment_index(panel: DataFrame, money: DataFrame | None = None, valuation: DataFrame | None = None, riskpremium: DataFrame | None = None) -> DataFrame:
    """date, index_value, thermometer, regime_state: weighted percentiles of the dimensions there are; regimes by drawdown.

    The optional dimensions have a date and one value each, and columns sub_money, ... of their own in the result.
    """
    b = breadth(panel)
    v = rolling_percentile(b, "volume_dim").withColumnRenamed("pct", "sub_volume")
    p = rolling_percentile(b, "price_dim").withColumnRenamed("pct", "sub_price")
    d = b.select("date").join(v, "date", "left").join(p, "date", "left").join(index_drawdown(panel), "date", "left")
    subs = {"sub_volume": DIMENSIONS["volume"], "sub_price": DIMENSIONS["price"]}
    for k, x in (("money", money), ("valuation", valuation), ("riskpremium", riskpremium)):
        if x is not None:
            value = next(c for c in x.columns if c != "date")
            d = d.join(rolling_percentile(x, value).withColumnRenamed("pct", f"sub_{k}"), "date", "left")
            subs[f"sub_{k}"] = DIMENSIONS[k]
    total = sum((F.when(F.col(c).isNotNull(), w * F.col(c)).otherwise(0.0) for c, w in subs.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in subs.items()), F.lit(0.0))
    index = F.round(F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(50.0)), 6)
    d = d.withColumn("index_value", index).withColumn("dd", F.round("drawdown", 9))
    heat = F.when(F.col("index_value") <= 30, "fear").when(F.col("index_value") >= 70, "greed").otherwise("neutral")
    state = F.when(F.col("dd") <= -0.15, "panic").when(F.col("dd") <= -0.08, "bear").when((heat == "greed") & (F.col("dd") > -0.05), "bull").otherwise("neutral")
    signal = F.when(F.col("index_value") <= 10, "buy").when(F.col("index_value") >= 90, "out").otherwise("half")
    return d.select("date", *subs, "drawdown", "index_value", heat.alias("thermometer"), state.alias("regime_state"), signal.alias("signal"))


def gsisi(panel: DataFrame, weeks: int = 8, least_obs: int = 60) -> DataFrame:
    """One row, gsisi: mean over the last weeks of the rank correlation of industries' betas and weekly returns."""
    market = panel.groupBy("date").agg(F.avg("ret").alias("mkt"))
    d = panel.join(market, "date").where("ret IS NOT NULL AND mkt IS NOT NULL")
    beta = d.groupBy("code", "industry").agg(F.regr_slope("ret", "mkt").alias("beta"), F.count("*").alias("n")).where(F.col("n") >= least_obs).groupBy("industry").agg(F.avg("beta").alias("beta"))
    week = F.next_day(F.date_sub("date", 1), "FRI")
    ret = d.groupBy("industry", week.alias("week")).agg(F.avg("ret").alias("ret"))
    ic = spearman_by(ret.join(beta, "industry"), "beta", "ret", ("week",))
    return ic.orderBy(F.desc("week")).limit(weeks).agg(F.avg("ic").alias("gsisi"))


def money_dimension(flows: DataFrame, cols: list[str]) -> DataFrame:
    """date, money_dim: the mean over columns of the z-score against the history up to each date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row for each date
    z = [(F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-9) for c in cols]
    return flows.select("date", (sum(z, F.lit(0.0)) / len(cols)).alias("money_dim"))


def risk_premium(pe: DataFrame, bond: DataFrame) -> DataFrame:
    """date, premium: earnings yield less bond yield, on dates that have both."""
    return pe.join(bond, "date").select("date", (1 / F.nullif(F.col("pe"), F.lit(0.0)) - F.col("yield_10y")).alias("premium"))


def as_of(probe: DataFrame, data: DataFrame, value: str, on: str = "date") -> DataFrame:
    """probe with the latest `value` of data strictly before `on`: a union and one running window, no theta join."""
    rows = probe.select(on, F.lit(0).alias("_kind"), F.lit(None).cast(data.schema[value].dataType).alias("_v")).unionByName(data.select(on, F.lit(1).alias("_kind"), F.col(value).alias("_v")))
    w = Window.orderBy(on, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_kind = 0").select(on, value)


def regime_lag(index: DataFrame) -> DataFrame:
    """date, regime_state of the date before."""
    return index.select("date", F.lag("regime_state").over(Window.orderBy("date")).alias("regime"))



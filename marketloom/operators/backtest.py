"""Backtests on daily weights: selection, costs, turnover, metrics and walk-forward folds. All stay long: date, code, weight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import xs_zscore
from marketloom.operators.crosssec import daily_ic, directions, regime_scale

COST = 2 * 0.0003 + 0.0005 + 2 * 4.0 / 1e4  # commission both ways, stamp duty, slippage both ways


def score_book(signals: DataFrame, frac: float = 0.2) -> DataFrame:
    """A long and short book by direction times confidence: date, code, weight (see long_short)."""
    return long_short(signals.select("date", "code", (F.col("direction") * F.abs("confidence")).alias("score")), frac)


def at_upper_limit(limit: float = 0.10) -> Column:
    """Whether a bar closes at its upper limit; null without the close before."""
    return F.round(F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)), 9) >= round(1 + limit, 9)


def top_k_long(scores: DataFrame, frac: float = 0.2) -> DataFrame:
    """Equal weights on the best max(1, frac * n) names of each date, ties by code; names at their upper limit drop out
    after selection, and the rest share the weight. scores: date, code, score, at_limit."""
    w = Window.partitionBy("date")
    d = scores.where("score IS NOT NULL").withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(F.desc("score"), "code"))})
    d = d.where((F.col("_r") <= F.greatest(F.lit(1), F.floor(frac * F.col("_n")))) & ~F.coalesce("at_limit", F.lit(False)))
    return d.select("date", "code", (1.0 / F.count(F.lit(1)).over(w)).alias("weight"))


def long_short(scores: DataFrame, frac: float = 0.2) -> DataFrame:
    """+1/k on the best and -1/k on the worst k names of each date; a name that is both is short."""
    w = Window.partitionBy("date")
    d = scores.where("score IS NOT NULL").withColumns({"_n": F.count(F.lit(1)).over(w), "_hi": F.row_number().over(w.orderBy(F.desc("score"), "code")), "_lo": F.row_number().over(w.orderBy("score", "code"))})
    k = F.greatest(F.lit(1), F.floor(frac * F.col("_n")))
    weight = F.when(F.col("_lo") <= k, -1.0 / k).when(F.col("_hi") <= k, 1.0 / k)
    return d.withColumn("weight", weight).where("weight IS NOT NULL").select("date", "code", "weight")


def tradable(weights: DataFrame, panel: DataFrame, limit: float = 0.10) -> DataFrame:
    """weights without buys of names at their upper limit and shorts of names at their lower one, against the close of the
    market's date before; names without that close stay."""
    days = panel.select("date").distinct()
    days = days.withColumn("_prev", F.lag("date").over(Window.orderBy("date")))  # one row for each date
    closes = panel.select("date", "code", "close").join(days, "date")
    closes = closes.join(panel.select(F.col("date").alias("_prev"), "code", F.col("close").alias("_pre")), ["_prev", "code"], "left")
    move = F.round(F.col("close") / F.nullif(F.col("_pre"), F.lit(0.0)), 9)
    stuck = F.when(F.col("weight") > 0, move >= round(1 + limit, 9)).when(F.col("weight") < 0, move <= round(1 - limit, 9))
    d = weights.join(closes.select("date", "code", "close", "_pre"), ["date", "code"], "left")
    return d.where(~F.coalesce(stuck, F.lit(False))).select(weights.columns)


def full(weights: DataFrame) -> DataFrame:
    """Weights of each date scaled to a gross exposure of 1; dates of none at all go."""
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date"))
    return weights.withColumn("_gross", gross).where("_gross > 0").withColumn("weight", F.col("weight") / F.col("_gross")).drop("_gross")


def simulate(weights: DataFrame, panel: DataFrame, rate: float = COST, calendar: DataFrame | None = None) -> DataFrame:
    """date, gross, turnover, net, bench on every date of the calendar (date; by default those of the weights).

    Weights are taken as they are; see full. Dates of the calendar without weights are held in cash: a row of 0, and turnover
    is 1 on the next date that is traded, as on the first one. Else turnover is half the change of weights since the date
    before; names that enter or leave count whole.
    """
    held = weights.select("date").distinct().withColumn("held", F.lit(True))
    dates = held if calendar is None else calendar.select("date").distinct().join(held, "date", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    by_date = Window.orderBy("date")  # one row for each date
    dates = dates.withColumns({"_next": F.lead("date").over(by_date), "_carried": F.col("held") & F.coalesce(F.lag("held").over(by_date), F.lit(False))})
    now = weights.join(dates, "date")
    # Each holding is seen on its own date and, negated, on the next: their sum is the change.
    change = now.select("date", "code", "weight").unionByName(now.where("_next IS NOT NULL").select(F.col("_next").alias("date"), "code", (-F.col("weight")).alias("weight")))
    change = change.groupBy("date", "code").agg(F.sum("weight").alias("d")).groupBy("date").agg((F.sum(F.abs("d")) / 2).alias("turn"))
    gross = weights.join(panel.select("date", "code", "fwd"), ["date", "code"]).groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross"))
    bench = panel.groupBy("date").agg(F.avg("fwd").alias("bench"))
    d = dates.join(gross, "date", "left").join(change, "date", "left").join(bench, "date")
    turnover = F.when(~F.col("held"), 0.0).when(F.col("_carried"), F.col("turn")).otherwise(1.0)
    gained = F.when(F.col("held"), F.coalesce("gross", F.lit(0.0))).otherwise(0.0)
    return d.select("date", gained.alias("gross"), turnover.alias("turnover"), (gained - turnover * rate).alias("net"), F.coalesce("bench", F.lit(0.0)).alias("bench"))


def metrics(returns: DataFrame, x: str = "net", days: int = 252) -> DataFrame:
    """One row: n, ann_return, sharpe, max_drawdown, alpha, beta; no row for fewer than five returns."""
    up = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row for each date
    d = returns.withColumn("_eq", F.product(1 + F.col(x)).over(up)).withColumn("_dd", F.col("_eq") / F.max("_eq").over(up) - 1)
    out = d.agg(
        F.count(x).alias("n"),
        (F.pow(1 + F.avg(x), days) - 1).alias("ann_return"),
        (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * math.sqrt(days)).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        (F.regr_intercept(x, "bench") * days).alias("alpha"),
        F.regr_slope(x, "bench").alias("beta"),
    )
    return out.where("n >= 5")


def drawdown(returns: DataFrame, x: str = "net") -> DataFrame:
    """date, drawdown of the compounded returns from their highest so far."""
    up = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row for each date
    d = returns.select("date", F.product(1 + F.col(x)).over(up).alias("_eq"))
    return d.select("date", (F.col("_eq") / F.max("_eq").over(up) - 1).alias("drawdown"))


def trade_costs(trades: DataFrame, commission: float = 0.0003, least: float = 5.0, stamp: float = 0.0005, slippage_bp: float = 4.0) -> DataFrame:
    """Adds commission (with a floor), stamp duty and slippage of each trade's amount."""
    a = F.col("amount")
    return trades.withColumns({"commission": F.greatest(a * commission, F.lit(least)), "stamp": a * stamp, "slippage": a * slippage_bp / 1e4})


def deflated_sharpe(returns: DataFrame, x: str = "net", days: int = 252) -> DataFrame:
    """One row, deflated_sharpe: the probability that the annual Sharpe ratio, corrected for skew and kurtosis, is real."""
    m = F.col(x)
    d = returns.agg(F.count(m).alias("n"), F.avg(m).alias("m"), F.stddev_samp(m).alias("s"), F.skewness(m).alias("g1"), F.kurtosis(m).alias("g2"))
    n = F.col("n")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    sr = F.col("m") / F.nullif(F.col("s"), F.lit(0.0)) * math.sqrt(days)
    d = d.where("n >= 10").select("n", sr.alias("sr"), skew.alias("skew"), kurt.alias("kurt"))
    inside = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = F.when(inside > 0, F.sqrt(F.col("n") - 1) * F.col("sr") / F.sqrt(inside) - 1.645)
    return d.select(normal_cdf(z).alias("deflated_sharpe"))


def normal_cdf(z):
    """The normal distribution function by its continued rational approximation (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def folds(panel: DataFrame, train: int = 250, test: int = 20, step: int = 20) -> DataFrame:
    """fold, first_train, last_train, first_test, last_test as places of dates (from 0), one row for each fold."""
    n = panel.agg(F.countDistinct("date").alias("n"))
    n = n.withColumn("train", F.when(F.col("n") >= train + test, F.lit(train)).otherwise(F.greatest(F.lit(20), F.floor(F.col("n") / 3)))).withColumn("test", F.when(F.col("n") >= train + test, F.lit(test)).otherwise(F.col("n") - F.col("train")))
    n = n.where("test > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - F.col("train") - F.col("test"), F.lit(0)).cast("long"), F.lit(step).cast("long"))
    d = n.select("train", "test", F.posexplode(starts).alias("fold", "at"))
    return d.select(F.col("fold").cast("long").alias("fold"), F.col("at").alias("first_train"), (F.col("at") + F.col("train") - 1).cast("long").alias("last_train"), (F.col("at") + F.col("train")).cast("long").alias("first_test"), (F.col("at") + F.col("train") + F.col("test") - 1).cast("long").alias("last_test"))


def numbered_dates(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct().withColumn("place", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # one row for each date


def fold_weights(panel: DataFrame, factors: DataFrame, **kw) -> DataFrame:
    """fold, factor_name, weight: the mean daily IC of the training dates. Each date is dealt to its folds by its place."""
    f, dates = folds(panel, **kw), numbered_dates(panel)
    days = f.select("fold", F.explode(F.sequence("first_train", "last_train")).alias("place")).join(dates, "place")
    return daily_ic(panel, factors).join(days, "date").groupBy("fold", "factor_name").agg(F.avg("ic").alias("weight"))


def fold_alpha(panel: DataFrame, factors: DataFrame, **kw) -> DataFrame:
    """fold, date, code, alpha on test dates: the sum of IC weight times z-score. Factors enter by their sign in the IC."""
    f, dates = folds(panel, **kw), numbered_dates(panel)
    days = f.select("fold", F.explode(F.sequence("first_test", "last_test")).alias("place")).join(dates, "place").select("fold", "date")
    z = factors.where("value IS NOT NULL").withColumn("v", directions()[F.col("factor_name")] * F.col("value")).withColumn("z", xs_zscore("v", Window.partitionBy("date", "factor_name")))
    d = z.join(days, "date").join(fold_weights(panel, factors, **kw), ["fold", "factor_name"])
    return d.groupBy("fold", "date", "code").agg(F.sum(F.col("z") * F.col("weight")).alias("alpha"))


def exposure(weights: DataFrame, signals: DataFrame) -> DataFrame:
    """Weights scaled by the day's timing signal: buy 1, half 0.5, out 0; unknown days 0.5. What is not exposed is cash."""
    scale = F.when(F.col("signal") == "buy", 1.0).when(F.col("signal") == "out", 0.0).otherwise(0.5)
    return weights.join(signals.select("date", "signal"), "date", "left").select("date", "code", (F.col("weight") * scale).alias("weight"))


def signal_weights(signals: DataFrame, panel: DataFrame, least: float = 0.5, regimes: DataFrame | None = None, limit: float = 0.10) -> DataFrame:
    """Long weights of a gross of 1 in proportion to confidence, for direction 1 and confidence >= least.

    With regimes (date, regime: that of the date before) confidence is scaled first, so fewer names pass in bad ones. Names
    at their upper limit, against pre_close, are not bought.
    """
    d = signals.where(F.col("direction") == 1).select("date", "code", F.col("confidence").alias("weight"))
    if regimes is not None:
        d = d.join(regimes.select("date", "regime"), "date", "left").withColumn("weight", F.col("weight") * regime_scale(F.col("regime")))
    d = d.where(F.round("weight", 9) >= least).join(panel.select("date", "code", "close", "pre_close"), ["date", "code"], "left")
    stuck = F.coalesce(at_upper_limit(limit), F.lit(False))
    return full(d.where(~stuck).select("date", "code", "weight"))

"""Time-series factors of a code, each a window expression over the adjusted panel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import by_code, clip, ewm, lag, ratio, roll, xs_rank, xs_zscore


@dataclass(frozen=True)
class FactorSpec:
    """A factor: its expression, the sign of its bet, its weight, and the expression in SQL for the oracle."""

    build: Callable[[], Column]
    direction: int
    weight: float
    sql: str


P = "adj"


def rsi(n: int = 14) -> Column:
    """Wilder's relative strength; 50 where undefined. A first bar has no change and does not enter the means."""
    gain, loss = F.greatest(F.col("_change"), F.lit(0.0)), F.greatest(-F.col("_change"), F.lit(0.0))
    up, down = ewm(gain, 1 / n, F.col("_place")), ewm(loss, 1 / n, F.col("_place"))
    return F.coalesce(100 - 100 / (1 + ratio(up, down)), F.lit(50.0))


def with_change(panel: DataFrame) -> DataFrame:
    """Adds the helper columns of the factors: _change, _place (bars before this one), _log (log return)."""
    prev = lag(P)
    return panel.withColumns({"_change": F.col(P) - prev, "_place": (F.row_number().over(by_code()) - 1).cast("double"), "_log": F.when(prev > 0, F.ln(F.col(P) / prev))})


def _r(fn: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


def _lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY code ORDER BY date)"


_EWM = "sum({x} * pow(13.0 / 14, -_place) * CASE WHEN _place = 1 THEN 1 ELSE 1.0 / 14 END) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) * pow(13.0 / 14, _place)"
_UP, _DOWN = _EWM.format(x="greatest(_change, 0)"), _EWM.format(x="greatest(-_change, 0)")

FACTORS: dict[str, FactorSpec] = {
    "f_momentum_5": FactorSpec(lambda: F.col(P) / lag(P, 5) - 1, 1, 1.0, f"adj / {_lag('adj', 5)} - 1"),
    "f_momentum_20": FactorSpec(lambda: F.col(P) / lag(P, 20) - 1, 1, 1.0, f"adj / {_lag('adj', 20)} - 1"),
    "f_reversal_5": FactorSpec(lambda: lag(P, 5) / F.col(P) - 1, -1, 0.8, f"{_lag('adj', 5)} / adj - 1"),
    "f_trend_60": FactorSpec(lambda: F.col(P) / roll(F.avg, P, 60) - 1, 1, 0.9, f"adj / ({_r('avg', 'adj', 60)}) - 1"),
    "f_volatility_20": FactorSpec(lambda: roll(F.stddev_samp, "_log", 20), -1, 0.6, _r("stddev_samp", "_log", 20)),
    "f_volume_ratio_20": FactorSpec(lambda: F.col("vol") / roll(F.avg, "vol", 20), 1, 0.7, f"vol / ({_r('avg', 'vol', 20)})"),
    "f_amount_growth_20": FactorSpec(lambda: F.col("amount") / roll(F.avg, "amount", 20) - 1, 1, 0.6, f"amount / ({_r('avg', 'amount', 20)}) - 1"),
    "f_amplitude_20": FactorSpec(lambda: roll(F.avg, F.col("high") - F.col("low"), 20) / F.col(P), -1, 0.5, f"({_r('avg', '(high - low)', 20)}) / adj"),
    "f_rsi_14": FactorSpec(rsi, 1, 0.7, f"coalesce(100 - 100 / (1 + ({_UP}) / nullif({_DOWN}, 0)), 50)"),
    "f_high_low_pos_20": FactorSpec(lambda: ratio(F.col(P) - roll(F.min, "low", 20), roll(F.max, "high", 20) - roll(F.min, "low", 20)), 1, 0.7, f"(adj - ({_r('min', 'low', 20)})) / nullif(({_r('max', 'high', 20)}) - ({_r('min', 'low', 20)}), 0)"),
    "f_breakout_60": FactorSpec(lambda: F.col(P) / roll(F.max, "high", 60) - 1, 1, 0.8, f"adj / ({_r('max', 'high', 60)}) - 1"),
    "f_turnover_trend": FactorSpec(lambda: roll(F.avg, "vol", 5) / roll(F.avg, "vol", 20) - 1, 1, 0.5, f"({_r('avg', 'vol', 5)}) / ({_r('avg', 'vol', 20)}) - 1"),
}
SQL_CHANGE = "c AS (SELECT *, adj - lag(adj) OVER w AS _change, CAST(row_number() OVER w - 1 AS DOUBLE) AS _place, CASE WHEN lag(adj) OVER w > 0 THEN ln(adj / lag(adj) OVER w) END AS _log FROM p WINDOW w AS (PARTITION BY code ORDER BY date))"


def factor_wide(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The panel with a column for each factor."""
    return with_change(panel).withColumns({n: FACTORS[n].build() for n in names or FACTORS})


def factor_long(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """date, code, factor_name, value."""
    names = list(names or FACTORS)
    return factor_wide(panel, names).unpivot(["date", "code"], names, "factor_name", "value")


def alpha_features(panel: DataFrame) -> DataFrame:
    """The wider feature set of the return models: rates of change, means, deviations, positions and correlations."""
    vol, amount = F.nullif(F.col("vol"), F.lit(0.0)), F.nullif(F.col("amount"), F.lit(0.0))
    d = with_change(panel).withColumns({"_vol": vol, "_amount": amount}).withColumn("_dvol", F.col("_vol") / lag("_vol") - 1)
    p = F.col(P)
    f = {f"roc_{n}": p / lag(P, n) - 1 for n in (5, 10, 20, 60)}
    f |= {f"ma_{n}": roll(F.avg, P, n) / p - 1 for n in (5, 10, 20, 30, 60)}
    f |= {f"std_{n}": roll(F.stddev_samp, "_log", n) for n in (5, 10, 20, 60)}
    f |= {f"rsi_{n}": rsi(n) for n in (10, 20)}
    f |= {f"pos_{n}": ratio(p - roll(F.min, "low", n), roll(F.max, "high", n) - roll(F.min, "low", n)) for n in (5, 10, 20)}
    f |= {f"vrat_{n}": F.col("_vol") / roll(F.avg, "_vol", n) for n in (5, 10, 20)} | {f"arat_{n}": F.col("_amount") / roll(F.avg, "_amount", n) for n in (5, 10, 20)}
    f |= {f"p2h_{n}": p / roll(F.max, "high", n) - 1 for n in (20, 60)}
    f |= {"amp_20": roll(F.avg, F.col("high") - F.col("low"), 20) / p, "turn_trend": roll(F.avg, "_vol", 5) / roll(F.avg, "_vol", 20) - 1}
    w, both = by_code().rowsBetween(-19, 0), F.col("_log") * F.col("_dvol")
    spread = F.nullif(F.stddev_pop("_log").over(w) * F.stddev_pop("_dvol").over(w), F.lit(0.0))
    f["corr_rv_20"] = F.when(F.count(both).over(w) == 20, F.covar_pop("_log", "_dvol").over(w) / spread)
    return d.select("code", "date", *[c.alias(n) for n, c in f.items()])


def with_tech(panel: DataFrame, partial: bool = False) -> DataFrame:
    """The panel with tech_score in [-1, 1], of trend, relative strength and distance to the 60-bar high; null while one of
    them is unknown, or with `partial` of those that are known."""
    known = (lambda c: F.coalesce(c, F.lit(0.0))) if partial else (lambda c: c)
    d = with_change(panel).withColumns({"_ma5": roll(F.avg, P, 5), "_ma20": roll(F.avg, P, 20), "_rsi": rsi(), "_high": roll(F.max, P, 60)})
    score = 0.5 * clip(known(F.col("_ma5") / F.col("_ma20") - 1) / 0.05, -1, 1) + 0.3 * clip((F.col("_rsi") - 50) / 30, -1, 1) + 0.2 * clip(known(F.col(P) / F.col("_high") - 1) / 0.10, -1, 1)
    return d.withColumn("tech_score", clip(score, -1, 1))


def tech_score(panel: DataFrame) -> DataFrame:
    """date, code, tech_score as of with_tech."""
    return with_tech(panel).select("date", "code", "tech_score")


#: The weights of the six components.
SENTIMENT_WEIGHTS = {"turnover_anomaly": 0.3, "amplitude": 0.15, "limit_up_rate": 0.15, "return_skew": 0.2, "breadth_rank": 0.1, "relative_strength": 0.1}


def sentiment_components(panel: DataFrame, n: int = 20, names: Iterable[str] = tuple(SENTIMENT_WEIGHTS)) -> DataFrame:
    """Price-volume sentiment of each code and date: the components in `names`, missing values 0.

    return_skew is the bias-corrected skewness of the last n returns; relative_strength is the return over n bars less the
    mean of all codes' on the date; the first return of a code counts as 0 in breadth_rank.
    """
    d = panel.withColumns({"_ret0": F.coalesce("ret", F.lit(0.0)), "_gain": F.col(P) / lag(P, n) - 1})
    limit = (F.col("close") >= F.col("pre_close") * 1.095).cast("double")
    parts = {
        "turnover_anomaly": F.col("vol") / roll(F.avg, "vol", n) - 1,
        "amplitude": roll(F.avg, (F.col("high") - F.col("low")) / F.col(P), n),
        "limit_up_rate": roll(F.avg, limit, n),
        "return_skew": roll(F.skewness, "ret", n) * (math.sqrt(n * (n - 1)) / (n - 2)),
        "breadth_rank": xs_rank("_ret0"),
        "relative_strength": F.col("_gain") - F.avg("_gain").over(Window.partitionBy("date")),
    }
    return d.select("date", "code", *[F.coalesce(parts[k], F.lit(0.0)).alias(k) for k in names])


def sentiment_score(panel: DataFrame, weights: dict[str, float] = SENTIMENT_WEIGHTS) -> DataFrame:
    """The weighted sum of the components' daily z-scores, clipped to [-1, 1]."""
    z = sentiment_components(panel, names=weights)
    total = sum((w * xs_zscore(k) for k, w in weights.items()), F.lit(0.0))
    return z.select("date", "code", clip(total, -1, 1).alias("sentiment_score"))

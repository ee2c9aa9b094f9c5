"""Return predictors that are fitted on a code's own history, run for any targets by Spark.

A predictor is any class with fit(bars, horizon) and predict(bars, horizon); see Predictor. Histories and targets meet in a
cogroup by code, so a task holds one code's bars (at most a calendar) and asks for its targets one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Forecast:
    """A return over the horizon with a lower and an upper bound."""

    ret_pred: float
    lower: float
    upper: float


class Predictor(Protocol):
    """fit sees the bars of one code up to the target date and no later ones; predict gives None where it cannot tell."""

    def fit(self, bars: pd.DataFrame, horizon: int) -> None: ...

    def predict(self, bars: pd.DataFrame, horizon: int) -> Forecast | None: ...


class LeastSquares:
    """The return over the horizon as a line in the momentum of the last `lag` bars; bounds by the deviation of past returns."""

    def __init__(self, lag: int = 5, least: int = 20):
        self.lag, self.least, self.line = lag, least, None

    def _momentum(self, p: np.ndarray) -> np.ndarray:
        return np.concatenate([np.full(min(self.lag, len(p)), np.nan), p[self.lag :] / p[: -self.lag] - 1])

    def fit(self, bars: pd.DataFrame, horizon: int) -> None:
        p = bars["adj"].to_numpy(float)
        x, y = self._momentum(p)[:-horizon], p[horizon:] / p[:-horizon] - 1
        known = np.isfinite(x) & np.isfinite(y)
        x, y = x[known], y[known]
        self.line = None
        if len(x) >= self.least and (spread := ((x - x.mean()) ** 2).sum()) > 0:
            slope = ((x - x.mean()) * (y - y.mean())).sum() / spread
            self.line = slope, y.mean() - slope * x.mean(), y.std(ddof=1)

    def predict(self, bars: pd.DataFrame, horizon: int) -> Forecast | None:
        x = self._momentum(bars["adj"].to_numpy(float))[-1] if len(bars) else np.nan
        if self.line is None or not np.isfinite(x):
            return None
        slope, offset, sd = self.line
        mean = offset + slope * x
        return Forecast(mean, mean - 1.96 * sd, mean + 1.96 * sd)


class Momentum:
    """The momentum of the last `lag` bars carried on by the root of the horizon; nothing to fit."""

    def __init__(self, lag: int = 5):
        self.lag = lag

    def fit(self, bars: pd.DataFrame, horizon: int) -> None:
        return

    def predict(self, bars: pd.DataFrame, horizon: int) -> Forecast | None:
        p = bars["adj"].to_numpy(float)
        if len(p) <= self.lag:
            return None
        mean, sd = (p[-1] / p[-1 - self.lag] - 1) * horizon**0.5, np.std(np.diff(p) / p[:-1], ddof=1) * horizon**0.5
        return Forecast(mean, mean - 1.96 * sd, mean + 1.96 * sd)


def predict_targets(bars: DataFrame, targets: DataFrame, make: Callable[[], Predictor], least_bars: int = 30) -> DataFrame:
    """code, date, horizon, dir_pred, ret_pred, lower, upper for each target that the predictor can tell.

    bars: code, date, adj and whatever else the predictor reads; targets: code, date, horizon. For each target a new predictor
    is fitted on the code's bars up to the date; targets with fewer than least_bars of them have no row. Repeated targets are
    answered as often; codes without bars or targets have no rows.
    """

    def run(history: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        history = history.sort_values("date", kind="stable").reset_index(drop=True)
        dates = history["date"].to_numpy()
        rows = []
        for t in wanted.itertuples():
            n = int(np.searchsorted(dates, t.date, side="right"))
            if n < least_bars:
                continue
            seen, model = history.iloc[:n], make()
            model.fit(seen, t.horizon)
            f = model.predict(seen, t.horizon)
            if f is not None and np.isfinite(f.ret_pred):
                rows.append((t.code, t.date, t.horizon, int(np.sign(f.ret_pred)), float(f.ret_pred), float(f.lower), float(f.upper)))
        return pd.DataFrame(rows, columns=["code", "date", "horizon", "dir_pred", "ret_pred", "lower", "upper"])

    wanted = targets.select(F.col("code").alias("code"), F.col("date").alias("date"), F.col("horizon").cast("int").alias("horizon"))
    return bars.groupBy("code").cogroup(wanted.groupBy("code")).applyInPandas(run, "code string, date date, horizon int, dir_pred int, ret_pred double, lower double, upper double")

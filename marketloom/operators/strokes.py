"""Technical score from price strokes, bar by bar and without a look ahead.

A code's bars go once through a state machine of constant size: bars that include each other are merged, a merged bar above
(below) both its neighbours is a turning point, and turning points alternate if they are far enough apart; a stroke runs from
one to the next. The state after a bar depends on bars up to it only, so a score never changes when later bars arrive, and a
history costs time in proportion to its length. Spark deals the codes; a task holds one code's bars, at most a calendar.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.factors import with_tech

LEAST_BARS = 30  # before, the score is that of means, strength and breakout
LEAST_DISTANCE = 4  # merged bars from one end of a stroke to the other
POWERS = 6  # strokes that the usual power is taken from

#: The weights of direction, place in the range, power against the usual, and power against the stroke before.
WEIGHTS = (0.45, 0.30, 0.15, 0.10)


@dataclass
class StrokeMachine:
    """The state: the last three merged bars, the last ends of strokes, and the range since the last end."""

    merged: deque = field(default_factory=lambda: deque(maxlen=3))
    count: int = 0
    ends: deque = field(default_factory=lambda: deque(maxlen=POWERS + 1))  # (1 for a top or -1, price, number of the merged bar)
    high: float = float("-inf")
    low: float = float("inf")
    strokes: int = 0

    def push(self, high: float, low: float) -> None:
        self.high, self.low = max(self.high, high), min(self.low, low)
        if self.merged:
            h, l = self.merged[-1]
            if (high <= h and low >= l) or (high >= h and low <= l):
                falling = len(self.merged) > 1 and h < self.merged[-2][0]
                self.merged[-1] = (min(h, high), min(l, low)) if falling else (max(h, high), max(l, low))
                return
        self.merged.append((high, low))
        self.count += 1
        if len(self.merged) == 3:
            (h1, l1), (h2, l2), (h3, l3) = self.merged
            if h2 > max(h1, h3):
                self._turn(1, h2, high, low)
            elif l2 < min(l1, l3):
                self._turn(-1, l2, high, low)

    def _turn(self, kind: int, price: float, high: float, low: float) -> None:
        point = (kind, price, self.count - 2)
        if self.ends:
            last, was, at = self.ends[-1]
            if kind == last:
                if (price - was) * kind <= 0:
                    return
                self.ends[-1] = point
            elif point[2] - at >= LEAST_DISTANCE and (price - was) * kind > 0:
                self.ends.append(point)
                self.strokes += 1
            else:
                return
        else:
            self.ends.append(point)
        self.high, self.low = high, low  # the range since the turn starts with the bar that confirms it

    def score(self, close: float) -> float:
        """The score of the stroke that is under way: opposite to the last one, from its end on. 0 before there is a stroke."""
        if len(self.ends) < 2:
            return 0.0
        prices = [p for _, p, _ in self.ends]
        powers = np.maximum(np.abs(np.diff(prices)), 1e-9)
        usual, direction = float(powers.mean()), -self.ends[-1][0]
        low, high = min(prices[-1], self.low), max(prices[-1], self.high)
        place = min(max((close - low) / (high - low), 0.0), 1.0) if high - low > 1e-9 else 0.5
        relative = lambda x: (min(max(x, 0.4), 1.6) - 1) / 0.6
        # What is under way counts as of usual power, so the third term is 0 while it is.
        terms = (1.0, place if direction > 0 else 1 - place, relative(1.0), relative(usual / float(powers[-1])))
        return min(max(direction * sum(w * t for w, t in zip(WEIGHTS, terms, strict=True)), -1.0), 1.0)


def stroke_scores(panel: DataFrame) -> DataFrame:
    """date, code, tech_score in [-1, 1], direction (of the stroke under way; 0 if none), strokes (finished so far).

    panel: date, code, high, low, close, vol, adj. Prices are adjusted by adj / close. A bar without prices changes nothing and has a
    null score; a code's first LEAST_BARS - 1 bars are scored by means, strength and breakout as far as they are known.
    """
    d = with_tech(panel, partial=True)
    ratio = F.coalesce(F.col("adj") / F.nullif(F.col("close"), F.lit(0.0)), F.lit(1.0))
    d = d.select("date", "code", (F.col("high") * ratio).alias("high"), (F.col("low") * ratio).alias("low"), "adj", F.col("tech_score").alias("plain"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        machine, bars, out = StrokeMachine(), 0, []
        for high, low, close, plain in zip(pdf["high"], pdf["low"], pdf["adj"], pdf["plain"], strict=True):
            if np.isnan([high, low, close]).any():
                out.append((None, 0, machine.strokes))
                continue
            machine.push(high, low)
            bars += 1
            under_way = -machine.ends[-1][0] if len(machine.ends) > 1 else 0
            out.append((plain if bars < LEAST_BARS else machine.score(close), under_way, machine.strokes))
        return pd.DataFrame({"date": pdf["date"], "code": pdf["code"], **dict(zip(("tech_score", "direction", "strokes"), zip(*out, strict=True), strict=True))})

    return d.groupBy("code").applyInPandas(run, "date date, code string, tech_score double, direction int, strokes int")

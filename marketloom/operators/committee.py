"""A committee of MLlib regressors for each horizon: folds by date, a choice by the share of right directions, stored models.

Rows of all codes are split by date only, and training rows whose outcome reaches into the dates that follow are left out, so no
fold sees its future. The last `tail` dates take no part in choosing or fitting; predictions are for them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.backtest import numbered_dates

CANDIDATES: dict[str, Callable[[], Estimator]] = {
    "ridge": lambda: LinearRegression(featuresCol="x", labelCol="y", regParam=0.1),
    "forest": lambda: RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=12, maxDepth=4, seed=7),
    "boosting": lambda: GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, maxDepth=3, stepSize=0.1, seed=7),
}
LEAST_ROWS = 240


class DirectionAccuracy(Evaluator):
    """The share of rows whose prediction has the outcome's sign; null for no rows."""

    def _evaluate(self, dataset: DataFrame) -> float | None:
        return dataset.agg(F.avg((F.signum("prediction") == F.signum("y")).cast("double"))).first()[0]

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


@dataclass(frozen=True)
class Chosen:
    """A horizon's chosen model, its accuracy over the folds, those of all candidates, and where it is stored."""

    horizon: int
    model: str
    dir_acc: float
    scores: dict[str, list[float]]
    path: str


def _pipeline(names: list[str], model: Estimator) -> Pipeline:
    filled = [f"_{n}" for n in names]
    return Pipeline(stages=[Imputer(inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="x"), model])


def fit_committee(
    features: DataFrame, labels: DataFrame, names: list[str], folder: str, horizons: tuple[int, ...] = (1, 5, 10), folds: int = 3, tail: int = 20, threads: int = 4
) -> list[Chosen]:
    """For each horizon with rows enough, the candidate with the best mean direction accuracy over expanding folds of dates,
    fitted again on all dates before the tail and saved under `folder`.

    features: date, code, names; labels: date, code, horizon, label. Outcomes are clipped to +-0.5; training rows with a null
    feature or outcome are left out.
    """
    dates = numbered_dates(features)
    last = dates.agg(F.max("place")).first()[0]
    head = -1 if last is None else last - tail
    rows = features.select("date", "code", *names).join(dates, "date").where(F.col("place") <= head).dropna(subset=names)
    rows = rows.join(labels.where("label IS NOT NULL").select("date", "code", "horizon", F.greatest(F.least("label", F.lit(0.5)), F.lit(-0.5)).alias("y")), ["date", "code"])
    rows = rows.select("place", "horizon", "y", *names).cache()
    edges = [head // 2 + (head - head // 2) * k // folds for k in range(folds + 1)] if head > 0 else []

    def score(job: tuple[int, str, int]) -> tuple[tuple[int, str, int], float | None]:
        h, name, k = job
        mine = rows.where(F.col("horizon") == h)
        train = mine.where(F.col("place") + h <= edges[k])
        test = mine.where((F.col("place") > edges[k]) & (F.col("place") <= edges[k + 1]))
        return job, DirectionAccuracy().evaluate(_pipeline(names, CANDIDATES[name]()).fit(train).transform(test))

    def finish(h: int) -> Chosen:
        scores = {n: [found[h, n, k] for k in range(folds) if found[h, n, k] is not None] for n in CANDIDATES}
        mean = {n: sum(s) / len(s) for n, s in scores.items() if s}
        best = max(mean, key=lambda n: (mean[n], n))
        train = rows.where((F.col("horizon") == h) & (F.col("place") + h <= head))
        path = f"{folder}/horizon={h}"
        _pipeline(names, CANDIDATES[best]()).fit(train).write().overwrite().save(path)
        return Chosen(h, best, mean[best], scores, path)

    try:
        enough = {r.horizon for r in rows.groupBy("horizon").count().where(F.col("count") >= LEAST_ROWS).collect()}  # a few horizons
        with ThreadPoolExecutor(threads) as pool:
            found = dict(pool.map(score, [(h, n, k) for h in horizons if h in enough for n in CANDIDATES for k in range(folds)]))
            return list(pool.map(finish, [h for h in horizons if h in enough]))
    finally:
        rows.unpersist()


def committee_scores(features: DataFrame, chosen: list[Chosen]) -> DataFrame:
    """horizon, model, fold, dir_acc, chosen."""
    rows = [(c.horizon, n, k, s, n == c.model) for c in chosen for n, found in c.scores.items() for k, s in enumerate(found)]
    return features.sparkSession.createDataFrame(rows, "horizon int, model string, fold int, dir_acc double, chosen boolean")


def committee_predictions(features: DataFrame, names: list[str], chosen: list[Chosen], tail: int = 20, band: str = "band") -> DataFrame:
    """date, code, horizon, model, dir_pred, ret_pred, lower, upper, dir_acc for the last `tail` dates, by the stored models.

    Missing features are filled with the training means. features: date, code, names, and the deviation of returns `band`.
    """
    dates = numbered_dates(features)
    start = dates.agg((F.max("place") - tail).alias("start"))
    d = features.join(dates.join(start, F.col("place") > F.col("start"), "left_semi").select("date"), "date", "left_semi")
    out = d.sparkSession.createDataFrame([], "date date, code string, horizon int, model string, dir_pred int, ret_pred double, lower double, upper double, dir_acc double")
    for c in chosen:
        p = PipelineModel.load(c.path).transform(d)
        half = 1.96 * F.coalesce(F.col(band), F.lit(0.0)) * c.horizon**0.5
        out = out.unionByName(p.select(
            "date", "code", F.lit(c.horizon).alias("horizon"), F.lit(c.model).alias("model"), F.signum("prediction").cast("int").alias("dir_pred"),
            F.col("prediction").alias("ret_pred"), (F.col("prediction") - half).alias("lower"), (F.col("prediction") + half).alias("upper"), F.lit(c.dir_acc).alias("dir_acc"),
        ))
    return out

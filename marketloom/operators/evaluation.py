"""Walk-forward evaluation of predictors that can be stopped and resumed.

Work is keyed by (model, code, horizon). Keys are dealt into batches; a batch writes its pairs of prediction and outcome to a
folder of its own and then its finished keys, whose complete folder is the commit. A run first takes the committed keys away by
an anti join, so a run that was killed loses at most the batches under way; what these left is overwritten or ignored. Scores
are always taken over all committed pairs, stored and new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import clip, spearman_by
from marketloom.operators.predictors import Predictor, predict_targets

PAIRS = "model string, code string, horizon int, date date, dir_pred int, dir int, ret_pred double, actual double"
KEYS = "model string, code string, horizon int"


def complete(spark: SparkSession, path: str) -> list[str]:
    """The names of folders under `path` that a job has written to its end, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


class EvaluationStore:
    """Pairs and finished keys under a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, schema: str) -> DataFrame:
        names = complete(self.spark, f"{self.path}/done")
        paths = [f"{self.path}/{kind}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        """All committed pairs: model, code, horizon, date, dir_pred, dir, ret_pred, actual."""
        return self._read("pairs", PAIRS)

    def finished(self) -> DataFrame:
        """All committed keys, also of codes that gave no pair."""
        return self._read("done", KEYS)

    def commit(self, name: str, pairs: DataFrame, keys: DataFrame) -> None:
        """Both folders are replaced, so a batch that is run again changes nothing; the keys come last."""
        pairs.write.mode("overwrite").parquet(f"{self.path}/pairs/{name}")
        keys.write.mode("overwrite").parquet(f"{self.path}/done/{name}")


def to_evaluate(labels: DataFrame, last: int) -> DataFrame:
    """code, date, horizon, dir, label of the last dates of each code and horizon whose outcome is known and not 0."""
    back = F.row_number().over(Window.partitionBy("code", "horizon").orderBy(F.desc("date")))
    return labels.where("label IS NOT NULL AND dir <> 0").withColumn("_back", back).where(F.col("_back") <= last).drop("_back")


def evaluate_resumably(
    store: EvaluationStore, model: str, bars: DataFrame, labels: DataFrame, make: Callable[[], Predictor], horizons: tuple[int, ...] = (1, 5, 10), last: int = 15, batches: int = 4, stop_after: int | None = None
) -> None:
    """Evaluates the codes of `bars` that the store has not finished for the model, in at most `batches` commits.

    labels: code, date, horizon, label, dir (see crosssec.labels). For each code and horizon the predictor is fitted at the `last`
    dates with an outcome, on bars up to the date. stop_after: commits after which to stop, as a killed run would.
    """
    keys = bars.select("code").distinct().select(F.lit(model).alias("model"), "code", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    todo = keys.join(store.finished(), ["model", "code", "horizon"], "left_anti")
    batch = F.pmod(F.xxhash64("code", "horizon"), F.lit(batches))
    generation = len(complete(store.spark, f"{store.path}/done"))
    wanted = to_evaluate(labels, last)
    left = sorted(r.b for r in todo.select(batch.alias("b")).distinct().collect())  # at most `batches` numbers
    for b in left[:stop_after]:
        mine = todo.where(batch == b)
        targets = wanted.join(mine, ["code", "horizon"], "left_semi")
        found = predict_targets(bars, targets, make).join(targets, ["code", "date", "horizon"])
        pairs = found.select(F.lit(model).alias("model"), "code", "horizon", "date", "dir_pred", "dir", "ret_pred", F.col("label").alias("actual"))
        # Named by what it starts from: a run that resumes overwrites what a killed one left, and nothing else.
        store.commit(f"{model}-{generation + left.index(b)}", pairs, mine)


def model_gate(pairs: DataFrame, window: int = 3, near: float = 0.02, target: float = 0.05, weight: float = 0.25, least_acc: float = 0.52) -> DataFrame:
    """model, dir_acc, ic, rolling_ic, dropped, weight: over all pairs of a model, by date.

    The weight grows with the mean IC from `near` to `target`; it is 0 if the last `window` rolling means of `window` dates are all
    within `near` of 0. Models without an IC (fewer than 3 pairs on every date) are weighted by dir_acc, from least_acc on.
    """
    acc = pairs.where("dir <> 0").groupBy("model").agg(F.avg((F.col("dir_pred") == F.col("dir")).cast("double")).alias("dir_acc"))
    ic = spearman_by(pairs, "ret_pred", "actual", ("model", "date")).where("ic IS NOT NULL")
    by = Window.partitionBy("model").orderBy("date")
    span = by.rowsBetween(1 - window, 0)
    ic = ic.withColumns({"rolling": F.when(F.count("ic").over(span) == window, F.avg("ic").over(span)), "back": F.row_number().over(Window.partitionBy("model").orderBy(F.desc("date")))})
    last = F.col("back") <= window
    gate = ic.groupBy("model").agg(
        F.avg("ic").alias("ic"),
        F.max(F.when(F.col("back") == 1, F.col("rolling"))).alias("rolling_ic"),
        (F.count(F.when(last, F.col("rolling"))) == window).alias("_enough"),
        F.bool_and(F.when(last, F.abs(F.round("rolling", 9)) < near)).alias("_flat"),
    )
    d = acc.join(gate, "model", "left").withColumn("dropped", F.coalesce(F.col("_enough") & F.col("_flat"), F.lit(False)))
    by_ic = weight * clip((F.col("ic") - near) / (target - near), 0, 1)
    by_acc = F.when(F.round("dir_acc", 9) < least_acc, 0.0).otherwise(weight * F.greatest(2 * (F.col("dir_acc") - 0.5), F.lit(0.0)))
    return d.select("model", "dir_acc", "ic", "rolling_ic", "dropped", F.when(F.col("dropped"), 0.0).otherwise(F.coalesce(by_ic, by_acc, F.lit(0.0))).alias("weight"))

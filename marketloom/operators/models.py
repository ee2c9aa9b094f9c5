"""Combining models: a vote of predictions, and sentiment blended with hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.stats import xs_zscore


def predict_vote(votes: DataFrame) -> DataFrame:
    """date, code, vote: the mean direction of the models weighted by their weight, then a daily z-score. votes: date, code, dir, weight."""
    d = votes.where("weight > 0").groupBy("date", "code").agg((F.sum(F.col("dir") * F.col("weight")) / F.sum("weight")).alias("raw"))
    return d.select("date", "code", xs_zscore("raw").alias("vote"))


def blend_hotspots(sentiment: DataFrame, hot: DataFrame, alpha: float = 0.3) -> DataFrame:
    """sentiment (date, code, sentiment_score) z-scored by date, blended with hot (code, score) where a code has both."""
    z = sentiment.select("date", "code", xs_zscore("sentiment_score").alias("z")).join(hot, "code", "left")
    return z.select("date", "code", F.when(F.col("score").isNotNull(), alpha * F.col("score") + (1 - alpha) * F.col("z")).otherwise(F.col("z")).alias("sentiment_score"))

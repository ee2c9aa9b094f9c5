"""Cross-section operators: factor health, neutralisation, predictions and signal fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import by_code, clip, lead, roll, sigmoid, spearman_by, xs_rank, xs_zscore
from marketloom.operators.factors import FACTORS, SENTIMENT_WEIGHTS, factor_long, sentiment_score, tech_score


def directions() -> Column:
    return F.create_map(*[F.lit(x) for n, s in FACTORS.items() for x in (n, float(s.direction))])


def daily_ic(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """factor_name, date, ic: rank correlation of direction * value with the next return, on dates of 3 names or more."""
    signed = factors.withColumn("v", directions()[F.col("factor_name")] * F.col("value"))
    return spearman_by(signed.join(panel.select("date", "code", "fwd"), ["date", "code"]), "v", "fwd", ("factor_name", "date"))


def top_quintile(values: DataFrame, x: str = "value", by: tuple[str, ...] = ("date",), bins: int = 5) -> Column:
    """The bin (0 to bins - 1) of a row by rank, ties by code, as quantile cutting of ranks gives it."""
    w = Window.partitionBy(*by)
    r, n = F.row_number().over(w.orderBy(x, "code")), F.count(F.lit(1)).over(w)
    return F.when(n > 1, F.greatest(F.ceil((r - 1) * bins / (n - 1)) - 1, F.lit(0))).otherwise(F.lit(0)).cast("int")


def factor_health(panel: DataFrame, factors: DataFrame, window: int = 60) -> DataFrame:
    """Per factor over the last `window` dates with a next return: ic, icir, rank_return, turnover, status, weight_scale."""
    dates = panel.where("fwd IS NOT NULL").select("date").distinct().orderBy(F.desc("date")).limit(window)
    ic = daily_ic(panel, factors).join(dates, "date", "left_semi").groupBy("factor_name").agg(F.avg("ic").alias("ic"), F.stddev_pop("ic").alias("sd"), F.count("ic").alias("days"))
    rows = factors.where("value IS NOT NULL").join(dates, "date", "left_semi").join(panel.select("date", "code", "fwd"), ["date", "code"]).where("fwd IS NOT NULL")
    rows = rows.withColumn("v", directions()[F.col("factor_name")] * F.col("value"))
    ranked = rows.withColumns({"bin": top_quintile(rows, "v", ("factor_name", "date")), "rk": xs_rank("v", ("factor_name", "date"))})
    by_code = Window.partitionBy("factor_name", "code").orderBy("date")
    moved = ranked.withColumn("turn", F.abs(F.col("rk") - F.lag("rk").over(by_code)))
    rest = moved.groupBy("factor_name").agg(F.avg(F.when(F.col("bin") == 4, F.col("fwd"))).alias("rank_return"), F.avg("turn").alias("turnover"))
    icir = F.coalesce(F.col("ic") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt("days"), F.lit(0.0))
    status = F.when(F.round("ic", 9) >= 0.02, "effective").when(F.round("ic", 9) >= 0.01, "decaying").otherwise("failed")
    scale = F.when(F.round("ic", 9) >= 0.02, 1.0).when(F.round("ic", 9) >= 0.01, 0.5).otherwise(0.1)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ic.join(rest, "factor_name", "left").select("factor_name", zero("ic"), icir.alias("icir"), zero("rank_return"), zero("turnover"), status.alias("status"), scale.alias("weight_scale"))


def health_summary(health: DataFrame) -> DataFrame:
    """status, n, avg_icir of a table of factor_health."""
    return health.groupBy("status").agg(F.count("*").alias("n"), F.avg("icir").alias("avg_icir"))


def model_summary(predictions: DataFrame) -> DataFrame:
    """model, codes (that it has ever predicted), last (date), latest (predictions on it), up (of these). One pass, no query a model.

    predictions: model, date, code, dir_pred.
    """
    last = predictions.groupBy("model").agg(F.max("date").alias("last"), F.countDistinct("code").alias("codes"))
    return predictions.join(last, "model").groupBy("model", "codes", "last").agg(F.count_if(F.col("date") == F.col("last")).alias("latest"), F.count_if((F.col("date") == F.col("last")) & (F.col("dir_pred") > 0)).alias("up"))


def neutralize(values: DataFrame) -> DataFrame:
    """Residual z-scores of value on log size and industry, per (date, factor_name).

    values: date, code, factor_name, value, industry, mv. Demeaning both sides within industries leaves one slope, so the
    regression on dummies is windows only. Where all sizes of a date are equal the slope is 0. Null values are dropped.
    A date with a name that lacks industry or size keeps its plain z-score.
    """
    day = Window.partitionBy("date", "factor_name")
    inside = Window.partitionBy("date", "factor_name", "industry")
    d = values.where("value IS NOT NULL").withColumn("_lmv", F.ln(F.greatest("mv", F.lit(1e-9))))
    d = d.withColumn("_whole", F.min((F.col("industry").isNotNull() & F.col("mv").isNotNull()).cast("int")).over(day) == 1)
    d = d.withColumns({"_y": F.col("value") - F.avg("value").over(inside), "_x": F.col("_lmv") - F.avg("_lmv").over(inside)})
    slope = F.coalesce(F.sum(F.col("_x") * F.col("_y")).over(day) / F.nullif(F.sum(F.col("_x") * F.col("_x")).over(day), F.lit(0.0)), F.lit(0.0))
    d = d.withColumn("_res", F.when(F.col("_whole"), F.round(F.col("_y") - slope * F.col("_x"), 9)).otherwise(F.col("value")))  # rounded, so that no z-score is made of rounding errors
    return d.select("date", "code", "factor_name", xs_zscore("_res", day).alias("value"))


def labels(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """date, code, horizon, label (forward return), excess (over the date's mean), dir (its sign, 0 if missing)."""
    cols = {f"h{h}": lead("adj", h) / F.col("adj") - 1 for h in horizons}
    long = panel.select("date", "code", *[c.alias(n) for n, c in cols.items()]).unpivot(["date", "code"], list(cols), "h", "label")
    w = Window.partitionBy("date", "h")
    return long.select("date", "code", F.substring("h", 2, 9).cast("int").alias("horizon"), "label", (F.col("label") - F.avg("label").over(w)).alias("excess")).withColumn("dir", F.coalesce(F.signum(F.round("excess", 9)), F.lit(0.0)).cast("int"))


def baseline(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """date, code, horizon, ret_pred, lower, upper: five-bar momentum scaled by the root of the horizon."""
    band = F.coalesce(roll(F.stddev_samp, "ret", 20), F.stddev_samp("ret").over(Window.partitionBy("code")))
    d = panel.select("date", "code", (F.col("adj") / F.lag("adj", 5).over(by_code()) - 1).alias("mom"), band.alias("band"))
    d = d.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    pred, half = F.col("mom") * F.sqrt("horizon"), 1.96 * F.col("band") * F.sqrt("horizon")
    return d.select("date", "code", "horizon", pred.alias("ret_pred"), (pred - half).alias("lower"), (pred + half).alias("upper"))


def evaluate(pred: DataFrame, label: DataFrame) -> DataFrame:
    """Per horizon: share of right directions, mean absolute error, and the weight the model gets."""
    d = pred.join(label, ["date", "code", "horizon"]).where("ret_pred IS NOT NULL AND excess IS NOT NULL")
    hit = F.when(F.round("excess", 9) != 0, (F.signum("ret_pred") == F.signum("excess")).cast("double"))
    d = d.groupBy("horizon").agg(F.avg(hit).alias("dir_acc"), F.avg(F.abs(F.col("ret_pred") - F.col("label"))).alias("mae"))
    acc = F.round("dir_acc", 9)
    return d.withColumn("weight", F.when(acc < 0.52, 0.0).otherwise(0.25 * F.greatest(2 * (F.col("dir_acc") - 0.5), F.lit(0.0))))


def ic_gate(pred: DataFrame, label: DataFrame) -> DataFrame:
    """Per horizon: mean daily IC, last rolling mean of three, dropped (last three rolling means all within 0.02 of 0), weight."""
    d = spearman_by(pred.join(label, ["date", "code", "horizon"]), "ret_pred", "label", ("horizon", "date"))
    w = Window.partitionBy("horizon").orderBy("date")
    near = w.rowsBetween(-2, 0)
    d = d.withColumn("rolling", F.when(F.count("ic").over(near) == 3, F.avg("ic").over(near)))
    last = d.withColumn("back", F.row_number().over(Window.partitionBy("horizon").orderBy(F.desc("date"))))
    out = last.groupBy("horizon").agg(F.avg("ic").alias("ic"), F.max(F.when(F.col("back") == 1, F.col("rolling"))).alias("rolling_ic"), F.coalesce(F.bool_and(F.when(F.col("back") <= 3, F.abs(F.round("rolling", 9)) < 0.02)), F.lit(False)).alias("dropped"))
    weight = 0.25 * clip((F.col("ic") - 0.02) / 0.03, 0, 1)
    return out.withColumn("weight", F.when(F.col("dropped"), 0.0).otherwise(F.coalesce(weight, F.lit(0.0))))


FUSION_WEIGHTS = {"factor": 0.40, "tech": 0.20, "sentiment": 0.15, "predict": 0.25}


#: What a market regime leaves of a signal's confidence.
REGIME_SCALE = {"bull": 1.0, "neutral": 1.0, "bear": 0.70, "panic": 0.45}


def regime_scale(regime: Column) -> Column:
    """The scale of a regime; 1 for none and unknown ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in REGIME_SCALE.items() for x in kv])[regime], F.lit(1.0))


def factor_score(factors: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """date, code, factor: the mean of z * direction over the factors that a code has, by `weights` (factor_name, weight; 1 if none)."""
    z = factors.where("value IS NOT NULL").withColumn("z", xs_zscore("value", Window.partitionBy("date", "factor_name")))
    if weights is None:
        z = z.withColumn("weight", F.lit(1.0))
    else:
        z = z.join(weights.select("factor_name", "weight"), "factor_name", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    bet = F.col("z") * directions()[F.col("factor_name")] * F.col("weight")
    return z.groupBy("date", "code").agg((F.sum(bet) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("factor"))


def fuse(
    panel: DataFrame, dead_zone: float = 0.05, sentiment: dict[str, float] = SENTIMENT_WEIGHTS, weights: DataFrame | None = None, hot: DataFrame | None = None, regimes: DataFrame | None = None,
    universe: DataFrame | None = None, alpha: float = 0.3, tech: DataFrame | None = None,
) -> DataFrame:
    """date, code, total, direction, confidence, source_tags and contributions of factors, technical score, sentiment and prediction.

    Each source is a z-score by date, missing ones count 0; the total weighs them by FUSION_WEIGHTS, contributions and tags
    are of the z-scores themselves. Optional: weights (factor_name, weight) from the factors' health; hot (code, score),
    which makes up `alpha` of the sentiment of codes that have it; regimes (date, regime), which scale the confidence and
    never the direction; universe (code), the only codes that are returned; tech (date, code, tech_score) instead of the
    score of means, strength and breakout.
    """
    factor = factor_score(factor_long(panel), weights)
    tech = (tech_score(panel) if tech is None else tech).select("date", "code", xs_zscore("tech_score").alias("tech"))
    mood = sentiment_score(panel, sentiment).select("date", "code", xs_zscore("sentiment_score").alias("sentiment"))
    if hot is not None:
        mood = mood.join(hot.select("code", "score"), "code", "left")
        mood = mood.select("date", "code", F.coalesce(alpha * F.col("score") + (1 - alpha) * F.col("sentiment"), "sentiment").alias("sentiment"))
    pred = baseline(panel, (1,)).where("ret_pred IS NOT NULL").select("date", "code", F.signum("ret_pred").alias("vote"))
    pred = pred.select("date", "code", xs_zscore("vote").alias("predict"))
    d = factor.join(tech, ["date", "code"], "full").join(mood, ["date", "code"], "full").join(pred, ["date", "code"], "full")
    if universe is not None:
        d = d.join(universe.select("code"), "code", "left_semi")
    parts = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in FUSION_WEIGHTS}
    total = F.round(sum((w * parts[k] for k, w in FUSION_WEIGHTS.items()), F.lit(0.0)), 6)
    d = d.select("date", "code", *[F.round(c, 4).alias(f"{k}_contrib") for k, c in parts.items()], *[c.alias(f"_{k}") for k, c in parts.items()], total.alias("total"))
    direction = F.when(F.col("total") > dead_zone, 1).when(F.col("total") < -dead_zone, -1).otherwise(0)
    tags = F.concat_ws(",", *[F.when(F.round(F.abs(f"_{k}"), 6) > 0.01, F.lit(k)) for k in FUSION_WEIGHTS])
    d = d.withColumns({"direction": direction, "confidence": F.round(sigmoid(2.5 * F.abs("total")), 3), "source_tags": F.when(tags == "", "none").otherwise(tags)})
    d = d.drop(*[f"_{k}" for k in FUSION_WEIGHTS])
    if regimes is None:
        return d
    scaled = F.round(F.least(F.lit(1.0), F.col("confidence") * regime_scale(F.col("regime"))), 3)
    return d.join(regimes.select("date", "regime"), "date", "left").withColumn("confidence", scaled).drop("regime")

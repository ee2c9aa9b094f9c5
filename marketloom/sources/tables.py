"""Table readers and writers: point and latest loads, upserts, source priority, paging and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _F, _I, _B = T.DateType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
#: Columns of the persistent tables, and their keys.
SCHEMAS: dict[str, tuple[list[tuple[str, T.DataType]], tuple[str, ...]]] = {
    "daily_bars": ([("code", _S), ("date", _D), ("open", _F), ("high", _F), ("low", _F), ("close", _F), ("pre_close", _F), ("adj_back_close", _F), ("adj_front_close", _F), ("vol", _F), ("amount", _F), ("source", _S)], ("code", "date")),
    "factor_values": ([("date", _D), ("code", _S), ("factor_name", _S), ("value", _F)], ("date", "code", "factor_name")),
    "factor_health": ([("factor_name", _S), ("date", _D), ("ic", _F), ("icir", _F), ("rank_return", _F), ("turnover", _F), ("status", _S), ("weight", _F)], ("factor_name", "date")),
    "signals": ([("date", _D), ("code", _S), ("direction", _I), ("confidence", _F), ("source_tags", _S), ("factor_contrib", _F), ("tech_contrib", _F), ("sentiment_contrib", _F), ("predict_contrib", _F)], ("date", "code")),
    "universe": ([("date", _D), ("code", _S), ("name", _S), ("in_universe", _B), ("is_st", _B), ("listed_days", _I), ("delisted", _B)], ("date", "code")),
    "predict_values": ([("code", _S), ("date", _D), ("model_name", _S), ("horizon", _I), ("dir_pred", _I), ("ret_pred", _F), ("lower", _F), ("upper", _F), ("dir_acc_hist", _F)], ("code", "date", "model_name", "horizon")),
    "watchlist": ([("code", _S), ("name", _S), ("cost_price", _F), ("shares", _F), ("created_at", T.TimestampNTZType())], ("code",)),
}


def struct_type(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in SCHEMAS[name][0]])


def load(df: DataFrame, codes: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the codes between two dates; the conditions reach the scan."""
    if codes:
        df = df.where(F.col("code").isin(codes))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def load_at(df: DataFrame, on: str = "date", at: str | None = None, **equal: object) -> DataFrame:
    """Rows that equal the given columns, on the date `at`, or on the last date that any such row has."""
    for c, v in equal.items():
        df = df.where(F.col(c) == F.lit(v))
    return latest(df, on=on) if at is None else df.where(F.col(on) == F.lit(at).cast("date"))


def latest(df: DataFrame, by: tuple[str, ...] = (), on: str = "date") -> DataFrame:
    """The rows of the latest `on`: of the table, or of each group. One aggregate joined back, so a group may be any size."""
    top = df.groupBy(*by).agg(F.max(on).alias("_top"))
    if by:
        return df.join(top, list(by)).where(F.col(on) == F.col("_top")).drop("_top")
    return df.join(top, F.col(on) == F.col("_top"), "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, by: str = "date") -> None:
    """Replaces the partitions that df has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def first_source(bars: DataFrame, priority: Column) -> DataFrame:
    """Of each code and date the row of the source with the least priority number (ties by name)."""
    w = Window.partitionBy("code", "date").orderBy(priority, "source")
    return bars.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def divergence(a: DataFrame, b: DataFrame, limit: float = 0.03) -> DataFrame:
    """code, date, price_a, price_b, diff where two sources' closes differ by more than the limit."""
    d = a.select("code", "date", F.col("close").alias("price_a")).join(b.select("code", "date", F.col("close").alias("price_b")), ["code", "date"])
    d = d.withColumn("diff", F.round(F.abs(F.col("price_a") - F.col("price_b")) / F.nullif(F.col("price_a"), F.lit(0.0)), 9))
    return d.where(F.col("diff") > limit)


def to_resume(codes: DataFrame, bars: DataFrame, end: DataFrame) -> DataFrame:
    """Codes whose bars do not reach the date in `end` (one row, end), or that have none."""
    last = bars.groupBy("code").agg(F.max("date").alias("d"))
    return codes.join(last.join(end, F.col("d") >= F.col("end"), "left_semi"), "code", "left_anti")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of at most 2000 rows."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 2000))


def normalize_columns(df: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames columns by the first rule one of whose words is in the column's name; others go. rules: new name to words."""
    used: dict[str, str] = {}
    for c in df.columns:
        for name, words in rules.items():
            if name not in used and any(w in c.lower() for w in words):
                used[name] = c
                break
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in used.items()])


def synthetic_bars(spark: SparkSession, codes: int, days: int, seed: int = 0) -> DataFrame:
    """A random walk of weekday bars for tests: 2 % volatility and rare moves of 9.9 %."""
    dates = f"filter(sequence(date'2024-01-01', date'2024-01-01' + {2 * days}), d -> weekday(d) < 5)"
    d = spark.range(codes).select(F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("code"), (10 + 5 * F.col("id")).alias("start"), F.posexplode(F.slice(F.expr(dates), 1, days)).alias("i", "date"))
    shock = F.when(F.rand(seed + 1) < 0.015, F.when(F.rand(seed + 2) < 0.5, 0.099).otherwise(-0.099)).otherwise(0.02 * F.randn(seed))
    w = Window.partitionBy("code").orderBy("date")
    d = d.withColumn("close", F.col("start") * F.exp(F.sum(F.log1p(shock)).over(w)))
    d = d.withColumn("pre_close", F.lag("close").over(w)).withColumn("vol", 1e5 * (1 + F.rand(seed + 3)))
    return d.select("code", "date", F.coalesce("pre_close", "close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", "pre_close", "vol", (F.col("vol") * F.col("close")).alias("amount"))

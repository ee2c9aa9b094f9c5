"""The bars panel: weekly volume-weighted prices of brands, made from lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.stats import by_code, lag, lead


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close, pre_close, vol, amount. Every 52nd bar goes ex a dividend of 5 %."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    bars = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    bars = bars.groupBy("code", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum("l_quantity").alias("vol"),
        F.sum("l_extendedprice").alias("amount"),
    )
    dividend = F.when(F.row_number().over(by_code()) % 52 == 0, F.lit(0.95)).otherwise(F.lit(1.0))
    return bars.withColumns({"open": F.coalesce(lag("close"), "close"), "pre_close": lag("close") * dividend})


def adjust(bars: DataFrame) -> DataFrame:
    """Adds adj (back-adjusted, anchored to the first close) and adj_front (anchored to the last)."""
    up = by_code().rowsBetween(Window.unboundedPreceding, 0)
    down = by_code().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = F.coalesce(F.col("close") / F.nullif(F.col("pre_close"), F.lit(0.0)), F.lit(1.0))
    r = F.coalesce(F.lead("pre_close").over(by_code()) / F.nullif(F.lead("close").over(by_code()), F.lit(0.0)), F.lit(1.0))
    bars = bars.withColumns({"f": f, "r": r})
    back = F.first("close").over(up) * F.product("f").over(up) / F.first("f").over(up)
    # Compounding r from a bar to the last one anchors the series to the last close.
    front = F.last("close").over(whole) * F.product("r").over(down)
    return bars.withColumns({"adj": back, "adj_front": front}).drop("f", "r")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted bars with ret, fwd (next return), industry and mv."""
    bars = adjust(raw_bars(spark, sf_dir))
    size = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.sum("p_retailprice").alias("mv"))
    bars = bars.withColumns({"ret": F.col("adj") / lag("adj") - 1, "fwd": lead("adj") / F.col("adj") - 1})
    return bars.join(size, "code").withColumn("industry", F.substring("code", 7, 9).cast("int") % 5)


#: The same in DuckDB's SQL, as common table expressions: raw, bars, p.
SQL = """
w0 AS (SELECT p_brand AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS vol, sum(l_extendedprice) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
raw AS (SELECT *, coalesce(lag(close) OVER w, close) AS open, lag(close) OVER w * CASE WHEN row_number() OVER w % 52 = 0 THEN 0.95 ELSE 1 END AS pre_close
  FROM w0 WINDOW w AS (PARTITION BY code ORDER BY date)),
w1 AS (SELECT *, coalesce(close / nullif(pre_close, 0), 1) AS f, coalesce(lead(pre_close) OVER (PARTITION BY code ORDER BY date) / nullif(lead(close) OVER (PARTITION BY code ORDER BY date), 0), 1) AS r FROM raw),
bars AS (SELECT *, first_value(close) OVER u * product(f) OVER u / first_value(f) OVER u AS adj,
  last_value(close) OVER a * product(r) OVER d AS adj_front FROM w1
  WINDOW u AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), d AS (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  a AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT bars.*, adj / lag(adj) OVER w - 1 AS ret, lead(adj) OVER w / adj - 1 AS fwd, mv, CAST(substr(code, 7) AS INT) % 5 AS industry
  FROM bars JOIN (SELECT p_brand AS code, sum(p_retailprice) AS mv FROM part GROUP BY 1) USING (code) WINDOW w AS (PARTITION BY code ORDER BY date))
"""

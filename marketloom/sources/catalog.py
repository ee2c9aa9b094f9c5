"""What tables there are, and parameterised SQL over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, n_rows, columns (in order, comma-separated), last (the greatest value of the first date or timestamp column; null if there is none).

    One scan a table, which reads no more than that column.
    """
    out = []
    for name in names:
        df = spark.table(name)
        dated = next((f.name for f in df.schema if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType)), None)
        last = F.max(F.to_date(dated)) if dated else F.lit(None).cast("date")
        out.append(df.agg(F.count("*").alias("n_rows"), last.alias("last")).select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(df.columns)).alias("columns"), "last"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "name string, n_rows long, columns string, last date")


def list_tables(spark: SparkSession) -> list[str]:
    """Tables and views of the current database, in order of name."""
    return sorted(t.name for t in spark.catalog.listTables())


def read_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, **params: object) -> DataFrame:
    """SQL with named parameters (:name), bound as literals and never spliced into the text; tables are used as {name}."""
    return spark.sql(sql, args=params or None, **(tables or {}))

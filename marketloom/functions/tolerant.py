"""Scalars that never fail: what can't be read is NULL, also in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.stats import col

#: The forms of time that are understood, the longest first.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM/dd")


def parse_time(x: Column | str) -> Column:
    """A timestamp of any of TIME_FORMATS, else of whatever Spark casts."""
    s = F.trim(col(x).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in TIME_FORMATS], s.try_cast("timestamp"))


def iso_date(x: Column | str) -> Column:
    """The date in the first ten characters."""
    return F.substring(col(x).cast("string"), 1, 10).try_cast("date")


def unit_number(text: Column | str) -> Column:
    """The first number in a text that lies within [-1, 1]."""
    found = F.regexp_extract_all(col(text), F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    numbers = F.transform(found, lambda x: x.try_cast("double"))
    return F.get(F.filter(numbers, lambda v: v.between(-1.0, 1.0)), F.lit(0))


def zfill(x: Column | str, width: int = 6) -> Column:
    """Zeros in front up to the width; longer texts stay whole, a sign stays in front."""
    s = col(x).cast("string")
    sign = F.when(s.rlike("^[+-]"), F.substring(s, 1, 1)).otherwise("")
    digits = F.when(s.rlike("^[+-]"), F.substring(s, 2, 1 << 30)).otherwise(s)
    return F.when(F.length(s) >= width, s).otherwise(F.concat(sign, F.lpad(digits, width - F.length(sign), F.lit("0"))))


def head(x: Column | str, separator: str = ".") -> Column:
    """What stands before the first separator; all of it if there is none."""
    return F.substring_index(col(x), separator, 1)


def finite(x: Column | str) -> Column:
    """NULL for NaN and the infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

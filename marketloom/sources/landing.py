"""A landing zone of vendor files as a Spark data source, for batches and for streams.

Vendors drop Parquet files with code, date, open, high, low, close, shares and amount into a folder. The source deals a task a
file, hands the conditions on code and date that Spark pushes down to the Parquet reader, turns shares into lots of 100 and
missing numbers into 0. As a stream it reads every file once, whatever dates it holds.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marketloom.functions.stats import lag

LOT = 100
SCHEMA = "code string, date date, open double, high double, low double, close double, vol double, amount double"
_NUMBERS = ("open", "high", "low", "close", "shares", "amount")
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a.isin(list(b))}


@dataclass
class File(InputPartition):
    path: str
    size: int
    time: int


def list_files(path: str) -> list[File]:
    """The data files under a folder, from the oldest."""
    where, root = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    data = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((File(f.path, f.size, f.mtime_ns or 0) for f in data), key=lambda f: (f.time, f.path))


def read_file(root: str, file: File, condition: ds.Expression | None) -> Iterator[pa.RecordBatch]:
    where, _ = fs.FileSystem.from_uri(root)
    source = ds.dataset(file.path, filesystem=where, format="parquet")
    kinds = {"code": pa.string(), "date": pa.date32()}
    for batch in source.to_batches(columns=["code", "date", *_NUMBERS], filter=condition):
        columns = {c: batch.column(c).cast(t) for c, t in kinds.items()} | {c: pc.fill_null(batch.column(c).cast(pa.float64()), 0.0) for c in _NUMBERS}
        columns["vol"] = pc.divide(columns.pop("shares"), float(LOT))
        if batch.num_rows:
            yield pa.record_batch({c: columns[c] for c in ("code", "date", "open", "high", "low", "close", "vol", "amount")})


class LandingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.condition = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of code and date over; the rest is left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("code", "date") and type(f) in _COMPARE:
                one = _COMPARE[type(f)](ds.field(name), f.value)
                self.condition = one if self.condition is None else self.condition & one
            else:
                yield f

    def partitions(self) -> list[File]:
        return list_files(self.path)

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition, self.condition)


class LandingStream(DataSourceStreamReader):
    """An offset holds the newest time of a file and the names of all files since `grace` before it. So files that appear out of
    order, or with an older time, are read as long as they are not older than that, and an offset does not grow for ever."""

    def __init__(self, path: str, grace: float):
        self.path, self.grace = path, int(grace * 1e9)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "names": []}

    def latestOffset(self) -> dict:  # noqa: N802
        files = list_files(self.path)
        newest = max((f.time for f in files), default=0)
        return {"time": newest, "names": sorted(f.path for f in files if f.time > newest - self.grace)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        fresh = set(end["names"]) - set(start["names"])
        return [f for f in list_files(self.path) if f.path in fresh]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition, None)


class LandingSource(DataSource):
    """Options: path (a folder that all executors see), grace (seconds; streams only)."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options["path"])

    def streamReader(self, schema) -> LandingStream:  # noqa: N802
        return LandingStream(self.options["path"], float(self.options.get("grace", 86400)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandingSource)


def fetch_bars(spark: SparkSession, path: str, codes: list[str] | None = None, start: datetime.date | None = None, end: datetime.date | None = None, pad_days: int = 15) -> DataFrame:
    """Bars of the codes from start to end with pre_close, the close before within the code; bars of `pad_days` before the
    start are read for it, so that the first bar has one, too."""
    register(spark)
    d = spark.read.format("landing").option("path", path).load()
    if codes is not None:
        d = d.where(F.col("code").isin(codes))
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start - datetime.timedelta(days=pad_days)))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end))
    d = d.withColumn("pre_close", F.coalesce(lag("close"), F.lit(0.0)))
    return d if start is None else d.where(F.col("date") >= F.lit(start))


def stream_bars(spark: SparkSession, path: str, grace: float = 86400) -> DataFrame:
    register(spark)
    return spark.readStream.format("landing").option("path", path).option("grace", str(grace)).load()

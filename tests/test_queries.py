"""Queries against their oracles in DuckDB on the smallest tables, and properties that SQL does not show."""

import datetime
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom import queries
from marketloom.functions.stats import ewm
from marketloom.operators import backtest, crosssec, factors, hotspot, market
from marketloom.plans.bars import adjust, panel
from marketloom.queries import ORACLES, QUERIES
from marketloom.sources import tables
from marketloom.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0):
        return v.date()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rel = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    want = sorted((tuple(map(plain, r)) for r in rel), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_oracle(spark, name):
    """Rows come, and missing is NULL, never NaN."""
    rows = QUERIES[name](spark, SF).collect()
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_adjustment(spark):
    d = datetime.date
    bars = spark.createDataFrame([("A", d(2024, 1, 1), 10.0, None), ("A", d(2024, 1, 2), 11.0, 9.0), ("A", d(2024, 1, 3), 12.0, 11.0)], "code string, date date, close double, pre_close double")
    out = adjust(bars).orderBy("date").collect()
    assert [round(r.adj, 4) for r in out] == [10, 12.2222, 13.3333]
    assert [round(r.adj_front, 4) for r in out] == [9, 11, 12]


def test_ewm_is_wilders(spark):
    rng = np.random.default_rng(0)
    x = rng.random(200)
    df = spark.createDataFrame(pd.DataFrame({"code": "A", "date": range(200), "x": x, "i": np.arange(1.0, 201)}))
    got = [r.y for r in df.select("date", ewm(F.col("x"), 1 / 14, F.col("i")).alias("y")).orderBy("date").collect()]
    assert np.allclose(got, pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean())


@pytest.mark.parametrize("n", [10, 14, 20])
def test_rsi_of_long_histories(spark, n):
    rng = np.random.default_rng(n)
    price = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 20_000))))
    df = spark.createDataFrame(pd.DataFrame({"code": "A", "date": range(20_000), "adj": price}))
    got = [r.v for r in factors.with_change(df).select("date", factors.rsi(n).alias("v")).orderBy("date").collect()]
    change = price.diff().iloc[1:]
    up, down = (x.clip(lower=0).ewm(alpha=1 / n, adjust=False).mean() for x in (change, -change))
    assert got[0] == 50 and np.allclose(got[1:], (100 - 100 / (1 + up / down.where(down != 0))).fillna(50), atol=1e-8)


def test_neutralize_is_least_squares(spark):
    rng = np.random.default_rng(1)
    n = 24
    ind, mv = np.arange(n) % 3, np.exp(rng.normal(20, 1, n))
    y = 2 * np.log(mv) + 1.5 * (ind == 0) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"date": 1, "code": [f"c{i:02}" for i in range(n)], "factor_name": "f", "value": y, "industry": ind, "mv": mv}))
    got = [r.value for r in crosssec.neutralize(df).orderBy("code").collect()]
    x = np.column_stack([np.log(mv), *[(ind == k).astype(float) for k in range(3)]])
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(got, (res - res.mean()) / res.std())


def test_neutralize_keeps_early_dates(spark, monkeypatch):
    from marketloom import queries

    p = panel(spark, SF).where("date < DATE '1995-09-01'")
    early = p.withColumn("date", F.date_sub("date", 7 * 260))
    monkeypatch.setattr(queries, "panel", lambda s, d: early)
    assert QUERIES["neutralize"](spark, SF).count() == factors.factor_long(p, queries._SOME).where("value IS NOT NULL").count() > 0


def test_no_look_ahead(spark):
    """Factors of a date do not change when later bars come."""
    p = panel(spark, SF)
    cut = p.where(F.col("date") < F.lit("1997-01-01").cast("date"))
    a = factors.factor_long(cut).where("value IS NOT NULL")
    b = factors.factor_long(p).where("value IS NOT NULL").withColumnRenamed("value", "later")
    j = a.join(b, ["date", "code", "factor_name"], "left").where("later IS NULL OR abs(value - later) > 1e-6 * (1 + abs(value))")
    assert j.count() == 0


def test_deflated_sharpe(spark):
    rng = np.random.default_rng(2)
    r = pd.Series(rng.normal(0.001, 0.01, 120))
    df = spark.createDataFrame(pd.DataFrame({"date": range(120), "net": r, "bench": 0.0}))
    sr = r.mean() / r.std() * math.sqrt(252)
    inside = 1 - r.skew() * sr + (r.kurt() - 1) / 4 * sr**2
    got = backtest.deflated_sharpe(df).first().deflated_sharpe
    if inside > 0:
        assert math.isclose(got, 0.5 * (1 + math.erf((math.sqrt(119) * sr / math.sqrt(inside) - 1.645) / math.sqrt(2))), abs_tol=1e-6)
    else:
        assert got is None


def test_as_of_is_strict(spark):
    probe = spark.createDataFrame([(0,), (1,), (5,)], "date int")
    data = spark.createDataFrame([(0, "x"), (3, "y")], "date int, v string")
    assert {r.date: r.v for r in market.as_of(probe, data, "v").collect()} == {0: None, 1: "x", 5: "y"}


def test_simhash_and_near_pairs(spark):
    import hashlib

    def reference(t):
        t = "".join(t.split())
        votes = [0] * 64
        for a, b in zip(t, t[1:]):
            h = int(hashlib.md5((a + b).encode()).hexdigest()[:16], 16)
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        v = sum(1 << i for i in range(64) if votes[i] > 0)
        return v - (1 << 64) if v >> 63 else v

    texts = ["hello brave new world", "hello brave new worlds", "x", "", "quite another text 漢字", "hello brave  new world"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("p", hotspot.simhash(F.col("t")))
    assert {r.k: r.p for r in df.collect()} == {k: reference(t) if len("".join(t.split())) > 1 else None for k, t in enumerate(texts)}
    near = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and len(x) > 1 and len(y) > 1 and bin((reference(x) ^ reference(y)) & (2**64 - 1)).count("1") <= 3}
    assert {(r.a, r.b) for r in hotspot.near_pairs(df, "k", "p").collect()} <= near | {(0, 5)} and (0, 5) in near


def test_dedup_near_is_greedy(spark):
    rng = np.random.default_rng(4)
    prints = [0, 0b111, 0b111111, 0b111111111, None, 0b111, -1, None]  # a chain: 1 goes by 0, 2 stays, 3 goes by 2
    for base in rng.integers(-(2**63), 2**63, 12).tolist():
        for _ in range(20):
            x = base & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            prints.append(x - (1 << 64) if x >> 63 else x)
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    kept = []
    for k, p in enumerate(prints):
        if p is None or not any(prints[j] is not None and near(p, prints[j]) for j in kept):
            kept.append(k)
    df = spark.createDataFrame(list(enumerate(prints)), "k long, p long")
    assert sorted(r.k for r in hotspot.dedup_near(df, "k", "p").collect()) == kept and 2 in kept and 3 not in kept
    pairs = {(r.a, r.b) for r in hotspot.near_pairs(df, "k", "p").collect()}
    firsts = {p: k for k, p in reversed(list(enumerate(prints)))}
    assert pairs >= {(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and None not in (x, y) and x != y and firsts[x] == a and firsts[y] == b and near(x, y)}
    assert set(QUERIES["dedup_near"](spark, SF).columns) == {"doc_id", "print"}


def test_sentiment_is_whole(spark):
    p = panel(spark, SF).select("code", "date", "ret").toPandas().sort_values(["code", "date"])
    want = p.set_index("date").groupby("code")["ret"].rolling(20).skew().fillna(0)
    z = QUERIES["sent_components_full"](spark, SF).toPandas()
    assert np.allclose(z.set_index(["code", "date"]).return_skew.sort_index(), want.sort_index(), atol=1e-5) and (z.return_skew != 0).any()
    w = factors.FULL_SENTIMENT_WEIGHTS
    day = z.groupby("date")
    score = sum(v * ((z[k] - day[k].transform("mean")) / day[k].transform(lambda x: x.std(ddof=0))).fillna(0) for k, v in w.items()).clip(-1, 1)
    got = QUERIES["sent_score_full"](spark, SF).toPandas().set_index(["code", "date"]).sentiment_score.sort_index()
    assert np.allclose(got, score.set_axis(pd.MultiIndex.from_frame(z[["code", "date"]])).sort_index(), atol=1e-3)
    x = QUERIES["sentiment_index_full"](spark, SF).toPandas()
    subs = x[[f"sub_{k}" for k in ("volume", "price", "money", "riskpremium")]].astype(float)
    share = subs.notna() * [0.25, 0.25, 0.2, 0.15]
    assert np.allclose(x.index_value, ((subs.fillna(0) * share).sum(axis=1) / share.sum(axis=1)).fillna(50), atol=1e-4) and subs.sub_money.notna().any() and subs.sub_riskpremium.notna().any()


def test_upsert_merge_keeps_updates_and_inserts(spark):
    old, new = ({r.o_orderkey: r.price for r in x.collect()} for x in queries._upsert_parts(spark, SF))
    got = {r.o_orderkey: r.price for r in QUERIES["upsert_merge"](spark, SF).collect()}
    assert old.keys() - new.keys() and old.keys() & new.keys() and new.keys() - old.keys()  # kept, updated, inserted
    assert got == old | new and len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_upsert_and_partitions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "k int, date string, v int")
    new = spark.createDataFrame([(2, "a", 3), (3, "b", 4)], "k int, date string, v int")
    assert {(r.k, r.v) for r in tables.upsert(old, new, ("k",)).collect()} == {(1, 1), (2, 3), (3, 4)}
    at = str(tmp_path / "t")
    tables.write_partitions(old.unionByName(new.where("k = 3")), at)
    tables.write_partitions(new.where("date = 'b'").withColumn("v", F.lit(9)), at)
    assert {(r.k, r.v) for r in spark.read.parquet(at).collect()} == {(1, 1), (2, 2), (3, 9)}


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    sink, at = events.upsert_to(f"file://{tmp_path}/s", ("k",)), f"file://{tmp_path}/s"
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, ts int, v string")
    two = spark.createDataFrame([(2, 5, "d")], "k int, ts int, v string")
    for n, b in ((0, one), (1, two), (1, two), (0, one)):
        sink(b, n)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{at}/v1").collect()} == {(1, "b"), (2, "d")}


def test_universe_days(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2024, 1, 1), d(2024, 1, 7)), (d(2024, 1, 6), d(2024, 1, 7)), (d(2024, 1, 9), d(2024, 1, 8))], "a date, b date")
    assert [r[0] for r in df.select(market.business_days(F.col("a"), F.col("b"))).collect()] == [5, 0, 0]

"""Operators against plain Python on small tables: strokes, predictors, resumed evaluation, the committee, streams, simulation, feeds and signals."""

import datetime
import math
import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import tolerant
from marketloom.operators import backtest, committee, crosssec, evaluation, hotspot, predictors, signals, strokes
from marketloom.sources import feeds, landing, tables
from marketloom.streaming import near

DAY = datetime.date(2024, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def walks():
    """Bars of three codes as (date, code, high, low, close, vol, adj); the second one has a gap in its prices."""
    rng = random.Random(3)
    out = []
    for c in ("A", "B", "C"):
        p = 10.0
        for i in range(140 if c != "C" else 33):
            p *= math.exp(rng.gauss(0, 0.03))
            hole = c == "B" and i in (50, 51)
            out.append((day(i), c, *((None,) * 3 if hole else (p * (1 + rng.random() * 0.03), p * (1 - rng.random() * 0.03), p)), 100.0 + i, None if hole else p * 1.1))
    return out


SCHEMA = "date date, code string, high double, low double, close double, vol double, adj double"


def strokes_of_prefix(bars):
    """Score of the last bar from the whole prefix: merge all, find all turns, then alternate them."""
    merged = []  # [high, low, raw bar that opened it]
    for i, (h, l, _) in enumerate(bars):
        if merged:
            a, b, _ = merged[-1]
            if (h <= a and l >= b) or (h >= a and l <= b):
                down = len(merged) > 1 and a < merged[-2][0]
                merged[-1][:2] = [min(a, h), min(b, l)] if down else [max(a, h), max(b, l)]
                continue
        merged.append([h, l, i])
    ends = []
    for k in range(1, len(merged) - 1):
        (h1, l1, _), (h2, l2, _), (h3, l3, opened) = merged[k - 1 : k + 2]
        kind = 1 if h2 > h1 and h2 > h3 else -1 if l2 < l1 and l2 < l3 else 0
        price = h2 if kind > 0 else l2
        if not kind:
            continue
        if not ends:
            ends.append((kind, price, k, opened))
        elif ends[-1][0] == kind:
            if (price - ends[-1][1]) * kind > 0:
                ends[-1] = (kind, price, k, opened)
        elif k - ends[-1][2] >= 4 and (price - ends[-1][1]) * kind > 0:
            ends.append((kind, price, k, opened))
    if len(ends) < 2:
        return 0.0
    powers = [abs(b[1] - a[1]) for a, b in zip(ends, ends[1:], strict=False)]
    usual, way = sum(powers[-6:]) / len(powers[-6:]), -ends[-1][0]
    since = bars[ends[-1][3] :]
    low, high = min(ends[-1][1], *[b[1] for b in since]), max(ends[-1][1], *[b[0] for b in since])
    place = (bars[-1][2] - low) / (high - low)
    faster = (min(max(usual / powers[-1], 0.4), 1.6) - 1) / 0.6
    return min(max(way * (0.45 + 0.30 * (place if way > 0 else 1 - place) + 0.10 * faster), -1), 1)


def test_strokes(spark, walks):
    rows = strokes.stroke_scores(spark.createDataFrame(walks, SCHEMA)).collect()
    got = {(r.code, r.date): r for r in rows}
    assert len(got) == len(walks) and any(r.strokes > 3 for r in rows)
    for code in "ABC":
        bars = []
        for d, c, h, l, p, _, adj in walks:
            if c != code:
                continue
            if p is None:
                assert got[c, d].tech_score is None
                continue
            bars.append((h * adj / p, l * adj / p, adj))
            if len(bars) >= strokes.LEAST_BARS:
                assert got[c, d].tech_score == pytest.approx(strokes_of_prefix(bars), abs=1e-9)
            else:
                assert -1 <= got[c, d].tech_score <= 1


def test_strokes_do_not_look_ahead(spark, walks):
    whole = {(r.code, r.date): r for r in strokes.stroke_scores(spark.createDataFrame(walks, SCHEMA)).collect()}
    for last in (40, 77):
        for r in strokes.stroke_scores(spark.createDataFrame([w for w in walks if w[0] <= day(last)], SCHEMA)).collect():
            assert r == whole[r.code, r.date]


def test_least_squares_sees_the_past_only(spark, walks):
    bars = spark.createDataFrame([(w[1], w[0], w[6]) for w in walks if w[6]], "code string, date date, adj double")
    targets = spark.createDataFrame([("A", day(100), 5), ("A", day(100), 5), ("A", day(20), 1), ("Z", day(9), 1), ("C", day(32), 1)], "code string, date date, horizon int")
    got = predictors.predict_targets(bars, targets, predictors.LeastSquares).collect()
    p = np.array([w[6] for w in walks if w[1] == "A"])[:101]
    x = p[5:] / p[:-5] - 1
    y = p[10:] / p[5:-5] - 1  # the outcomes that are known on that day
    slope, at = np.polyfit(x[: len(y)], y, 1)
    assert sorted((r.code, r.date) for r in got) == [("A", day(100))] * 2 + [("C", day(32))]
    assert [r.ret_pred for r in got if r.code == "A"] == pytest.approx([at + slope * x[-1]] * 2)
    later = bars.where((F.col("code") != "A") | (F.col("date") <= F.lit(day(100)))).unionByName(spark.createDataFrame([("A", day(150), 9e9)], "code string, date date, adj double"))
    again = predictors.predict_targets(later, targets.where("code = 'A' AND horizon = 5"), predictors.LeastSquares).collect()
    assert [r.ret_pred for r in again] == pytest.approx([at + slope * x[-1]] * 2)
    assert predictors.predict_targets(bars, targets.limit(0), predictors.Momentum).count() == 0


def test_evaluation_resumes(spark, walks, tmp_path):
    bars = spark.createDataFrame([(w[1], w[0], w[6]) for w in walks if w[6]], "code string, date date, adj double")
    labels = crosssec.labels(bars, (1, 5))
    whole = evaluation.EvaluationStore(spark, f"file://{tmp_path}/whole")
    evaluation.evaluate_resumably(whole, "m", bars, labels, predictors.LeastSquares, (1, 5), last=4)
    broken = evaluation.EvaluationStore(spark, f"file://{tmp_path}/broken")
    evaluation.evaluate_resumably(broken, "m", bars, labels, predictors.LeastSquares, (1, 5), last=4, stop_after=1)
    done = {(r.code, r.horizon) for r in broken.finished().collect()}
    assert 0 < len(done) < 6
    # What a killed run leaves: pairs without a commit.
    broken.pairs().limit(1).write.parquet(f"file://{tmp_path}/broken/pairs/m-1")
    marks = tmp_path / "marks"
    marks.mkdir()

    at = str(marks)

    class Marked(predictors.LeastSquares):
        """Leaves a mark for each fit, to see what is done again."""

        def fit(self, bars, horizon):
            with open(f"{at}/{os.getpid()}", "a") as f:
                f.write(f"{bars['code'].iloc[0]} {horizon}\n")
            super().fit(bars, horizon)

    evaluation.evaluate_resumably(broken, "m", bars, labels, Marked, (1, 5), last=4)
    rows = lambda s: sorted(map(tuple, s.pairs().collect()))
    assert rows(broken) == rows(whole) and rows(whole)
    fitted = {tuple(x.split()) for f in marks.iterdir() for x in f.read_text().splitlines()}
    assert fitted and not {(c, int(h)) for c, h in fitted} & done
    assert sorted(map(tuple, broken.finished().collect())) == sorted(("m", c, h) for c in "ABC" for h in (1, 5))
    before = rows(broken)
    evaluation.evaluate_resumably(broken, "m", bars, labels, Marked, (1, 5), last=4)
    assert rows(broken) == before
    gate = evaluation.model_gate(broken.pairs()).collect()
    assert len(gate) == 1 and 0 <= gate[0].dir_acc <= 1


def test_gate_falls_back_to_accuracy(spark):
    pairs = spark.createDataFrame([("m", "A", 1, day(i), 1, 1 if i % 4 else -1, 0.1, 0.1) for i in range(20)], evaluation.PAIRS)
    r = evaluation.model_gate(pairs).first()
    assert r.ic is None and not r.dropped and r.weight == pytest.approx(0.25 * 2 * (0.75 - 0.5))
    flat = spark.createDataFrame([("m", c, 1, day(i), 1, 1, x, y) for i in range(9) for c, x, y in (("A", 1.0, 1.0), ("B", 2.0, 3.0), ("C", 3.0, 3.0), ("D", 2.5, 1.0))], evaluation.PAIRS)
    r = evaluation.model_gate(flat).first()
    assert r.weight == (0 if abs(r.ic) < 0.02 else pytest.approx(0.25 * min(max((r.ic - 0.02) / 0.03, 0), 1)))


def test_committee_does_not_see_the_tail(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(70):
        for c in "ABCDEF":
            x = rng.gauss(0, 1)
            rows.append((day(i), c, x, None if rng.random() < 0.05 else rng.random(), 0.1))
            labels.append((day(i), c, 1, 0.02 * x + rng.gauss(0, 0.01)))
    features = spark.createDataFrame(rows, "date date, code string, a double, b double, band double")
    known = spark.createDataFrame(labels, "date date, code string, horizon int, label double")
    wild = known.withColumn("label", F.when(F.col("date") > F.lit(day(49)), -9.0).otherwise(F.col("label")))
    one, two = (committee.fit_committee(features, x, ["a", "b"], f"file://{tmp_path}/{n}", (1, 5), folds=2) for n, x in (("one", known), ("two", wild)))
    assert [c.horizon for c in one] == [1] and one[0].dir_acc > 0.8 and set(one[0].scores) == set(committee.CANDIDATES)
    assert one[0].model == max(one[0].scores, key=lambda n: (sum(one[0].scores[n]) / 2, n))
    assert one[0].scores == two[0].scores
    p, q = ({(r.date, r.code): r.ret_pred for r in committee.committee_predictions(features, ["a", "b"], c).collect()} for c in (one, two))
    assert p == q and {d for d, _ in p} == {day(i) for i in range(50, 70)} and len(p) == 120


def test_stream_near_is_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    rows = [(i, None if rng.random() < 0.2 else rng.choice(prints) ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62))) for i in range(160)]
    for i in range(2):
        spark.createDataFrame(rows[80 * i : 80 * i + 80], "k long, p long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("k long, p long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(r.k for r in near.run_near(items, "k", "p", f"file://{tmp_path}/near", groups=2).collect())
    kept = []
    for k, p in rows:
        if p is None or all(bin((p ^ q) & (2**64 - 1)).count("1") > 3 for _, q in kept if q is not None):
            kept.append((k, p))
    assert got == [k for k, _ in kept] and len(got) < 150
    assert sorted(r.k for r in hotspot.dedup_near(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()) == got


def test_stream_near_of_large_groups(spark, tmp_path):
    rng = np.random.default_rng(7)
    prints = rng.integers(-(2**63), 2**63, 40_000)
    prints[5_000:6_000] = prints[0]
    prints[30_000:] = prints[:10_000] ^ (1 << rng.integers(0, 62, 10_000))  # each near an item of an earlier batch
    rows = pd.DataFrame({"k": np.arange(len(prints)), "p": prints})
    for i in range(2):
        spark.createDataFrame(rows[20_000 * i : 20_000 * i + 20_000]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("k long, p long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    began = time.monotonic()
    got = sorted(r.k for r in near.run_near(items, "k", "p", f"file://{tmp_path}/near", groups=4).collect())
    assert got == [*range(5_000), *range(6_000, 30_000)] and time.monotonic() - began < 90

    known = np.array([[1, 2], [0b1, 0b11110]])
    found, fresh = near.earlier_near(known, np.array([3, 4, 5, 6]), np.array([0b11110, 0b1, 0b1 << 20, 0b11 << 20]), 3, cells=3)
    assert [sorted(x) for x in found] == [[2], [1], [1], [1, 5]] and fresh.tolist() == [[5, 6], [1 << 20, 0b11 << 20]]
    assert near.earlier_near(np.empty((2, 0), int), np.array([], int), np.array([], int), 3)[1].shape == (2, 0)


def test_simulation_of_gaps_and_limits(spark):
    closes = {"A": [10, 10, 11.5, 11, 11], "B": [20, 17, 17, 17, 17], "C": [5, 5, 5, 5, 5]}
    panel = spark.createDataFrame([(day(i), c, float(p), 0.01) for c, ps in closes.items() for i, p in enumerate(ps)], "date date, code string, close double, fwd double")
    book = [(0, "A", 0.5), (0, "B", 0.5), (1, "A", 2.0), (1, "B", -2.0), (2, "A", 1.0), (4, "A", 1.0), (4, "C", 3.0)]
    weights = spark.createDataFrame([(day(i), c, float(w)) for i, c, w in book], "date date, code string, weight double")
    held = backtest.full(backtest.tradable(weights, panel))
    # On day 1 B is at its lower limit and can't be sold short; on day 2 A is at its upper one: nothing is left.
    assert {(r.date, r.code): r.weight for r in held.collect()} == {(day(0), "A"): 0.5, (day(0), "B"): 0.5, (day(1), "A"): 1.0, (day(4), "A"): 0.25, (day(4), "C"): 0.75}
    got = {r.date: (r.gross, r.turnover, r.net) for r in backtest.simulate(held, panel, 0.1, calendar=weights).collect()}
    want = {day(0): (0.01, 1.0, -0.09), day(1): (0.01, 0.5, -0.04), day(2): (0.0, 0.0, 0.0), day(4): (0.01, 1.0, -0.09)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_feeds(spark):
    a = spark.createDataFrame([(day(0), 1.0, 1), (day(0), 2.0, 3), (day(0), 9.0, 2), (day(2), None, 1), (None, 4.0, 1)], "date date, value double, seq int")
    b = spark.createDataFrame([(day(1), 5.0, 1)], "date date, value double, seq int")
    none = a.limit(0)
    got = sorted(map(tuple, feeds.join_feeds({"a": a, "b": b, "c": none}).collect()))
    assert got == [(day(0), 2.0, 0.0, 0.0), (day(1), 0.0, 5.0, 0.0), (day(2), 0.0, 0.0, 0.0)]
    assert {r.a for r in feeds.join_feeds({"a": a, "b": b}, missing=None).collect()} == {2.0, None}
    assert sorted(map(tuple, feeds.keep_last(a, "seq").collect())) == [(day(0), 2.0, 3), (day(2), None, 1)]


def test_signals(spark):
    texts = [None, "", "[]", '"text"', "{}", '{"related_codes": ["a", "", "b", "a"], "impact_score": -3}', '{"related_codes": " b ,a", "sentiment_score": "NaN", "impact": "high"}', '{"related_codes": 5, "sentiment_score": 1e9, "sentiment": "positive"}']
    items = spark.createDataFrame([(i, t, ["z", "a"] if i % 2 else None) for i, t in enumerate(texts)], "id int, raw string, own array<string>")
    pool = spark.createDataFrame([("a",), ("b",), ("a",)], "code string")
    got = {r.id: r for r in signals.allowed_codes(signals.parse_signals(items), pool, "id", "own").collect()}
    assert [got[i].readable for i in range(8)] == [False, False, False, False, True, True, True, True]
    assert [got[i].codes for i in range(8)] == [[], ["z", "a"], [], ["z", "a"], [], ["a", "b", "a", "z"], ["b", "a"], ["z", "a"]]
    assert (got[5].impact_score, got[6].sentiment_score, got[6].impact, got[7].sentiment_score, got[7].sentiment, got[0].sentiment) == (0.0, 0.0, "high", 1.0, "positive", "neutral")


def test_tolerant_scalars(spark):
    d = spark.createDataFrame([("2024-02-30", "x 7 then -0.25 or 0.5", "7", 1.0), ("2024/3/1", None, "-7", float("inf")), (" 2024-03-01 10:05 ", "12", "1234567", float("nan")), (None, "1.0", None, None)], "t string, s string, c string, v double")
    rows = d.select(tolerant.parse_time("t").cast("string").alias("t"), tolerant.unit_number("s").alias("s"), tolerant.zfill("c").alias("c"), tolerant.finite("v").alias("v"), tolerant.iso_date("t").cast("string").alias("d"), tolerant.head(F.lit("600000.SH")).alias("h")).collect()
    assert [r.s for r in rows] == [-0.25, None, None, 1.0] and [r.c for r in rows] == ["000007", "-00007", "1234567", None] and [r.v for r in rows] == [1.0, None, None, None]
    assert rows[0].t is None and rows[2].t == "2024-03-01 10:05:00" and rows[3].t is None and rows[0].d is None and rows[0].h == "600000"


def test_landing_zone(spark, tmp_path):
    at = tmp_path / "zone"

    def drop(name, rows, time):
        at.mkdir(exist_ok=True)
        pd.DataFrame(rows, columns=["code", "date", "open", "high", "low", "close", "shares", "amount"]).to_parquet(at / name)
        os.utime(at / name, (time, time))

    bar = lambda c, i, p: (c, day(i), p, p, p, p, 1000.0 * p, None)
    drop("b.parquet", [bar("A", 20, 2.0), bar("A", 40, 4.0)], 2_000_000)
    drop("a.parquet", [bar("A", 30, 3.0), bar("B", 30, 7.0)], 1_000_000)
    got = sorted((r.code, r.date, r.vol, r.amount, r.pre_close) for r in landing.fetch_bars(spark, f"file://{at}", codes=["A"], start=day(30)).collect())
    assert got == [("A", day(30), 30.0, 0.0, 2.0), ("A", day(40), 40.0, 0.0, 3.0)]
    reader = landing.LandingReader(f"file://{at}")
    left = list(reader.pushFilters([landing.EqualTo(("code",), "B"), landing.GreaterThan(("vol",), 1.0)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    stream = landing.LandingStream(f"file://{at}", grace=1_500_000)
    start, end = stream.initialOffset(), stream.latestOffset()
    assert [p.path[-9:] for p in stream.partitions(start, end)] == ["a.parquet", "b.parquet"]
    drop("late.parquet", [bar("C", 1, 1.0)], 1_500_000)  # older than what was read
    assert [p.path[-12:] for p in stream.partitions(end, stream.latestOffset())] == ["late.parquet"]
    assert stream.partitions(stream.latestOffset(), stream.latestOffset()) == []


def test_resume(spark):
    bars = spark.createDataFrame([("A", day(1)), ("A", day(5)), ("B", day(4))], "code string, date date")
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "code string")
    end = spark.createDataFrame([(day(5),)], "end date")
    assert sorted(r.code for r in tables.to_resume(codes, bars, end).collect()) == ["B", "C"]


def test_columns_of_vendors_and_synthetic_bars(spark):
    d = spark.createDataFrame([("x", 1.0, 2.0)], "`Stock Code` string, `close_price` double, `Close 2` double")
    got = tables.normalize_columns(d, {"code": ("code",), "close": ("close",)})
    assert got.columns == ["code", "close"] and tuple(got.first()) == ("x", 1.0)
    b = tables.synthetic_bars(spark, 3, 40, seed=1).collect()
    assert len(b) == 120 and {r.date.weekday() for r in b} <= {0, 1, 2, 3, 4} and len({r.code for r in b}) == 3

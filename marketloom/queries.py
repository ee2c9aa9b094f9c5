"""Registered queries over the driver's tables, and their oracles in DuckDB's SQL.

Floats are rounded to six digits on both sides, for sums run in another order there.
"""

from __future__ import annotations

import datetime
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions import tolerant
from marketloom.functions.stats import by_code, group_transform, roll, xs_rank, xs_zscore
from marketloom.operators import backtest, committee, crosssec, evaluation, factors, hotspot, market, models, predictors, signals, strokes
from marketloom.plans.bars import SQL as BARS
from marketloom.plans.bars import adjust, panel, raw_bars, table
from marketloom.sources import catalog, feeds, landing, logs, tables
from marketloom.streaming import events, near

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _ln() -> Column:
    """Logarithms of prices, which have no ties in rounding."""
    return F.ln("close").alias("ln_close")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars_sql(tail: str) -> str:
    return f"WITH {BARS}{tail}"


# Scans, loads and writes


@query(bars_sql("SELECT code, date, round(ln(close), 6) AS ln_close, round(ln(high), 6) AS ln_high, round(ln(low), 6) AS ln_low, round(vol, 6) AS vol, round(ln(open), 6) AS ln_open, round(ln(pre_close), 6) AS ln_pre_close FROM raw"))
def scan_bars(s, d):
    return r6(raw_bars(s, d).select("code", "date", "vol", *[F.ln(c).alias(f"ln_{c}") for c in ("close", "high", "low", "open", "pre_close")]))


@query(bars_sql("SELECT code, date, round(ln(close), 6) AS ln_close FROM raw WHERE code IN ('Brand#11', 'Brand#12', 'Brand#5') AND date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'"))
def load_bars(s, d):
    return r6(tables.load(raw_bars(s, d), ["Brand#11", "Brand#12", "Brand#5"], "1994-01-01", "1995-12-31").select("code", "date", _ln()))


@query(bars_sql("SELECT code, date, round(ln(close), 6) AS ln_close FROM raw WHERE date = (SELECT max(date) FROM raw)"))
def latest_snapshot(s, d):
    return r6(tables.latest(raw_bars(s, d)).select("code", "date", _ln()))


@query(bars_sql("SELECT code, date, round(ln(close), 6) AS ln_close FROM raw JOIN (SELECT code, max(date) AS date FROM raw GROUP BY code) USING (code, date)"))
def latest_per_code(s, d):
    return r6(tables.latest(raw_bars(s, d), ("code",)).select("code", "date", _ln()))


FL = f", {factors.SQL_CHANGE}"
PIVOT = ["f_momentum_5", "f_volume_ratio_20", "f_turnover_trend"]


@query(f"WITH {BARS}{FL} SELECT date, code, " + ", ".join(f"round({factors.FACTORS[n].sql}, 6) AS {n}" for n in PIVOT) + " FROM c")
def factor_pivot(s, d):
    long = factors.factor_long(panel(s, d), PIVOT)
    return r6(long.groupBy("date", "code").pivot("factor_name", PIVOT).agg(F.avg("value")))


def _upsert_parts(s, d):
    """Two sides of an upsert of orders: a third of them comes with new prices; of it, those of even keys are there already, others not."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    comes = F.col("o_orderkey") % 3 == 0
    there = ~F.coalesce(comes & (F.col("o_orderkey") % 2 != 0), F.lit(False))
    return o.where(there), o.where(comes).withColumn("price", F.round(F.col("price") * 2, 2))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price FROM orders")
def upsert_merge(s, d):
    return tables.upsert(*_upsert_parts(s, d), ("o_orderkey",))


_TWO = "a AS (SELECT code, date, close, 'first' AS source FROM raw WHERE day(date) % 7 <> 0), b AS (SELECT code, date, close * CASE WHEN day(date) % 5 = 0 THEN 1.1 ELSE 1.001 END AS close, 'second' AS source FROM raw)"


def _two(s, d):
    bars = raw_bars(s, d).select("code", "date", "close")
    a = bars.where(F.dayofmonth("date") % 7 != 0).withColumn("source", F.lit("first"))
    b = bars.withColumn("close", F.col("close") * F.when(F.dayofmonth("date") % 5 == 0, 1.1).otherwise(1.001)).withColumn("source", F.lit("second"))
    return a, b


@query(f"WITH {BARS}, {_TWO} SELECT code, date, round(ln(coalesce(a.close, b.close)), 6) AS ln_close, coalesce(a.source, b.source) AS source FROM a FULL JOIN b USING (code, date)")
def source_priority(s, d):
    a, b = _two(s, d)
    return r6(tables.first_source(a.unionByName(b), F.when(F.col("source") == "first", 0).otherwise(1)).select("code", "date", _ln(), "source"))


@query(f"WITH {BARS}, {_TWO} SELECT code, date, round(abs(a.close - b.close) / a.close, 6) AS diff FROM a JOIN b USING (code, date) WHERE round(abs(a.close - b.close) / a.close, 9) > 0.03")
def source_divergence(s, d):
    return r6(tables.divergence(*_two(s, d)).select("code", "date", "diff"))


@query("SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING CAST(max(o_orderdate) AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 30 FROM orders))")
def ingest_resume(s, d):
    bars = table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date"))
    end = bars.agg(F.date_sub(F.max("date"), 30).alias("end"))
    codes = table(s, d, "customer").select(F.col("c_custkey").alias("code"))
    return tables.to_resume(codes, bars, end)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def browse_page(s, d):
    o = table(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    total = o.agg(F.count("*").alias("total"))
    one = tables.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 20).select("o_orderkey", "o_orderstatus", "o_totalprice")
    return one.join(total, F.lit(True))  # one row


# Prices, universe and quality


@query(bars_sql("SELECT code, date, round(ln(adj / close), 6) AS ln_adj FROM bars"))
def adj_back(s, d):
    return r6(adjust(raw_bars(s, d)).select("code", "date", F.ln(F.col("adj") / F.col("close")).alias("ln_adj")))


@query(bars_sql("SELECT code, date, round(ln(adj_front / close), 6) AS ln_adj FROM bars"))
def adj_front(s, d):
    return r6(adjust(raw_bars(s, d)).select("code", "date", F.ln(F.col("adj_front") / F.col("close")).alias("ln_adj")))


@query(bars_sql("SELECT code, date, round(ret, 6) AS adj_ret FROM p WHERE round(abs(ret - (close / (SELECT r.close FROM raw r WHERE r.code = p.code AND r.date < p.date ORDER BY r.date DESC LIMIT 1) - 1)), 9) > 0.02"))
def adjust_jump_warn(s, d):
    raw = F.col("close") / F.lag("close").over(by_code()) - 1
    p = panel(s, d).withColumn("raw", raw).where(F.round(F.abs(F.col("ret") - F.col("raw")), 9) > 0.02)
    return r6(p.select("code", "date", F.col("ret").alias("adj_ret")))


_STOCKS = """st AS (SELECT p_brand AS code, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 6 = 0 THEN '*ST ' || p_brand ELSE 'Co ' || substr(p_brand, 7) END AS name,
  CAST(CASE WHEN CAST(substr(p_brand, 7) AS INT) % 7 = 0 THEN DATE '1998-11-02' ELSE DATE '1992-01-06' END AS DATE) AS listed_date, CAST(substr(p_brand, 7) AS INT) % 11 = 0 AS delisted FROM part GROUP BY 1)"""


def _stocks(s, d):
    n = F.substring("code", 7, 9).cast("int")
    st = table(s, d, "part").select(F.col("p_brand").alias("code")).distinct()
    return st.select("code", F.when(n % 6 == 0, F.concat(F.lit("*ST "), "code")).otherwise(F.concat(F.lit("Co "), F.substring("code", 7, 9))).alias("name"), F.when(n % 7 == 0, F.lit("1998-11-02")).otherwise(F.lit("1992-01-06")).cast("date").alias("listed_date"), (n % 11 == 0).alias("delisted"))


@query(f"""WITH {BARS}, {_STOCKS}, u AS (SELECT code, name, delisted, contains(upper(name), 'ST') AS is_st,
  CAST(len(list_filter(range(CAST(0 AS BIGINT), CAST(DATE '1998-12-01' - listed_date AS BIGINT) + 1), lambda i: isodow(listed_date + CAST(i AS INTEGER)) < 6)) - 1 AS INTEGER) AS listed_days,
  (SELECT max(date) FROM raw WHERE raw.code = st.code) AS last FROM st)
  SELECT DATE '1998-12-01' AS date, code, name, is_st, listed_days, delisted, NOT is_st AND listed_days >= 60 AND last IS NOT NULL AND DATE '1998-12-01' - last <= 30 AND NOT delisted AS in_universe FROM u""")
def universe_filter(s, d):
    return market.universe(_stocks(s, d), raw_bars(s, d), F.lit("1998-12-01").cast("date"))


@query(bars_sql(f", {_STOCKS} SELECT code, date, round(ln(close), 6) AS ln_close FROM raw WHERE code IN (SELECT code FROM st WHERE NOT delisted AND name NOT LIKE '*ST%')"))
def universe_semi(s, d):
    keep = _stocks(s, d).where("NOT delisted AND name NOT LIKE '*ST%'").select("code")
    return r6(raw_bars(s, d).join(keep, "code", "left_semi").select("code", "date", _ln()))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0")
def dq_bad_price(s, d):
    return table(s, d, "customer").where("c_acctbal <= 0").select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-01-01'")
def dq_future(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.where(F.col("date") > F.lit("1998-01-01").cast("date"))


@query(bars_sql(", j AS (SELECT code, date, round(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 6) AS jump FROM raw) SELECT * FROM j WHERE abs(jump) > 0.3"))
def dq_jump(s, d):
    return market.price_jumps(raw_bars(s, d))


@query("SELECT p_partkey, p_name FROM part WHERE upper(p_name) LIKE '%1%' OR p_brand LIKE '%#1%' GROUP BY ALL ORDER BY p_partkey LIMIT 20")
def stock_search(s, d):
    p = table(s, d, "part").where(F.upper("p_name").like("%1%") | F.col("p_brand").like("%#1%"))
    return p.select("p_partkey", "p_name").distinct().orderBy("p_partkey").limit(20)


@query("SELECT c_custkey, c_name, n_name, round(c_acctbal, 2) AS balance, round(coalesce((last - c_acctbal) / nullif(c_acctbal, 0) * 100, 0), 2) AS pnl FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def watch_pnl(s, d):
    last = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("last"))
    c = table(s, d, "customer").join(last, "c_custkey", "left").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    pnl = (F.col("last") - F.col("c_acctbal")) / F.nullif(F.col("c_acctbal"), F.lit(0.0)) * 100
    return c.select("c_custkey", "c_name", "n_name", F.round("c_acctbal", 2).alias("balance"), F.round(F.coalesce(pnl, F.lit(0.0)), 2).alias("pnl"))


# Aggregations


@query(bars_sql("SELECT count(*) AS n, count(DISTINCT code) AS codes, max(date) AS last FROM raw"))
def data_freshness(s, d):
    return raw_bars(s, d).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"), F.max("date").alias("last"))


@query(f"""WITH {BARS}, dd AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM p)),
  g AS (SELECT p.date, p.industry, avg(p.ret) AS change_pct, sum(coalesce(p.amount - b.amount, 0)) AS net_inflow FROM p JOIN dd USING (date) LEFT JOIN p b ON b.code = p.code AND b.date = dd.prev GROUP BY 1, 2),
  m AS (SELECT date, avg(ret) AS market FROM p GROUP BY 1), o AS (SELECT date, industry, change_pct, net_inflow, round(change_pct - market, 9) AS rs FROM g JOIN m USING (date))
  SELECT date, industry, round(change_pct, 6) AS change_pct, round(rs, 6) AS rs, round(net_inflow, 2) AS net_inflow, CASE WHEN rs > 0.005 THEN 'attack' WHEN rs < -0.005 THEN 'defend' ELSE 'switch' END AS rotation_signal FROM o""")
def sector_rotation(s, d):
    return r6(market.sector_rotation(panel(s, d)).withColumn("net_inflow", F.round("net_inflow", 2)))


@query(f"WITH {BARS} SELECT industry, date, round(sum(amount), 2) AS amount, count(*) AS n FROM p GROUP BY CUBE (industry, date)")
def sector_cube(s, d):
    return panel(s, d).cube("industry", "date").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))


@query(bars_sql("SELECT date, round(sum(CASE WHEN coalesce(ret > 0, false) THEN vol ELSE 0 END) / sum(vol), 6) AS volume_dim FROM p GROUP BY 1"))
def ms_volume(s, d):
    return r6(market.breadth(panel(s, d)).select("date", "volume_dim"))


@query(bars_sql("SELECT date, round(avg(CASE WHEN coalesce(ret > 0, false) THEN 1.0 ELSE 0.0 END), 6) AS price_dim FROM p GROUP BY 1"))
def ms_price(s, d):
    return r6(market.breadth(panel(s, d)).select("date", "price_dim"))


_BREADTH = "v AS (SELECT date, sum(CASE WHEN coalesce(ret > 0, false) THEN vol ELSE 0 END) / sum(vol) AS volume_dim, avg(CASE WHEN coalesce(ret > 0, false) THEN 1.0 ELSE 0.0 END) AS price_dim FROM p GROUP BY 1)"


def _pct(x: str, source: str = "v") -> str:
    return f"(SELECT date, CASE WHEN n < greatest(20, n // 4) OR round(sd, 12) = 0 THEN 50 ELSE len(list_filter(xs, lambda y: y <= x)) / n * 100 END AS pct FROM (SELECT date, {x} AS x, list({x}) OVER w AS xs, count(*) OVER w AS n, stddev_pop({x}) OVER w AS sd FROM {source} WHERE {x} IS NOT NULL WINDOW w AS (ORDER BY date ROWS 749 PRECEDING)))"


@query(f"WITH {BARS}, {_BREADTH} SELECT date, round(pct, 4) AS pct FROM {_pct('price_dim')}")
def ms_percentile(s, d):
    p = market.rolling_percentile(market.breadth(panel(s, d)), "price_dim")
    return p.select("date", F.round("pct", 4).alias("pct"))


@query(f"WITH {BARS}, e AS (SELECT date, avg(adj) AS level FROM p GROUP BY 1), t AS (SELECT date, level, CASE WHEN count(*) OVER w = 20 THEN max(level) OVER w END AS top FROM e WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)) SELECT date, round((level - top) / top, 6) AS drawdown FROM t")
def index_drawdown(s, d):
    return r6(market.index_drawdown(panel(s, d)))


_INDEX = f"""{_BREADTH}, e AS (SELECT date, avg(adj) AS level FROM p GROUP BY 1), t AS (SELECT date, level, CASE WHEN count(*) OVER w = 20 THEN max(level) OVER w END AS top FROM e WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
  i AS (SELECT date, a.pct AS sub_volume, b.pct AS sub_price, (level - top) / top AS drawdown, round((0.25 * a.pct + 0.25 * b.pct) / 0.5, 6) AS index_value FROM {_pct('volume_dim')} a JOIN {_pct('price_dim')} b USING (date) JOIN t USING (date)),
  si AS (SELECT *, CASE WHEN index_value <= 30 THEN 'fear' WHEN index_value >= 70 THEN 'greed' ELSE 'neutral' END AS thermometer, CASE WHEN index_value <= 10 THEN 'buy' WHEN index_value >= 90 THEN 'out' ELSE 'half' END AS signal FROM i),
  sx AS (SELECT *, CASE WHEN round(drawdown, 9) <= -0.15 THEN 'panic' WHEN round(drawdown, 9) <= -0.08 THEN 'bear' WHEN thermometer = 'greed' AND round(drawdown, 9) > -0.05 THEN 'bull' ELSE 'neutral' END AS regime_state FROM si)"""


@query(f"WITH {BARS}, {_INDEX} SELECT date, round(index_value, 4) AS index_value, thermometer, regime_state, signal FROM sx")
def sentiment_index(s, d):
    return market.sentiment_index(panel(s, d)).select("date", F.round("index_value", 4).alias("index_value"), "thermometer", "regime_state", "signal")


@query(f"WITH {BARS}, {_INDEX} SELECT regime_state, count(*) AS n FROM sx GROUP BY 1")
def regime_state(s, d):
    return market.sentiment_index(panel(s, d)).groupBy("regime_state").agg(F.count("*").alias("n"))


@query(f"WITH {BARS}, {_INDEX} SELECT date, lag(regime_state) OVER (ORDER BY date) AS regime FROM sx")
def regime_lag(s, d):
    return market.regime_lag(market.sentiment_index(panel(s, d)))


@query(f"WITH {BARS}, {_INDEX}, q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT q.date, sx.regime_state FROM q ASOF LEFT JOIN sx ON q.date > sx.date")
def regime_as_of(s, d):
    probe = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return market.as_of(probe, market.sentiment_index(panel(s, d)), "regime_state")


_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2) / count(*) OVER (PARTITION BY {by})"


@query(f"""WITH {BARS}, m AS (SELECT date, avg(ret) AS mkt FROM p GROUP BY 1), b0 AS (SELECT code, industry, regr_slope(ret, mkt) AS beta FROM p JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60),
  b AS (SELECT industry, avg(beta) AS beta FROM b0 GROUP BY 1), w AS (SELECT industry, date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER) AS week, avg(ret) AS ret FROM p WHERE ret IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT week, {_RANK.format(by='week', x='beta')} AS rx, {_RANK.format(by='week', x='ret')} AS ry FROM w JOIN b USING (industry)),
  ic AS (SELECT week, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM k GROUP BY 1 HAVING count(*) >= 3 ORDER BY week DESC LIMIT 8) SELECT round(avg(ic), 6) AS gsisi FROM ic""")
def gsisi(s, d):
    return r6(market.gsisi(panel(s, d)))


# Factors


def _factor(name: str) -> None:
    @query(f"WITH {BARS}{FL} SELECT code, date, round({factors.FACTORS[name].sql}, 5) AS value FROM c", name)
    def one(s, d):
        return factors.factor_wide(panel(s, d), [name]).select("code", "date", F.round(name, 5).alias("value"))


for _name in factors.FACTORS:
    _factor(_name)


def _alpha_sql() -> str:
    """The features in SQL; strength by the definition, a fold over the changes of a code."""
    r, lag = factors._r, factors._lag
    f = {f"roc_{n}": f"adj / {lag('adj', n)} - 1" for n in (5, 10, 20, 60)} | {f"ma_{n}": f"({r('avg', 'adj', n)}) / adj - 1" for n in (5, 10, 20, 30, 60)} | {f"std_{n}": r("stddev_samp", "_log", n) for n in (5, 10, 20, 60)}
    f |= {f"rsi_{n}": f"coalesce(100 - 100 / (1 + up{n} / nullif(down{n}, 0)), 50)" for n in (10, 20)}
    f |= {f"pos_{n}": f"(adj - ({r('min', 'low', n)})) / nullif(({r('max', 'high', n)}) - ({r('min', 'low', n)}), 0)" for n in (5, 10, 20)}
    f |= {f"{k}rat_{n}": f"{x} / ({r('avg', x, n)})" for k, x in (("v", "_vol"), ("a", "_amount")) for n in (5, 10, 20)}
    f |= {f"p2h_{n}": f"adj / ({r('max', 'high', n)}) - 1" for n in (20, 60)}
    f |= {"amp_20": f"({r('avg', '(high - low)', 20)}) / adj", "turn_trend": f"({r('avg', '_vol', 5)}) / ({r('avg', '_vol', 20)}) - 1"}
    w = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    f["corr_rv_20"] = f"CASE WHEN count(_log * _dvol) {w} = 20 THEN covar_pop(_log, _dvol) {w} / nullif(stddev_pop(_log) {w} * stddev_pop(_dvol) {w}, 0) END"
    mean = lambda x, n: f"list_reduce(list_transform(gs, lambda g: greatest({x}g, 0.0)), lambda a, g: a * {1 - 1 / n} + g * {1 / n})"
    means = ", ".join(f"CASE WHEN len(gs) > 0 THEN {mean(x, n)} END AS {k}{n}" for n in (10, 20) for k, x in (("up", ""), ("down", "-")))
    return f"""c1 AS (SELECT *, nullif(vol, 0) AS _vol, nullif(amount, 0) AS _amount, list(_change) FILTER (_change IS NOT NULL) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS g0 FROM c),
  c2 AS (SELECT *, _vol / lag(_vol) OVER (PARTITION BY code ORDER BY date) - 1 AS _dvol, coalesce(g0, []) AS gs FROM c1), c3 AS (SELECT * EXCLUDE (gs, g0), {means} FROM c2)
  SELECT code, date, {', '.join(f'round({x}, 5) + 0.0 AS {k}' for k, x in f.items())} FROM c3"""


@query(f"WITH {BARS}{FL}, {_alpha_sql()}")
def alpha_features(s, d):
    out = factors.alpha_features(panel(s, d))
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {BARS}{FL}, t AS (SELECT date, code, adj, {factors._r('avg', 'adj', 5)} AS ma5, {factors._r('avg', 'adj', 20)} AS ma20, {factors.FACTORS['f_rsi_14'].sql} AS rsi, {factors._r('max', 'adj', 60)} AS top FROM c),
  s AS (SELECT date, code, 0.5 * least(greatest((ma5 / ma20 - 1) / 0.05, -1), 1) AS a, 0.3 * least(greatest((rsi - 50) / 30, -1), 1) AS b, CASE WHEN top IS NOT NULL THEN 0.2 * least(greatest((adj / top - 1) / 0.10, -1), 1) END AS e, ma20 FROM t)
  SELECT date, code, CASE WHEN e IS NOT NULL AND ma20 IS NOT NULL THEN round(least(greatest(a + b + e, -1), 1), 6) END AS tech_score FROM s""")
def tech_score(s, d):
    return r6(factors.tech_score(panel(s, d)))


_PARTS_OF_SENT = f"""s0 AS (SELECT *, coalesce(ret, 0) AS ret0, adj / {factors._lag('adj', 20)} - 1 AS gain, CASE WHEN pre_close IS NULL THEN NULL WHEN close >= pre_close * 1.095 THEN 1.0 ELSE 0.0 END AS lim, (high - low) / adj AS amp FROM p),
  s1 AS (SELECT date, code, coalesce(vol / ({factors._r('avg', 'vol', 20)}) - 1, 0) AS turnover_anomaly, coalesce({factors._r('avg', 'amp', 20)}, 0) AS amplitude, coalesce({factors._r('avg', 'lim', 20)}, 0) AS limit_up_rate,
    coalesce({factors._r('skewness', 'ret', 20)}, 0) AS return_skew, {_RANK.format(by='date', x='ret0')} AS breadth_rank, coalesce(gain - avg(gain) OVER (PARTITION BY date), 0) AS relative_strength FROM s0)"""
_SENT_Z = " + ".join(f"({w}) * coalesce(({k} - avg({k}) OVER x) / nullif(stddev_pop({k}) OVER x, 0), 0)" for k, w in factors.SENTIMENT_WEIGHTS.items())
_SENT = f"{_PARTS_OF_SENT}, se AS (SELECT date, code, least(greatest({_SENT_Z}, -1), 1) AS sentiment FROM s1 WINDOW x AS (PARTITION BY date))"
_SENT_OUT = f"WITH {BARS}, {_PARTS_OF_SENT} SELECT date, code, {', '.join(f'round({k}, 6) + 0.0 AS {k}' for k in factors.SENTIMENT_WEIGHTS)} FROM s1"


@query(_SENT_OUT)
def sent_components(s, d):
    return r6(factors.sentiment_components(panel(s, d)))


@query(f"WITH {BARS}, {_SENT} SELECT date, code, round(sentiment, 5) AS sentiment_score FROM se")
def sent_score(s, d):
    return factors.sentiment_score(panel(s, d)).select("date", "code", F.round("sentiment_score", 5).alias("sentiment_score"))


@query(bars_sql(f"SELECT date, code, round({_RANK.format(by='date', x='vol')}, 6) AS rk FROM p"))
def xs_rank_vol(s, d):
    return r6(panel(s, d).select("date", "code", xs_rank("vol").alias("rk")))


@query(bars_sql("SELECT date, code, round(coalesce((vol - avg(vol) OVER w) / nullif(stddev_pop(vol) OVER w, 0), 0), 6) AS z FROM p WINDOW w AS (PARTITION BY date)"))
def xs_zscore_vol(s, d):
    return r6(panel(s, d).select("date", "code", xs_zscore("vol").alias("z")))


@query(bars_sql("SELECT date, code, CAST(CASE WHEN n > 1 THEN greatest(ceil((r - 1) * 5.0 / (n - 1)) - 1, 0) ELSE 0 END AS INTEGER) AS bin FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY vol, code) AS r, count(*) OVER (PARTITION BY date) AS n FROM p)"))
def top_quintile(s, d):
    p = panel(s, d)
    return p.select("date", "code", crosssec.top_quintile(p, "vol").alias("bin"))


# Labels, predictions, health, neutralisation and fusion


def _lbl(h: int) -> str:
    return f"SELECT date, code, {h} AS horizon, lead(adj, {h}) OVER (PARTITION BY code ORDER BY date) / adj - 1 AS label FROM p"


_LABELS = f"l0 AS ({_lbl(1)} UNION ALL {_lbl(5)} UNION ALL {_lbl(10)}), l AS (SELECT *, label - avg(label) OVER (PARTITION BY date, horizon) AS excess FROM l0)"
_BASE = "b0 AS (SELECT date, code, adj / lag(adj, 5) OVER w - 1 AS mom, coalesce(CASE WHEN count(ret) OVER v = 20 THEN stddev_samp(ret) OVER v END, stddev_samp(ret) OVER (PARTITION BY code)) AS band FROM p WINDOW w AS (PARTITION BY code ORDER BY date), v AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)), pr AS (SELECT date, code, h AS horizon, mom * sqrt(h) AS ret_pred, mom * sqrt(h) - 1.96 * band * sqrt(h) AS lower, mom * sqrt(h) + 1.96 * band * sqrt(h) AS upper FROM b0, (VALUES (1), (5), (10)) x(h))"


@query(f"WITH {BARS}, {_LABELS} SELECT date, code, horizon, round(label, 6) AS label, round(excess, 6) AS excess, CAST(coalesce(sign(round(excess, 9)), 0) AS INTEGER) AS dir FROM l")
def fwd_labels(s, d):
    return r6(crosssec.labels(panel(s, d)))


@query(f"WITH {BARS}, {_BASE} SELECT date, code, horizon, round(ret_pred, 5) AS ret_pred, round(lower, 5) AS lower, round(upper, 5) AS upper FROM pr")
def pred_baseline(s, d):
    return crosssec.baseline(panel(s, d)).select("date", "code", "horizon", *[F.round(c, 5).alias(c) for c in ("ret_pred", "lower", "upper")])


@query(f"WITH {BARS}, {_LABELS}, {_BASE}, e AS (SELECT horizon, avg(CASE WHEN round(excess, 9) <> 0 THEN CASE WHEN sign(ret_pred) = sign(excess) THEN 1.0 ELSE 0.0 END END) AS dir_acc, avg(abs(ret_pred - label)) AS mae FROM pr JOIN l USING (date, code, horizon) WHERE ret_pred IS NOT NULL AND excess IS NOT NULL GROUP BY 1) SELECT horizon, round(dir_acc, 6) AS dir_acc, round(mae, 6) AS mae, round(CASE WHEN round(dir_acc, 9) < 0.52 THEN 0 ELSE 0.25 * greatest(2 * (dir_acc - 0.5), 0) END, 6) AS weight FROM e")
def pred_baseline_eval(s, d):
    p = panel(s, d)
    return r6(crosssec.evaluate(crosssec.baseline(p), crosssec.labels(p)))


@query(f"""WITH {BARS}, {_LABELS}, {_BASE}, j AS (SELECT horizon, date, ret_pred, label FROM pr JOIN l USING (date, code, horizon) WHERE ret_pred IS NOT NULL AND label IS NOT NULL),
  k AS (SELECT horizon, date, {_RANK.format(by='horizon, date', x='ret_pred')} AS rx, {_RANK.format(by='horizon, date', x='label')} AS ry FROM j), i AS (SELECT horizon, date, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 3),
  r AS (SELECT *, CASE WHEN count(ic) OVER w = 3 THEN avg(ic) OVER w END AS rolling, row_number() OVER (PARTITION BY horizon ORDER BY date DESC) AS back FROM i WINDOW w AS (PARTITION BY horizon ORDER BY date ROWS 2 PRECEDING)),
  o AS (SELECT horizon, avg(ic) AS ic, max(CASE WHEN back = 1 THEN rolling END) AS rolling_ic, coalesce(bool_and(CASE WHEN back <= 3 THEN abs(round(rolling, 9)) < 0.02 END), false) AS dropped FROM r GROUP BY 1)
  SELECT horizon, round(ic, 6) AS ic, round(rolling_ic, 6) AS rolling_ic, dropped, round(CASE WHEN dropped THEN 0 ELSE coalesce(0.25 * least(greatest((ic - 0.02) / 0.03, 0), 1), 0) END, 6) AS weight FROM o""")
def ic_gate(s, d):
    p = panel(s, d)
    return r6(crosssec.ic_gate(crosssec.baseline(p), crosssec.labels(p)))


_SOME = ["f_momentum_5", "f_volatility_20", "f_volume_ratio_20", "f_amplitude_20"]


def _long(names: list[str]) -> str:
    return "fl AS (" + " UNION ALL ".join(f"SELECT date, code, industry, mv, fwd, '{n}' AS factor_name, {factors.FACTORS[n].sql} AS value, {factors.FACTORS[n].direction} * ({factors.FACTORS[n].sql}) AS v FROM c" for n in names) + ")"


_DIC = f"k AS (SELECT factor_name, date, {_RANK.format(by='factor_name, date', x='v')} AS rx, {_RANK.format(by='factor_name, date', x='fwd')} AS ry FROM fl WHERE v IS NOT NULL AND fwd IS NOT NULL), ic AS (SELECT factor_name, date, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(f"WITH {BARS}{FL}, {_long(_SOME)}, {_DIC} SELECT factor_name, date, round(ic, 6) AS ic FROM ic")
def factor_ic(s, d):
    p = panel(s, d)
    return r6(crosssec.daily_ic(p, factors.factor_long(p, _SOME)).select("factor_name", "date", "ic"))


@query(f"""WITH {BARS}{FL}, {_long(_SOME)}, {_DIC}, dd AS (SELECT DISTINCT date FROM p WHERE fwd IS NOT NULL ORDER BY date DESC LIMIT 60),
  g AS (SELECT factor_name, avg(ic) AS ic, stddev_pop(ic) AS sd, count(ic) AS days FROM ic WHERE date IN (FROM dd) GROUP BY 1),
  x AS (SELECT *, row_number() OVER (PARTITION BY factor_name, date ORDER BY v, code) AS r, count(*) OVER (PARTITION BY factor_name, date) AS n, {_RANK.format(by='factor_name, date', x='v')} AS rk FROM fl WHERE value IS NOT NULL AND fwd IS NOT NULL AND date IN (FROM dd)),
  y AS (SELECT *, CASE WHEN n > 1 THEN greatest(ceil((r - 1) * 5.0 / (n - 1)) - 1, 0) ELSE 0 END AS bin, abs(rk - lag(rk) OVER (PARTITION BY factor_name, code ORDER BY date)) AS turn FROM x),
  h AS (SELECT factor_name, avg(CASE WHEN bin = 4 THEN fwd END) AS rank_return, avg(turn) AS turnover FROM y GROUP BY 1)
  SELECT factor_name, round(ic, 6) AS ic, round(coalesce(ic / nullif(sd, 0) * sqrt(days), 0), 6) AS icir, round(rank_return, 6) AS rank_return, round(turnover, 6) AS turnover, CASE WHEN round(ic, 9) >= 0.02 THEN 'effective' WHEN round(ic, 9) >= 0.01 THEN 'decaying' ELSE 'failed' END AS status, CASE WHEN round(ic, 9) >= 0.02 THEN 1.0 WHEN round(ic, 9) >= 0.01 THEN 0.5 ELSE 0.1 END AS weight_scale FROM g JOIN h USING (factor_name)""")
def factor_health(s, d):
    p = panel(s, d)
    return r6(crosssec.factor_health(p, factors.factor_long(p, _SOME)))


@query(f"""WITH {BARS}{FL}, {_long(_SOME)}, a AS (SELECT date, code, factor_name, industry, value - avg(value) OVER w AS y, ln(mv) - avg(ln(mv)) OVER w AS x FROM fl WHERE value IS NOT NULL WINDOW w AS (PARTITION BY date, factor_name, industry)),
  b AS (SELECT *, round(y - coalesce(sum(x * y) OVER w / nullif(sum(x * x) OVER w, 0), 0) * x, 9) AS res FROM a WINDOW w AS (PARTITION BY date, factor_name))
  SELECT date, code, factor_name, round(coalesce((res - avg(res) OVER w) / nullif(stddev_pop(res) OVER w, 0), 0), 4) AS value FROM b WINDOW w AS (PARTITION BY date, factor_name)""")
def neutralize(s, d):
    p = panel(s, d)
    out = crosssec.neutralize(factors.factor_long(p, _SOME).join(p.select("date", "code", "industry", "mv"), ["date", "code"]))
    return out.withColumn("value", F.round("value", 4))


_TECH = f"""t0 AS (SELECT date, code, adj, {factors._r('avg', 'adj', 5)} AS ma5, {factors._r('avg', 'adj', 20)} AS ma20, {factors.FACTORS['f_rsi_14'].sql} AS rsi, {factors._r('max', 'adj', 60)} AS top FROM c),
  te AS (SELECT date, code, least(greatest(0.5 * least(greatest((ma5 / ma20 - 1) / 0.05, -1), 1) + 0.3 * least(greatest((rsi - 50) / 30, -1), 1) + 0.2 * least(greatest((adj / top - 1) / 0.10, -1), 1), -1), 1) AS tech FROM t0 WHERE top IS NOT NULL)"""
def _fuse(weights: str = "SELECT NULL AS factor_name, NULL AS weight", sentiment: str = "z3") -> str:
    """The four sources as z-scores by date; weights: factor_name and weight, 1 for all others."""
    z = lambda x: f"coalesce(({x} - avg({x}) OVER x) / nullif(stddev_pop({x}) OVER x, 0), 0)"
    dirs = ", ".join(f"('{n}', {f.direction})" for n, f in factors.FACTORS.items())
    return f"""fz AS (SELECT date, code, factor_name, {z('value')} AS z FROM fl WHERE value IS NOT NULL WINDOW x AS (PARTITION BY date, factor_name)),
  fs(factor_name, dir) AS (VALUES {dirs}), fw AS ({weights}),
  fa AS (SELECT date, code, sum(z * dir * coalesce(weight, 1)) / sum(coalesce(weight, 1)) AS factor FROM fz JOIN fs USING (factor_name) LEFT JOIN fw USING (factor_name) GROUP BY 1, 2),
  tz AS (SELECT date, code, {z('tech')} AS tech FROM te WINDOW x AS (PARTITION BY date)), sz AS (SELECT date, code, {z('sentiment')} AS z3 FROM se WINDOW x AS (PARTITION BY date)),
  pv AS (SELECT date, code, sign(mom) AS vote FROM b0 WHERE mom IS NOT NULL), pz AS (SELECT date, code, {z('vote')} AS predict FROM pv WINDOW x AS (PARTITION BY date)),
  fu AS (SELECT date, code, coalesce(factor, 0) AS f1, coalesce(tech, 0) AS f2, coalesce({sentiment}, 0) AS f3, coalesce(predict, 0) AS f4 FROM p LEFT JOIN fa USING (date, code) LEFT JOIN tz USING (date, code) LEFT JOIN sz USING (date, code) LEFT JOIN pz USING (date, code))"""


_FUSE = f"{_long(list(factors.FACTORS))}, {_fuse()}"
_ALL = f"{BARS}{FL}, {_BASE}, {_SENT}, {_TECH}, {_FUSE}"
_PARTS = {"factor": "f1", "tech": "f2", "sentiment": "f3", "predict": "f4"}
_FX = f"""fd AS (SELECT date, code, f1, f2, f3, f4, {', '.join(f'round({x}, 4) + 0.0 AS {k}_contrib' for k, x in _PARTS.items())}, round(0.40 * f1 + 0.20 * f2 + 0.15 * f3 + 0.25 * f4, 6) + 0.0 AS total FROM fu),
  fx AS (SELECT * EXCLUDE (f1, f2, f3, f4), CAST(CASE WHEN total > 0.05 THEN 1 WHEN total < -0.05 THEN -1 ELSE 0 END AS INTEGER) AS direction, round(1 / (1 + exp(-2.5 * abs(total))), 3) AS confidence,
    coalesce(nullif(concat_ws(',', {', '.join(f"CASE WHEN round(abs({x}), 6) > 0.01 THEN '{k}' END" for k, x in _PARTS.items())}), ''), 'none') AS source_tags FROM fd)"""


@query(f"WITH {_ALL}, {_FX} SELECT date, code, total, direction FROM fx")
def fusion_signals(s, d):
    return crosssec.fuse(panel(s, d)).select("date", "code", "total", "direction")


@query(f"WITH {_ALL}, {_FX} SELECT date, count(*) FILTER (total > 0.05) AS up, count(*) FILTER (total < -0.05) AS down, count(*) FILTER (abs(total) <= 0.05) AS flat FROM fx GROUP BY 1")
def brief_counts(s, d):
    return crosssec.fuse(panel(s, d)).groupBy("date").agg(*[F.count_if(F.col("direction") == k).alias(n) for k, n in ((1, "up"), (-1, "down"), (0, "flat"))])


@query(f"WITH {_ALL}, {_FX} SELECT * FROM fx")
def fusion_detail(s, d):
    return crosssec.fuse(panel(s, d))


def _hot(s, d):
    """A score of each code from events: the mean distance of their values from 50, in 50s."""
    e = table(s, d, "events").select(F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("code"), "value")
    return e.groupBy("code").agg(((F.avg("value") - 50) / 50).alias("score"))


_HEALTH = f"""{_DIC}, dd AS (SELECT DISTINCT date FROM p WHERE fwd IS NOT NULL ORDER BY date DESC LIMIT 60), hg AS (SELECT factor_name, coalesce(avg(ic), 0) AS ic FROM ic WHERE date IN (FROM dd) GROUP BY 1),
  hs(factor_name, base) AS (VALUES {', '.join(f"('{n}', {f.weight})" for n, f in factors.FACTORS.items())}),
  hw AS (SELECT factor_name, base * CASE WHEN round(ic, 9) >= 0.02 THEN 1.0 WHEN round(ic, 9) >= 0.01 THEN 0.5 ELSE 0.1 END AS weight FROM hg JOIN hs USING (factor_name))"""
_HO = "ho AS (SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS code, avg((value)) / 50 - 1 AS score FROM events GROUP BY 1)"


@query(f"""WITH {BARS}{FL}, {_BASE}, {_SENT}, {_TECH}, {_long(list(factors.FACTORS))}, {_HEALTH}, {_HO}, {_STOCKS}, {_INDEX}, rl AS (SELECT date, lag(regime_state) OVER (ORDER BY date) AS regime FROM sx),
  {_fuse('SELECT factor_name, weight FROM hw', '(SELECT coalesce(0.3 * max(score) + 0.7 * sz.z3, sz.z3) FROM ho WHERE ho.code = p.code)')}, {_FX}
  SELECT fx.* EXCLUDE (confidence), round(least(1.0, confidence * CASE regime WHEN 'bear' THEN 0.70 WHEN 'panic' THEN 0.45 ELSE 1.0 END), 3) AS confidence
  FROM fx LEFT JOIN rl USING (date) WHERE fx.date = (SELECT max(date) FROM p) AND code IN (SELECT code FROM st WHERE NOT delisted AND name NOT LIKE '*ST%')""")
def fusion_latest(s, d):
    p = panel(s, d)
    scale = F.create_map(*[F.lit(x) for n, f in factors.FACTORS.items() for x in (n, f.weight)])
    health = crosssec.factor_health(p, factors.factor_long(p)).select("factor_name", (scale[F.col("factor_name")] * F.col("weight_scale")).alias("weight"))
    keep = _stocks(s, d).where("NOT delisted AND name NOT LIKE '*ST%'").select("code")
    regimes = market.regime_lag(market.sentiment_index(p))
    fused = crosssec.fuse(p, weights=health, hot=_hot(s, d), regimes=regimes, universe=keep)
    return fused.join(p.agg(F.max("date").alias("date")), "date", "left_semi")


@query(f"WITH {_ALL}, {_FX} SELECT * FROM fx WHERE date = (SELECT max(date) FROM fx) ORDER BY confidence DESC, code LIMIT 10")
def top_signals(s, d):
    return tables.latest(crosssec.fuse(panel(s, d))).orderBy(F.desc("confidence"), "code").limit(10)


@query(f"WITH {_ALL}, {_FX} SELECT date, CAST(least(greatest(round(50 + 50 * sum(direction * confidence) / sum(confidence)), 0), 100) AS INTEGER) AS temperature, count(*) FILTER (direction = 1) AS up, count(*) FILTER (direction = -1) AS down FROM fx GROUP BY 1")
def market_temperature(s, d):
    x = crosssec.fuse(panel(s, d)).groupBy("date").agg(F.sum(F.col("direction") * F.col("confidence")).alias("a"), F.sum("confidence").alias("b"), F.count_if(F.col("direction") == 1).alias("up"), F.count_if(F.col("direction") == -1).alias("down"))
    return x.select("date", F.least(F.greatest(F.round(50 + 50 * F.col("a") / F.col("b")), F.lit(0.0)), F.lit(100.0)).cast("int").alias("temperature"), "up", "down")


# Backtests


def _scores(p):
    return p.select("date", "code", (F.col("adj") / F.lag("adj", 5).over(by_code()) - 1).alias("score"), F.coalesce(backtest.at_upper_limit(), F.lit(False)).alias("at_limit"))


_TOP = "sc AS (SELECT date, code, fwd, adj / lag(adj, 5) OVER (PARTITION BY code ORDER BY date) - 1 AS score, coalesce(round(close / nullif(pre_close, 0), 9) >= 1.1, false) AS lim FROM p), sr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS hi, row_number() OVER (PARTITION BY date ORDER BY score, code) AS lo, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY date))) AS k FROM sc WHERE score IS NOT NULL)"
_TOPW = f"{_TOP}, wt AS (SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM sr WHERE hi <= k AND NOT lim)"
#: Buys at the upper limit and shorts at the lower one go, then the gross exposure is 1. From bk to wt.
_FULL = """md AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM p)), mv AS (SELECT p.date, p.code, round(p.close / nullif(b.close, 0), 9) AS move FROM p JOIN md USING (date) LEFT JOIN p b ON b.code = p.code AND b.date = md.prev),
  bl AS (SELECT date, code, weight FROM bk LEFT JOIN mv USING (date, code) WHERE NOT coalesce(CASE WHEN weight > 0 THEN move >= 1.1 WHEN weight < 0 THEN move <= 0.9 END, false)),
  wt AS (SELECT date, code, weight / sum(abs(weight)) OVER (PARTITION BY date) AS weight FROM bl)"""


def _sim(calendar: str = "SELECT DISTINCT date FROM wt") -> str:
    return f"""ca AS ({calendar}), dt AS (SELECT date, held, lead(date) OVER o AS nxt, held AND coalesce(lag(held) OVER o, false) AS carried FROM (SELECT date, date IN (SELECT date FROM wt) AS held FROM ca) WINDOW o AS (ORDER BY date)),
  ch AS (SELECT date, code, sum(w) AS dw FROM (SELECT date, code, weight AS w FROM wt UNION ALL SELECT nxt, code, -weight FROM wt JOIN dt USING (date) WHERE nxt IS NOT NULL) GROUP BY 1, 2), tu AS (SELECT date, sum(abs(dw)) / 2 AS turn FROM ch GROUP BY 1),
  gr AS (SELECT date, sum(weight * coalesce(fwd, 0)) AS gross FROM wt JOIN p USING (date, code) GROUP BY 1), be AS (SELECT date, coalesce(avg(fwd), 0) AS bench FROM p GROUP BY 1),
  tn AS (SELECT date, CASE WHEN held THEN coalesce(gross, 0) ELSE 0 END AS gross, CASE WHEN NOT held THEN 0 WHEN carried THEN turn ELSE 1 END AS turnover, bench FROM dt LEFT JOIN tu USING (date) LEFT JOIN gr USING (date) JOIN be USING (date)),
  run AS (SELECT date, gross, turnover, gross - turnover * {backtest.COST!r} AS net, bench FROM tn)"""


_SIM = _sim("SELECT DISTINCT date FROM sr").replace("run AS (", "sm AS (")
_RUN = _sim()
_RUN_OUT = "SELECT date, round(gross, 6) + 0.0 AS gross, round(turnover, 6) AS turnover, round(net, 6) + 0.0 AS net, round(bench, 6) + 0.0 AS bench FROM run"


def _momentum(p):
    """The simulated momentum book: every date with a score has a row, in cash where all picks are at their limit."""
    scores = _scores(p)
    return backtest.simulate(backtest.top_k_long(scores), p, calendar=scores.where("score IS NOT NULL"))


@query(f"WITH {BARS}, {_TOPW} SELECT date, code, round(weight, 6) AS weight FROM wt")
def topk_long(s, d):
    return r6(backtest.top_k_long(_scores(panel(s, d))))


@query(f"WITH {BARS}, {_TOP} SELECT date, code, round(CASE WHEN lo <= k THEN -1.0 / k ELSE 1.0 / k END, 6) AS weight FROM sr WHERE lo <= k OR hi <= k")
def long_short(s, d):
    return r6(backtest.long_short(_scores(panel(s, d))))


@query(f"WITH {BARS}, {_TOPW}, {_SIM} SELECT date, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net, round(bench, 6) AS bench FROM sm")
def bt_simulate(s, d):
    p = panel(s, d)
    return r6(_momentum(p))


@query(f"WITH {BARS}, {_TOPW}, {_SIM}, eq AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM sm), dd AS (SELECT *, e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq) SELECT count(net) AS n, round(avg(net) / stddev_samp(net) * sqrt(252), 5) AS sharpe, round(min(dd), 5) AS max_drawdown, round(regr_slope(net, bench), 5) AS beta FROM dd")
def perf_metrics(s, d):
    p = panel(s, d)
    m = backtest.metrics(_momentum(p))
    return m.select("n", *[F.round(c, 5).alias(c) for c in ("sharpe", "max_drawdown", "beta")])


_METRICS = "eq AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM sm), dd AS (SELECT *, e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq), me AS (SELECT CAST(count(net) AS DOUBLE) AS n, round(pow(1 + avg(net), 252) - 1, 5) AS ann_return, round(avg(net) / stddev_samp(net) * sqrt(252), 5) AS sharpe, round(min(dd), 5) AS max_drawdown, round(regr_intercept(net, bench) * 252, 5) AS alpha, round(regr_slope(net, bench), 5) AS beta FROM dd)"


@query(f"WITH {BARS}, {_TOPW}, {_SIM}, {_METRICS} SELECT metric_name, metric_value FROM (UNPIVOT me ON n, ann_return, sharpe, max_drawdown, alpha, beta INTO NAME metric_name VALUE metric_value)")
def perf_report_long(s, d):
    m = backtest.metrics(_momentum(panel(s, d)))
    m = m.select(F.col("n").cast("double").alias("n"), *[F.round(c, 5).alias(c) for c in m.columns if c != "n"])
    return m.unpivot([], m.columns, "metric_name", "metric_value")


@query()
def deflated_sharpe(s, d):
    p = panel(s, d)
    return backtest.deflated_sharpe(_momentum(p))


_FOLDS = f"""{_long(_SOME)}, {_DIC}, nd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place FROM (SELECT DISTINCT date FROM p)), nn AS (SELECT count(*) AS n FROM nd),
  np AS (SELECT n, CASE WHEN n >= 270 THEN 250 ELSE greatest(20, n // 3) END AS train, CASE WHEN n >= 270 THEN 20 ELSE n - greatest(20, n // 3) END AS test FROM nn),
  fo AS (SELECT start // 20 AS fold, start, train, test FROM (SELECT unnest(range(0, greatest(n - train - test, 0) + 1, 20)) AS start, train, test FROM np WHERE test > 0)),
  fq AS (SELECT fold, factor_name, avg(ic) AS weight FROM ic JOIN nd USING (date) JOIN fo ON place BETWEEN start AND start + train - 1 GROUP BY 1, 2),
  zz AS (SELECT date, code, factor_name, coalesce((v - avg(v) OVER x) / nullif(stddev_pop(v) OVER x, 0), 0) AS z FROM fl WHERE value IS NOT NULL WINDOW x AS (PARTITION BY date, factor_name)),
  al AS (SELECT fold, date, code, sum(z * weight) AS alpha FROM zz JOIN nd USING (date) JOIN fo ON place BETWEEN start + train AND start + train + test - 1 JOIN fq USING (fold, factor_name) GROUP BY 1, 2, 3)"""


def _forked(s, d, names=tuple(_SOME)):
    """The panel and its factors as tables, for queries that use them several times: one scan of lineitem."""
    folder = _shared(s)
    panel(s, d).write.parquet(f"{folder}/panel")
    p = s.read.parquet(f"{folder}/panel")
    factors.factor_long(p, list(names)).write.parquet(f"{folder}/factors")
    return p, s.read.parquet(f"{folder}/factors")


@query(f"WITH {BARS}{FL}, {_FOLDS} SELECT fold, factor_name, round(weight, 6) + 0.0 AS weight FROM fq")
def wf_weights(s, d):
    return r6(backtest.fold_weights(*_forked(s, d)))


@query(f"WITH {BARS}{FL}, {_FOLDS} SELECT fold, date, code, round(alpha, 6) + 0.0 AS alpha FROM al")
def wf_alpha(s, d):
    return r6(backtest.fold_alpha(*_forked(s, d)))


@query(f"""WITH {BARS}{FL}, {_FOLDS}, ak AS (SELECT date, code, alpha, row_number() OVER (PARTITION BY date ORDER BY round(alpha, 9) DESC, code) AS hi, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY date))) AS k FROM al),
  bk AS (SELECT ak.date, ak.code FROM ak JOIN p USING (date, code) WHERE hi <= k AND NOT coalesce(round(close / nullif(pre_close, 0), 9) >= 1.1, false)), wt AS (SELECT date, code, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM bk), {_sim('SELECT DISTINCT date FROM ak')} {_RUN_OUT}""")
def wf_returns(s, d):
    p, f = _forked(s, d)
    alpha = backtest.fold_alpha(p, f).select("date", "code", F.round("alpha", 9).alias("score"))
    alpha = alpha.join(p.select("date", "code", F.coalesce(backtest.at_upper_limit(), F.lit(False)).alias("at_limit")), ["date", "code"])
    return r6(backtest.simulate(backtest.top_k_long(alpha), p, calendar=alpha))


def _signal_book(regimes: str = "1.0") -> str:
    return f"""sg AS (SELECT date, code, confidence * {regimes} AS conf, close, pre_close FROM fx JOIN p USING (date, code) LEFT JOIN rl USING (date) WHERE direction = 1),
  sh AS (SELECT date, code, conf FROM sg WHERE round(conf, 9) >= 0.52 AND NOT coalesce(round(close / nullif(pre_close, 0), 9) >= 1.1, false)), wt AS (SELECT date, code, conf / sum(conf) OVER (PARTITION BY date) AS weight FROM sh), {_sim('SELECT DISTINCT date FROM fx')}"""


_LAGGED = f"{_INDEX}, rl AS (SELECT date, lag(regime_state) OVER (ORDER BY date) AS regime FROM sx)"
_SCALE = "CASE regime WHEN 'bear' THEN 0.70 WHEN 'panic' THEN 0.45 ELSE 1.0 END"


def _signal_run(p, fused, regimes=None):
    return backtest.simulate(backtest.signal_weights(fused, p, 0.52, regimes), p, calendar=fused)


@query(f"WITH {_ALL}, {_FX}, {_LAGGED}, {_signal_book()} {_RUN_OUT}")
def bt_signal(s, d):
    p = panel(s, d)
    return r6(_signal_run(p, crosssec.fuse(p)))


def _metrics_sql(mode: str) -> str:
    return f"SELECT '{mode}' AS mode, round(pow(1 + avg(net), 252) - 1, 5) AS ann_return, round(avg(net) / stddev_samp(net) * sqrt(252), 5) AS sharpe, round(min(dd), 5) AS max_drawdown FROM (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM (SELECT *, product(1 + net) OVER (ORDER BY date) AS e FROM run))"


@query(f"SELECT * FROM (WITH {_ALL}, {_FX}, {_LAGGED}, {_signal_book(_SCALE)} {_metrics_sql('on')}) UNION ALL SELECT * FROM (WITH {_ALL}, {_FX}, {_LAGGED}, {_signal_book()} {_metrics_sql('off')})")
def regime_delta(s, d):
    p, folder = panel(s, d), _shared(s)
    # Both books are made from the same signals, which are written once.
    crosssec.fuse(p).join(market.regime_lag(market.sentiment_index(p)), "date", "left").write.parquet(f"{folder}/signals")
    p.select("date", "code", "close", "pre_close", "fwd").write.parquet(f"{folder}/panel")
    fused, p = s.read.parquet(f"{folder}/signals"), s.read.parquet(f"{folder}/panel")
    regimes = fused.select("date", "regime").distinct()
    fused = fused.drop("regime")
    on, off = (backtest.metrics(_signal_run(p, fused, r)).select(F.lit(n).alias("mode"), *[F.round(c, 5).alias(c) for c in ("ann_return", "sharpe", "max_drawdown")]) for n, r in (("on", regimes), ("off", None)))
    return on.unionByName(off)


@query(f"""WITH {BARS}, {_INDEX}, {_TOPW.replace("wt AS", "full_wt AS")}, wt AS (SELECT date, code, weight * CASE signal WHEN 'buy' THEN 1.0 WHEN 'out' THEN 0.0 ELSE 0.5 END AS weight FROM full_wt LEFT JOIN sx USING (date)), {_RUN} {_RUN_OUT}""")
def bt_timing(s, d):
    p = panel(s, d)
    w = backtest.exposure(backtest.top_k_long(_scores(p)), market.sentiment_index(p).select("date", "signal"))
    return r6(backtest.simulate(w, p))


# Votes, blends, briefs, alerts and further backtests


@query(f"WITH {BARS}, {_BASE}, v AS (SELECT date, code, sum(sign(ret_pred) * w) / sum(w) AS raw FROM (SELECT *, CASE horizon WHEN 1 THEN 0.25 WHEN 5 THEN 0.1 ELSE 0 END AS w FROM pr WHERE ret_pred IS NOT NULL) WHERE w > 0 GROUP BY 1, 2) SELECT date, code, round(coalesce((raw - avg(raw) OVER x) / nullif(stddev_pop(raw) OVER x, 0), 0), 6) AS vote FROM v WINDOW x AS (PARTITION BY date)")
def predict_vote(s, d):
    w = F.when(F.col("horizon") == 1, 0.25).when(F.col("horizon") == 5, 0.1).otherwise(0.0)
    v = crosssec.baseline(panel(s, d)).where("ret_pred IS NOT NULL").select("date", "code", F.signum("ret_pred").alias("dir"), w.alias("weight"))
    return r6(models.predict_vote(v))


@query(f"""WITH {BARS}, {_SENT}, ho AS (SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS code, avg((value)) / 50 - 1 AS score FROM events GROUP BY 1),
  hz AS (SELECT date, code, coalesce((sentiment - avg(sentiment) OVER x) / nullif(stddev_pop(sentiment) OVER x, 0), 0) AS z FROM se WINDOW x AS (PARTITION BY date))
  SELECT date, code, round(CASE WHEN score IS NOT NULL THEN 0.3 * score + 0.7 * z ELSE z END, 6) AS sentiment_score FROM hz LEFT JOIN ho USING (code)""")
def hotspot_blend(s, d):
    return r6(models.blend_hotspots(factors.sentiment_score(panel(s, d)), _hot(s, d)))


@query()
def signal_detail(s, d):
    p = panel(s, d)
    f = factors.factor_long(p).where("value IS NOT NULL")
    top = tables.latest(f).groupBy("code").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.abs("value").alias("size"), "factor_name", "value")), asc=False), 1, 10).alias("factors"))
    return tables.latest(crosssec.fuse(p)).select("code", "direction", "confidence").join(top, "code", "left")


@query(f"WITH {BARS}, {_TOPW}, {_SIM}, eq AS (SELECT date, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM sm) SELECT date, round(e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM eq")
def max_drawdown(s, d):
    p = panel(s, d)
    return r6(backtest.drawdown(_momentum(p)))


@query("WITH m AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS a, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS b FROM orders GROUP BY 1) SELECT date, round(((a - avg(a) OVER w) / (stddev_samp(a) OVER w + 1e-9) + (b - avg(b) OVER w) / (stddev_samp(b) OVER w + 1e-9)) / 2, 5) AS money_dim FROM m WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)")
def ms_money(s, d):
    week = F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")
    o = table(s, d, "orders").groupBy(week).agg(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0)).alias("b"))
    return market.money_dimension(o, ["a", "b"]).select("date", F.round("money_dim", 5).alias("money_dim"))


@query("WITH o AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 1000 AS pe FROM orders GROUP BY 1), b AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_tax) AS y FROM lineitem GROUP BY 1) SELECT date, round(1 / pe - y, 6) AS premium FROM o JOIN b USING (date)")
def ms_riskpremium(s, d):
    week = lambda c: F.to_date(F.date_trunc("week", c)).alias("date")
    pe = table(s, d, "orders").groupBy(week("o_orderdate")).agg((F.avg("o_totalprice") / 1000).alias("pe"))
    bond = table(s, d, "lineitem").groupBy(week("l_shipdate")).agg(F.avg("l_tax").alias("yield_10y"))
    return r6(market.risk_premium(pe, bond))


@query(f"WITH {BARS}, {_TWO}, g AS (SELECT count(*) AS n FROM a JOIN b USING (code, date) WHERE round(abs(a.close - b.close) / a.close, 9) > 0.03), f AS (SELECT CAST(DATE '2002-01-01' - max(date) AS INTEGER) AS age FROM raw) SELECT age AS age_days, n AS divergences, CASE WHEN age > 3 THEN 'stale' WHEN n > 50 THEN 'diverging' ELSE 'ok' END AS level FROM g, f")
def alerts(s, d):
    n = tables.divergence(*_two(s, d)).agg(F.count("*").alias("divergences"))
    age = raw_bars(s, d).agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max("date")).alias("age_days"))
    level = F.when(F.col("age_days") > 3, "stale").when(F.col("divergences") > 50, "diverging").otherwise("ok")
    return age.join(n, F.lit(True)).withColumn("level", level)  # one row each


@query("SELECT o_orderkey, round(o_totalprice * 0.0003 + greatest(5 - o_totalprice * 0.0003, 0), 7) AS commission, round(o_totalprice * 0.0005, 7) AS stamp, round(o_totalprice * 4 / 1e4, 7) AS slippage FROM orders")
def cost_apply(s, d):
    o = backtest.trade_costs(table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount")))
    return o.select("o_orderkey", *[F.round(c, 7).alias(c) for c in ("commission", "stamp", "slippage")])


@query(f"""WITH {BARS}{FL}, {_TECH}, tr AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY tech DESC, code) AS hi, row_number() OVER (PARTITION BY date ORDER BY tech, code) AS lo, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY date))) AS k FROM te),
  bk AS (SELECT date, code, CASE WHEN lo <= k THEN -1.0 / k ELSE 1.0 / k END AS weight FROM tr WHERE lo <= k OR hi <= k), {_FULL}, {_sim('SELECT DISTINCT date FROM bk')} {_RUN_OUT}""")
def bt_tech_ls(s, d):
    p = panel(s, d)
    book = backtest.long_short(factors.tech_score(p).withColumnRenamed("tech_score", "score"))
    return r6(backtest.simulate(backtest.full(backtest.tradable(book, p)), p, calendar=book))


@query(f"""WITH {BARS}{FL}, {_long(_SOME)}, {_DIC}, gw AS (SELECT factor_name, avg(ic) AS w FROM ic GROUP BY 1), gd(factor_name, sign) AS (VALUES {', '.join(f"('{n}', {factors.FACTORS[n].direction})" for n in _SOME)}),
  gz AS (SELECT date, code, factor_name, coalesce((value - avg(value) OVER x) / nullif(stddev_pop(value) OVER x, 0), 0) AS z FROM fl WHERE value IS NOT NULL WINDOW x AS (PARTITION BY date, factor_name)),
  ga AS (SELECT date, code, sum(sign * z * w) AS score FROM gz JOIN gw USING (factor_name) JOIN gd USING (factor_name) GROUP BY 1, 2),
  gs AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS hi, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY date))) AS k FROM ga WHERE score IS NOT NULL),
  bk AS (SELECT date, code, 1.0 AS weight FROM gs WHERE hi <= k), {_FULL}, {_sim('SELECT DISTINCT date FROM bk')} {_RUN_OUT}""")
def bt_factor_full(s, d):
    p = panel(s, d)
    f = factors.factor_long(p, _SOME).where("value IS NOT NULL")
    w = crosssec.daily_ic(p, f).groupBy("factor_name").agg(F.avg("ic").alias("w"))
    z = f.withColumn("z", crosssec.directions()[F.col("factor_name")] * xs_zscore("value", Window.partitionBy("date", "factor_name"))).join(w, "factor_name")
    alpha = z.groupBy("date", "code").agg(F.sum(F.col("z") * F.col("w")).alias("score")).withColumn("at_limit", F.lit(False))
    book = backtest.top_k_long(alpha)
    return r6(backtest.simulate(backtest.full(backtest.tradable(book, p)), p, calendar=book))


def _committee(s, d):
    p = panel(s, d)
    features = factors.alpha_features(p)
    names = [c for c in features.columns if c not in ("code", "date")]
    band = p.select("date", "code", roll(F.stddev_samp, "ret", 20).alias("band"))
    folder = _shared(s)
    # Features and labels are read many times, so they are tables.
    features.join(band, ["date", "code"]).write.parquet(f"{folder}/features")
    crosssec.labels(p).write.parquet(f"{folder}/labels")
    features = s.read.parquet(f"{folder}/features")
    return features, names, committee.fit_committee(features, s.read.parquet(f"{folder}/labels"), names, f"{folder}/committee")


@query()
def ml_committee(s, d):
    features, names, chosen = _committee(s, d)
    return committee.committee_predictions(features, names, chosen)


@query()
def ml_committee_scores(s, d):
    features, _, chosen = _committee(s, d)
    return committee.committee_scores(features, chosen)


# Predictors of single codes


def _ls(h: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING)"
    y = f"CASE WHEN x IS NOT NULL THEN lead(adj, {h}) OVER (PARTITION BY code ORDER BY date) / adj - 1 END"
    return f"""SELECT date, code, {h} AS horizon, x, bars, regr_slope(y, x) {w} AS slope, regr_intercept(y, x) {w} AS base, stddev_samp(y) {w} AS sd, count(y) {w} AS n
  FROM (SELECT date, code, x, bars, {y} AS y FROM (SELECT date, code, adj, adj / lag(adj, 5) OVER (PARTITION BY code ORDER BY date) - 1 AS x, row_number() OVER (PARTITION BY code ORDER BY date) AS bars FROM p))"""


@query(f"WITH {BARS}, q AS ({_ls(1)} UNION ALL {_ls(5)} UNION ALL {_ls(10)}) SELECT code, date, horizon, round(base + slope * x, 6) + 0.0 AS ret_pred, round(base + slope * x - 1.96 * sd, 6) + 0.0 AS lower, round(base + slope * x + 1.96 * sd, 6) + 0.0 AS upper FROM q WHERE bars >= 30 AND n >= 20 AND x IS NOT NULL AND slope IS NOT NULL")
def pred_least_squares(s, d):
    p = panel(s, d).select("code", "date", "adj")
    targets = p.select("code", "date", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("horizon"))
    return r6(predictors.predict_targets(p, targets, predictors.LeastSquares).select("code", "date", "horizon", "ret_pred", "lower", "upper"))


def _evaluated(s, d) -> evaluation.EvaluationStore:
    p = panel(s, d)
    store = evaluation.EvaluationStore(s, f"{_shared(s)}/evaluation")
    evaluation.evaluate_resumably(store, "least_squares", p.select("code", "date", "adj"), crosssec.labels(p), predictors.LeastSquares)
    return store


_LAST = "la AS (SELECT *, row_number() OVER (PARTITION BY code, horizon ORDER BY date DESC) AS back FROM l WHERE label IS NOT NULL AND round(excess, 9) <> 0)"
_PAIRS = f"q AS ({_ls(1)} UNION ALL {_ls(5)} UNION ALL {_ls(10)}), pa AS (SELECT code, horizon, date, CAST(sign(base + slope * x) AS INTEGER) AS dir_pred, CAST(sign(excess) AS INTEGER) AS dir, base + slope * x AS ret_pred, label FROM la JOIN q USING (code, horizon, date) WHERE back <= 15 AND bars >= 30 AND n >= 20 AND x IS NOT NULL AND slope IS NOT NULL)"


@query(f"WITH {BARS}, {_LABELS}, {_LAST}, {_PAIRS} SELECT code, horizon, date, dir_pred, dir, round(ret_pred, 6) + 0.0 AS ret_pred, round(label, 6) + 0.0 AS actual FROM pa")
def eval_pairs(s, d):
    return r6(_evaluated(s, d).pairs().drop("model"))


@query(f"""WITH {BARS}, {_LABELS}, {_LAST}, {_PAIRS}, k AS (SELECT date, {_RANK.format(by='date', x='ret_pred')} AS rx, {_RANK.format(by='date', x='label')} AS ry FROM pa),
  i AS (SELECT date, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM k GROUP BY 1 HAVING count(*) >= 3),
  r AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(ic) OVER w END AS rolling, row_number() OVER (ORDER BY date DESC) AS back FROM i WHERE ic IS NOT NULL WINDOW w AS (ORDER BY date ROWS 2 PRECEDING)),
  o AS (SELECT avg(ic) AS ic, max(CASE WHEN back = 1 THEN rolling END) AS rolling_ic, count(rolling) FILTER (back <= 3) = 3 AND bool_and(abs(round(rolling, 9)) < 0.02) FILTER (back <= 3) AS dropped FROM r),
  a AS (SELECT avg(CASE WHEN dir_pred = dir THEN 1.0 ELSE 0.0 END) AS dir_acc FROM pa)
  SELECT 'least_squares' AS model, round(dir_acc, 6) AS dir_acc, round(ic, 6) AS ic, round(rolling_ic, 6) AS rolling_ic, dropped, round(CASE WHEN dropped THEN 0 ELSE 0.25 * least(greatest((ic - 0.02) / 0.03, 0), 1) END, 6) AS weight FROM o, a""")
def model_gate(s, d):
    return r6(evaluation.model_gate(_evaluated(s, d).pairs()))


@query()
def tech_strokes(s, d):
    return r6(strokes.stroke_scores(panel(s, d)))


@query(f"""WITH {BARS}{FL}, {_long(list(factors.FACTORS))}, {_DIC}, dd AS (SELECT DISTINCT date FROM p WHERE fwd IS NOT NULL ORDER BY date DESC LIMIT 60),
  g AS (SELECT factor_name, coalesce(avg(ic), 0) AS ic, coalesce(avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(ic)), 0) AS icir FROM ic WHERE date IN (FROM dd) GROUP BY 1)
  SELECT CASE WHEN round(ic, 9) >= 0.02 THEN 'effective' WHEN round(ic, 9) >= 0.01 THEN 'decaying' ELSE 'failed' END AS status, count(*) AS n, round(avg(icir), 5) + 0.0 AS avg_icir FROM g GROUP BY 1""")
def factor_health_summary(s, d):
    p, f = _forked(s, d, tuple(factors.FACTORS))
    return crosssec.health_summary(crosssec.factor_health(p, f)).withColumn("avg_icir", F.round("avg_icir", 5) + 0.0)


def _models(s, d):
    """Predictions over one bar by two models: momentum and least squares."""
    p = panel(s, d)
    one = crosssec.baseline(p, (1,)).where("ret_pred IS NOT NULL").select(F.lit("momentum").alias("model"), "date", "code", F.signum(F.round("ret_pred", 9)).cast("int").alias("dir_pred"))
    targets = p.select("code", "date", F.lit(1).alias("horizon"))
    two = predictors.predict_targets(p.select("code", "date", "adj"), targets, predictors.LeastSquares)
    return one.unionByName(two.select(F.lit("least_squares").alias("model"), "date", "code", F.signum(F.round("ret_pred", 9)).cast("int").alias("dir_pred")))


_MODELS = f"{_BASE}, q AS ({_ls(1)}), mo AS (SELECT 'momentum' AS model, date, code, CAST(sign(round(ret_pred, 9)) AS INTEGER) AS dir_pred FROM pr WHERE horizon = 1 AND ret_pred IS NOT NULL UNION ALL SELECT 'least_squares', date, code, CAST(sign(round(base + slope * x, 9)) AS INTEGER) FROM q WHERE bars >= 30 AND n >= 20 AND x IS NOT NULL AND slope IS NOT NULL)"


@query(f"WITH {BARS}, {_MODELS}, la AS (SELECT model, max(date) AS last, count(DISTINCT code) AS codes FROM mo GROUP BY 1) SELECT model, codes, last, count(*) FILTER (date = last) AS latest, count(*) FILTER (date = last AND dir_pred > 0) AS up FROM mo JOIN la USING (model) GROUP BY 1, 2, 3")
def model_status(s, d):
    return crosssec.model_summary(_models(s, d))


@query(f"WITH {BARS}, {_MODELS}, v AS (SELECT date, code, sum(dir_pred * w) / sum(w) AS raw FROM (SELECT *, CASE model WHEN 'momentum' THEN 0.25 ELSE 0.1 END AS w FROM mo) GROUP BY 1, 2) SELECT date, code, round(coalesce((raw - avg(raw) OVER x) / nullif(stddev_pop(raw) OVER x, 0), 0), 6) + 0.0 AS vote FROM v WINDOW x AS (PARTITION BY date)")
def model_vote(s, d):
    w = F.when(F.col("model") == "momentum", 0.25).otherwise(0.1)
    return r6(models.predict_vote(_models(s, d).select("date", "code", F.col("dir_pred").alias("dir"), w.alias("weight"))))


@query(f"""WITH {_ALL}, {_FX}, fr AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY direction * confidence DESC, code) AS hi, row_number() OVER (PARTITION BY date ORDER BY direction * confidence, code) AS lo, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY date))) AS k FROM fx),
  bk AS (SELECT date, code, CASE WHEN lo <= k THEN -1.0 / k ELSE 1.0 / k END AS weight FROM fr WHERE lo <= k OR hi <= k), {_FULL}, {_sim('SELECT DISTINCT date FROM bk')} {_RUN_OUT}""")
def bt_fused_ls(s, d):
    p = panel(s, d)
    book = backtest.score_book(crosssec.fuse(p))
    return r6(backtest.simulate(backtest.full(backtest.tradable(book, p)), p, calendar=book))


@query(bars_sql("SELECT date, code, round(vol / sum(vol) OVER (PARTITION BY date), 6) AS share FROM p"))
def group_share(s, d):
    return r6(group_transform(panel(s, d), ["date"], "vol", lambda x, w: x / F.sum(x).over(w), "share").select("date", "code", "share"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-03'")
def point_load(s, d):
    o = table(s, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return tables.load_at(o, o_orderpriority="1-URGENT").unionByName(tables.load_at(o, at="1997-03-03")).select("o_orderkey", "o_totalprice")


# All six sentiment components and all dimensions of the index that the tables have


_SKEW = "CASE WHEN count(ret) OVER r20 = 20 THEN skewness(ret) OVER r20 END"


@query(bars_sql(f" SELECT date, code, round(coalesce({_SKEW}, 0), 6) AS return_skew FROM p WINDOW r20 AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)"))
def sent_return_skew(s, d):
    return r6(factors.sentiment_components(panel(s, d), names=("return_skew",)))


@query(_SENT_OUT, "sent_components_full")
def _components_full(s, d):
    return sent_components(s, d)


@query(ORACLES["sent_score"], "sent_score_full")
def _score_full(s, d):
    return sent_score(s, d)


@query(ORACLES["fusion_signals"], "fusion_signals_full")
def _fusion_full(s, d):
    return fusion_signals(s, d)


_FEEDS = """fm0 AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS a, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS b, avg(o_totalprice) / 1000 AS pe FROM orders GROUP BY 1),
  fm AS (SELECT date, round(((a - avg(a) OVER w) / (stddev_samp(a) OVER w + 1e-9) + (b - avg(b) OVER w) / (stddev_samp(b) OVER w + 1e-9)) / 2, 5) AS money FROM fm0 WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
  fy AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_tax) AS y FROM lineitem GROUP BY 1), fp AS (SELECT date, round(1 / pe - y, 6) AS premium FROM fm0 JOIN fy USING (date)),
  fv AS (SELECT date, round(-pe, 6) AS valuation FROM fm0)"""
_SUBS = {"sub_volume": (0.25, "volume_dim", "v"), "sub_price": (0.25, "price_dim", "v"), "sub_money": (0.2, "money", "fm"), "sub_valuation": (0.15, "valuation", "fv"), "sub_riskpremium": (0.15, "premium", "fp")}


def _index_sql(subs: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN (SELECT date, pct AS {k} FROM {_pct(*_SUBS[k][1:])}) USING (date)" for k in subs)
    total, weight = (" + ".join(f"CASE WHEN {k} IS NOT NULL THEN {f(k)} ELSE 0 END" for k in subs) for f in (lambda k: f"{_SUBS[k][0]} * {k}", lambda k: str(_SUBS[k][0])))
    return f"""WITH {BARS}, {_BREADTH}, {_FEEDS}, e AS (SELECT date, avg(adj) AS level FROM p GROUP BY 1), t AS (SELECT date, level, CASE WHEN count(*) OVER w = 20 THEN max(level) OVER w END AS top FROM e WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
  i AS (SELECT date, {', '.join(subs)}, (level - top) / top AS drawdown, round(coalesce(({total}) / nullif({weight}, 0), 50), 6) AS index_value FROM v LEFT JOIN t USING (date) {joins}),
  si AS (SELECT *, CASE WHEN index_value <= 30 THEN 'fear' WHEN index_value >= 70 THEN 'greed' ELSE 'neutral' END AS thermometer, CASE WHEN index_value <= 10 THEN 'buy' WHEN index_value >= 90 THEN 'out' ELSE 'half' END AS signal FROM i)
  SELECT date, {', '.join(f'round({k}, 6) AS {k}' for k in subs)}, round(drawdown, 6) + 0.0 AS drawdown, index_value, thermometer, CASE WHEN round(drawdown, 9) <= -0.15 THEN 'panic' WHEN round(drawdown, 9) <= -0.08 THEN 'bear' WHEN thermometer = 'greed' AND round(drawdown, 9) > -0.05 THEN 'bull' ELSE 'neutral' END AS regime_state, signal FROM si"""


@query(_index_sql(["sub_volume", "sub_price", "sub_money", "sub_riskpremium"]))
def sentiment_index_full(s, d):
    return r6(market.sentiment_index(panel(s, d), money=ms_money(s, d), riskpremium=ms_riskpremium(s, d)))


@query(_index_sql(list(_SUBS)))
def sentiment_index_five(s, d):
    """All five dimensions; the price-earnings ratio stands for the valuation, dear markets low."""
    week = F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")
    pe = table(s, d, "orders").groupBy(week).agg(F.round(-F.avg("o_totalprice") / 1000, 6).alias("valuation"))
    return r6(market.sentiment_index(panel(s, d), money=ms_money(s, d), valuation=pe, riskpremium=ms_riskpremium(s, d)))


# Scalars, logs, catalog, feeds and the landing zone


@query("""SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 0 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) END::TIMESTAMP AS parsed FROM events""")
def scalar_times(s, d):
    k = F.col("event_id") % 7
    text = F.lit("soon")
    for i, form in enumerate(tolerant.TIME_FORMATS):
        text = F.when(k == i, F.concat(F.lit(" "), F.date_format("ts", form))).otherwise(text)
    return table(s, d, "events").select("event_id", tolerant.parse_time(text).cast("timestamp_ntz").alias("parsed"))


@query(r"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '-?\d+(?:\.\d+)?'), lambda x: TRY_CAST(x AS DOUBLE)), lambda v: v >= -1 AND v <= 1)[1] AS number FROM documents")
def scalar_numbers(s, d):
    return table(s, d, "documents").select("doc_id", tolerant.unit_number("text").alias("number"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) END AS date, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def scalar_codes(s, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    text = F.when(F.col("c_custkey") % 3 == 0, "next week").otherwise(F.concat(day.cast("string"), F.lit("T09:30:00+08:00")))
    wild = F.when(F.col("c_custkey") % 5 == 0, float("nan")).when(F.col("c_custkey") % 5 == 1, float("-inf")).otherwise(F.col("c_acctbal"))
    code = tolerant.zfill(tolerant.head(F.concat(F.col("c_custkey").cast("string"), F.lit(".SH"))))
    return table(s, d, "customer").select("c_custkey", code.alias("code"), tolerant.iso_date(text).alias("date"), tolerant.finite(wild).alias("balance"))


def _event_log(s, d):
    """Events as a log; lines whose number is divisible by 97 are torn."""
    path = f"{_shared(s)}/log"
    line = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "event_type"))
    line = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 40)).otherwise(line)
    table(s, d, "events").select(line.alias("value")).write.mode("append").text(path)
    return logs.read_log(s, path, "event_id long, ts timestamp_ntz, event_type string")


@query("SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(ts AS DATE) END AS date, count(*) FILTER (event_id % 97 <> 0) AS lines, count(*) FILTER (event_id % 97 = 0) AS broken FROM events GROUP BY 1")
def log_counts(s, d):
    return logs.log_counts(_event_log(s, d), "ts")


@query("SELECT event_id, event_type FROM events WHERE event_id % 97 <> 0 ORDER BY ts DESC, event_id LIMIT 50")
def log_newest(s, d):
    return logs.newest(_event_log(s, d), "ts", 50, "event_id").select("event_id", "event_type")


@query(f"WITH {BARS}, {_TWO}, g AS (SELECT date, round(abs(a.close - b.close) / a.close, 9) AS diff FROM a JOIN b USING (code, date)) SELECT date, count(*) AS n, round(max(diff), 6) AS largest FROM g WHERE diff > 0.03 GROUP BY 1")
def divergence_log(s, d):
    path = f"{_shared(s)}/divergence"
    logs.append_log(tables.divergence(*_two(s, d)), path)
    log = logs.read_log(s, path, "code string, date date, price_a double, price_b double, diff double")
    return r6(logs.divergence_counts(log))


@query(f"WITH {BARS}, {_TWO} SELECT code, date, coalesce(a.source, b.source) || CASE WHEN round(abs(a.close - b.close) / a.close, 9) > 0.03 THEN '_suspect' ELSE '' END AS source FROM a FULL JOIN b USING (code, date)")
def source_suspects(s, d):
    a, b = _two(s, d)
    first = tables.first_source(a.unionByName(b), F.when(F.col("source") == "first", 0).otherwise(1))
    return logs.tag_suspects(first, tables.divergence(a, b)).select("code", "date", "source")


_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
_DATED = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = '{n}') AS columns, {f'CAST(max({_DATED[n]}) AS DATE)' if n in _DATED else 'CAST(NULL AS DATE)'} AS last FROM {n}" for n in _TABLES))
def catalog_tables(s, d):
    for n in _TABLES:
        table(s, d, n).createOrReplaceTempView(f"loom_catalog_{n}")
    names = [n for n in catalog.list_tables(s) if n.startswith("loom_catalog_")]
    return catalog.describe_tables(s, names).withColumn("name", F.substring("name", len("loom_catalog_") + 1, 99))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 100000 AND o_orderdate >= DATE '1996-01-01'")
def sql_params(s, d):
    text = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderpriority = :priority AND o_totalprice >= :least AND o_orderdate >= :since"
    return catalog.read_sql(s, text, {"orders": table(s, d, "orders")}, priority="2-HIGH", least=100000.0, since=datetime.date(1996, 1, 1))


_FEED = "{n} AS (SELECT {on}::DATE AS date, arg_max({v}, {o}) AS {n} FROM {t} GROUP BY 1)"
_THREE = ", ".join(_FEED.format(n=n, on=on, v=v, o=o, t=t) for n, on, v, o, t in (("urgent", "o_orderdate", "o_totalprice", "o_orderkey", "(FROM orders WHERE o_orderpriority = '1-URGENT')"), ("open", "o_orderdate", "o_totalprice", "o_orderkey", "(FROM orders WHERE o_orderstatus = 'O')"), ("shipped", "l_shipdate", "l_extendedprice", "l_orderkey * 10 + l_linenumber", "lineitem")))


def _feeds(s, d):
    o = table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"), "o_orderpriority", "o_orderstatus")
    line = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return {"urgent": o.where("o_orderpriority = '1-URGENT'"), "open": o.where("o_orderstatus = 'O'"), "shipped": line}


@query(f"WITH {_THREE} SELECT date, coalesce(urgent, 0) AS urgent, coalesce(open, 0) AS open, coalesce(shipped, 0) AS shipped FROM urgent FULL JOIN open USING (date) FULL JOIN shipped USING (date)")
def feeds_outer(s, d):
    return feeds.join_feeds(_feeds(s, d))


@query(f"WITH {_THREE} SELECT date, round(1 / urgent - shipped / 1e9, 9) AS premium FROM urgent JOIN shipped USING (date)")
def premium_last(s, d):
    f = _feeds(s, d)
    pe = feeds.keep_last(f["urgent"].select("date", F.col("value").alias("pe"), "seq"), "seq").select("date", "pe")
    bond = feeds.keep_last(f["shipped"].select("date", (F.col("value") / 1e9).alias("yield_10y"), "seq"), "seq").select("date", "yield_10y")
    return market.risk_premium(pe, bond).select("date", F.round("premium", 9).alias("premium"))


def _landed(s, d, path: str, parts: int = 3):
    """Raw bars dropped into a folder in `parts` lots, the oldest dates last; amounts of Fridays' weeks are missing."""
    bars = raw_bars(s, d).select("code", "date", "open", "high", "low", "close", (F.col("vol") * 100).alias("shares"), F.when(F.dayofmonth("date") % 13 != 0, F.col("amount")).alias("amount"))
    bars.write.parquet(f"{path}-all")
    bars = s.read.parquet(f"{path}-all").withColumn("lot", F.ntile(parts).over(Window.orderBy(F.desc("date"), "code")))
    return [bars.where(F.col("lot") == i + 1).drop("lot") for i in range(parts)]


_LANDED = "SELECT code, date, round(ln(close), 6) AS ln_close, round(vol, 6) AS vol, round(CASE WHEN day(date) % 13 <> 0 THEN amount ELSE 0 END, 4) AS amount"


@query(bars_sql(f"{_LANDED}, round(coalesce(ln(lag(close) OVER (PARTITION BY code ORDER BY date)), 0), 6) AS ln_pre FROM raw WHERE date >= DATE '1996-01-01' - 15 QUALIFY date >= DATE '1996-01-01'"))
def landing_bars(s, d):
    path = f"{_shared(s)}/landing"
    for part in _landed(s, d, path):
        part.write.mode("append").parquet(path)
    b = landing.fetch_bars(s, path, start=datetime.date(1996, 1, 1))
    return b.select("code", "date", F.round(F.ln("close"), 6).alias("ln_close"), F.round("vol", 6).alias("vol"), F.round("amount", 4).alias("amount"), F.round(F.when(F.col("pre_close") > 0, F.ln("pre_close")).otherwise(0.0), 6).alias("ln_pre"))


@query(bars_sql(f"{_LANDED} FROM raw"))
def landing_stream(s, d):
    folder = _shared(s)
    path, out = f"{folder}/landing", f"{folder}/bars"
    first, second, late = _landed(s, d, path)
    first.write.mode("append").parquet(path)
    q = landing.stream_bars(s, path).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", out).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        second.write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    late.write.mode("append").parquet(path)  # arrives while the stream is down
    q = landing.stream_bars(s, path).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", out).trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return s.read.parquet(out).select("code", "date", F.round(F.ln("close"), 6).alias("ln_close"), F.round("vol", 6).alias("vol"), F.round("amount", 4).alias("amount"))


def _raw_signals(s, d):
    """Model outputs as texts, of five kinds: lists, texts with commas, wrong values, no JSON, nothing."""
    u, k = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.col("event_id") % 5
    num = (F.round(F.col("value") / 50 - 1, 4)).cast("string")
    raw = F.when(k == 0, F.format_string('{"sentiment": "positive", "sentiment_score": %s, "impact": "high", "impact_score": "0.456", "related_codes": ["%s", " u1 ", "zz"], "related_sectors": "a, b ,"}', num, u))
    raw = raw.when(k == 1, F.format_string('{"sentiment": " negative ", "sentiment_score": "%s", "impact": "medium", "impact_score": 3, "related_codes": "%s, u9,,u2", "related_sectors": ["x"]}', num, u))
    raw = raw.when(k == 2, F.lit('{"sentiment": 7, "sentiment_score": [1], "impact": null, "impact_score": "much", "related_codes": {"a": 1}}')).when(k == 3, F.lit('well, {"sentiment": "positive"'))
    return table(s, d, "events").select("event_id", F.array(F.concat(F.lit("u"), (F.col("event_id") % 10).cast("string"))).alias("own"), raw.alias("raw"))


@query("""WITH e AS (SELECT event_id, event_id % 5 AS k, 'u' || user_id % 10 AS u, 'u' || event_id % 10 AS own, CAST(round(CAST(greatest(least(round(value / 50 - 1, 4), 1), -1) AS DECIMAL(10, 4)), 2) AS DOUBLE) + 0.0 AS score FROM events), pool AS (SELECT DISTINCT 'u' || user_id % 8 AS code FROM events),
  c AS (SELECT *, CASE k WHEN 0 THEN [u, 'u1', 'zz'] WHEN 1 THEN [u, 'u9', 'u2'] ELSE [] END AS named FROM e), f AS (SELECT *, list_filter(named, lambda x: list_contains(pl, x)) AS kept FROM c, (SELECT list(code) AS pl FROM pool))
  SELECT event_id, k < 3 AS readable, CASE k WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN k < 2 THEN score ELSE 0 END AS sentiment_score, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact,
    CASE k WHEN 0 THEN 0.46 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS impact_score, CASE k WHEN 0 THEN 'a,b' WHEN 1 THEN 'x' ELSE '' END AS sectors, array_to_string(CASE WHEN list_contains(kept, own) THEN kept ELSE list_append(kept, own) END, ',') AS codes FROM f""")
def signal_parse(s, d):
    pool = table(s, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("code")).distinct()
    out = signals.allowed_codes(signals.parse_signals(_raw_signals(s, d)), pool, "event_id", "own")
    return out.select("event_id", "readable", "sentiment", (F.col("sentiment_score") + 0.0).alias("sentiment_score"), "impact", "impact_score", F.array_join("sectors", ",").alias("sectors"), F.array_join("codes", ",").alias("codes"))


# Texts and events


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_exact(s, d):
    return hotspot.dedup_exact(table(s, d, "documents").select("doc_id", "source", "text"), "text", ("doc_id",)).select("doc_id", "source")


@query()
def simhash(s, d):
    return table(s, d, "documents").select("doc_id", hotspot.simhash(F.col("text")).alias("print"))


def _titles(s, d):
    """page_id and the fingerprint of each page's title."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(s, d, "pages").select("page_id", hotspot.simhash(title).alias("print"))


@query()
def dedup_near(s, d):
    return hotspot.dedup_near(_titles(s, d), "page_id", "print")


@query()
def stream_near(s, d):
    folder = _shared(s)
    titles = _titles(s, d)
    titles.write.parquet(f"{folder}/titles")
    titles = s.read.parquet(f"{folder}/titles")
    low, high, n = titles.agg(F.min("page_id"), F.max("page_id"), F.count("*")).first()
    edges = [(low or 0) + ((high or 0) - (low or 0) + 1) * i // 4 for i in range(5)]
    for i in range(4):  # items arrive in order of their ids, a file after the other
        titles.where((F.col("page_id") >= edges[i]) & (F.col("page_id") < edges[i + 1])).coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    items = s.readStream.schema(titles.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    return near.run_near(items, "page_id", "print", f"{folder}/near", groups=min(max(4, n // 1024), 1 << 16)).select(F.col("k").alias("page_id"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(*) FILTER (value > 50) AS positive, count(*) FILTER (value < 50) AS negative, count(*) FILTER (value = 50) AS neutral, round(avg(value - 50), 6) AS avg_score FROM events GROUP BY 1")
def hotspot_daily_stats(s, d):
    return r6(hotspot.daily_stats(table(s, d, "events").select("ts", (F.col("value") - 50).alias("score"))))


@query("SELECT code, round(sum(score * w) / sum(w), 6) AS score, count(*) AS n FROM (SELECT unnest(list_distinct(['u' || user_id % 10, event_type])) AS code, value AS score, CASE WHEN CAST(props->>'k' AS INT) % 5 = 0 THEN 0.1 ELSE CAST(props->>'k' AS INT) % 5 END AS w FROM events) GROUP BY 1")
def hotspot_by_code_score(s, d):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    e = table(s, d, "events").select(F.array(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.col("event_type")).alias("codes"), F.col("value").alias("score"), k.cast("double").alias("impact"))
    return r6(hotspot.by_code(e))


@query("SELECT event_id, event_type FROM events WHERE list_contains(string_split(event_type || ',u' || user_id % 10, ','), 'u3') ORDER BY ts DESC, event_id LIMIT 100")
def hotspot_by_code(s, d):
    e = table(s, d, "events").withColumn("codes", F.concat_ws(",", "event_type", F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))))
    return e.where(F.array_contains(F.split("codes", ","), "u3")).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type")


@query("SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events")
def json_signal_parse(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_1d(s, d):
    e = events.tumbling(table(s, d, "events"))
    return e.select(F.to_date("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, g")
def sessions_30m(s, d):
    return events.sessions(table(s, d, "events")).select("user_id", "start", "n")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest(list_transform([0, 1, 2, 3], lambda i: time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE)) AS start, event_type FROM events) GROUP BY 1, 2")
def sliding_1h(s, d):
    return events.sliding(table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _stream(s, d, f: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    e = table(s, d, "events")
    src = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"loom_{abs(hash((f.__name__, d)))}"
    events.run_once(f(src.withColumn("ts", F.col("ts").cast("timestamp"))), name, mode)
    return s.table(name)


@query("SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    out = _stream(s, d, events.tumbling, "complete")
    return out.select(F.to_date("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(s, d):
    def first(e: DataFrame) -> DataFrame:
        return events.distinct_within(e.select("user_id", "ts"), ["user_id"], delay="90 days")

    return _stream(s, d, first).select("user_id")


@query("SELECT event_id % 50 AS k, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_ingest(s, d):
    e = table(s, d, "events")
    src = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = f"{_shared(s)}/upsert"
    keyed = src.select((F.col("event_id") % 50).alias("k"), "event_id", F.col("event_id").alias("ts"))
    q = keyed.writeStream.foreachBatch(events.upsert_to(at, ("k",))).option("checkpointLocation", f"{at}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/v{events.versions(s, at)[-1]}").select("k", "event_id")


def _shared(s: SparkSession) -> str:
    """A new folder in the shared one that the session names; a temporary one only where it names none."""
    import uuid

    at = s.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="marketloom-")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"

"""Prices, call scoring, the factor panel, the strategy lab and the paper ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import stats as ST
from ..operators import asof as P
from ..operators import dedupe as D
from ..operators import lab as L
from ..operators import panel as W
from ..operators import reports as R
from ..operators import sentiment as S
from ..session import cut_lineage
from ..sources import tables as T
from .core import NOW_CALLS, Inputs, day_text, joined, moment, query, rounded, ts_text

NOW_SQL = f"TIMESTAMP '{NOW_CALLS}'"
_D = "CAST({c} AS VARCHAR)"


def NOW():
    return moment(NOW_CALLS)


# ---------------------------------------------------------------- bars

@query("merge_prices", "SELECT CAST(date AS VARCHAR) AS date, symbol, CASE WHEN symbol IN ('B1', 'B2') THEN close * 2 ELSE close END AS close FROM {fx_bars}")
def _(i: Inputs):
    b = i["fx_bars"]
    m = T.merge_prices(b, b.where("symbol IN ('B1', 'B2')").withColumn("close", F.col("close") * 2))
    return m.select(day_text("date").alias("date"), "symbol", "close")


@query("candles", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber), 2) AS open,
  round(arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber), 2) AS close FROM lineitem WHERE l_partkey % 25 = 4 GROUP BY 1 HAVING count(*) > 1""")
def _(i: Inputs):
    k = F.struct("l_orderkey", "l_linenumber")
    o = i["lineitem"].groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("B"), (F.col("l_partkey") % 25).cast("string")).alias("symbol")).agg(
        F.when(F.count("*") > 1, F.min_by("l_extendedprice", k)).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", k).alias("close"))
    return T.candles(o, "B4").withColumn("date", day_text("date"))


_CHG = """x AS (SELECT symbol, date, close, {lags}, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM {{fx_bars}} WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("market_snapshot", "WITH " + _CHG.format(lags=", ".join(f"lag(close, {n}) OVER w AS c{n}" for n in (1, 5, 20))).replace("{{", "{").replace("}}", "}") +
       " SELECT symbol, round(close, 2) AS last, " + ", ".join(f"round((close / c{n} - 1) * 100, 2) AS pct_{n}" for n in (1, 5, 20)) + ", CAST(date AS VARCHAR) AS asof FROM x WHERE d = 1 AND n >= 6")
def _(i: Inputs):
    return S.market_snapshot(i["fx_bars"]).withColumn("asof", day_text("asof"))


@query("sparkline", """SELECT symbol, count(*) AS n, arg_max(close, date) AS price, round(arg_max(close, date) - arg_max(prev, date), 6) AS change, round(arg_max(close / prev - 1, date) * 100, 6) AS change_percent,
  arg_min(close, date) AS first FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM {fx_bars}) GROUP BY symbol""")
def _(i: Inputs):
    s = S.sparkline(i["fx_bars"])
    return s.select("symbol", F.size("spark").alias("n"), "price", *[rounded(c).alias(c) for c in ("change", "change_percent")], F.element_at("spark", 1).alias("first"))


# ---------------------------------------------------------------- as-of and call scoring

_ASOF = "{a} ASOF LEFT JOIN (SELECT symbol AS s, date AS bd, close AS c FROM {{fx_bars}}) ON {sym} = s AND {day} >= bd"


@query("asof_close", """SELECT id, CASE WHEN date_diff('day', bd, day) <= 6 THEN c END AS close, CASE WHEN date_diff('day', bd, day) <= 6 THEN CAST(bd AS VARCHAR) END AS bar_date
FROM (SELECT id, symbol, CAST(created_at AS DATE) AS day FROM {fx_calls}) p ASOF LEFT JOIN (SELECT symbol AS s, date AS bd, close AS c FROM {fx_bars}) b ON p.symbol = b.s AND p.day >= b.bd""")
def _(i: Inputs):
    p = i["fx_calls"].select("id", "symbol", F.to_date("created_at").alias("day"))
    return P.asof_close(p, i["fx_bars"]).select("id", "close", day_text("close_date").alias("bar_date"))


_WIN = f"""cc AS (SELECT *, coalesce(nullif(horizon_days, 0), 5) AS h, CAST(CAST(created_at AS DATE) - CASE WHEN hour(created_at) >= 21 THEN 0 ELSE 1 END AS DATE) AS ed FROM {{src}}),
 ca AS (SELECT cc.*, CAST(ed + CAST(h AS INT) AS DATE) AS xd FROM cc), bb AS (SELECT symbol AS s, date AS bd, close AS c FROM {{{{fx_bars}}}}), be AS (SELECT date AS bd, close AS c FROM {{{{fx_bench}}}}),
 c1 AS (SELECT ca.*, b.c AS p0, b.bd AS d0 FROM ca ASOF LEFT JOIN bb b ON ca.symbol = b.s AND ca.ed >= b.bd), c2 AS (SELECT c1.*, b.c AS p1, b.bd AS d1 FROM c1 ASOF LEFT JOIN bb b ON c1.symbol = b.s AND c1.xd >= b.bd),
 c3 AS (SELECT c2.*, b.c AS q0, b.bd AS e0 FROM c2 ASOF LEFT JOIN be b ON c2.ed >= b.bd), c4 AS (SELECT c3.*, b.c AS q1 FROM c3 ASOF LEFT JOIN be b ON c3.xd >= b.bd),
 wr AS (SELECT *, CASE WHEN xd < DATE '{NOW_CALLS[:10]}' AND p1 IS NOT NULL AND date_diff('day', d0, ed) <= 6 THEN coalesce(nullif(entry_price, 0), p0) END AS entry_px,
   CASE WHEN xd < DATE '{NOW_CALLS[:10]}' AND q1 IS NOT NULL AND date_diff('day', e0, ed) <= 6 THEN (q1 - q0) / q0 * 100 END AS bench FROM c4),
 sc AS (SELECT *, (p1 - entry_px) / entry_px * 100 AS ret FROM wr),
 vd AS (SELECT *, CASE WHEN ret IS NULL THEN NULL WHEN call = 'neutral' OR abs(ret) < 0.5 THEN 'unclear' WHEN (ret > 0 AND call = 'bullish') OR (ret < 0 AND call = 'bearish') THEN 'correct' ELSE 'incorrect' END AS verdict FROM sc)"""


def win(src: str) -> str:
    return _WIN.format(src=src).replace("{{", "{").replace("}}", "}")


@query("window_return", f"WITH {win('{fx_calls}')} SELECT id, entry_px, CASE WHEN ret IS NOT NULL THEN p1 END AS exit_px, round(ret, 6) AS return_pct, CASE WHEN ret IS NOT NULL THEN CAST(d1 AS VARCHAR) END AS exit_date FROM sc")
def _(i: Inputs):
    w = P.window_return(i["fx_calls"], i["fx_bars"], NOW())
    return w.select("id", "entry_px", "exit_px", rounded("return_pct").alias("return_pct"), day_text("exit_date").alias("exit_date"))


def _bench(i: Inputs):
    return i["fx_bench"]


@query("benchmark_return", f"WITH {win('{fx_calls}')} SELECT id, round(CASE WHEN symbol IN ('B1', 'B2', 'B3') THEN bench END, 6) AS benchmark_pct FROM sc")
def _(i: Inputs):
    b = P.benchmark_return(i["fx_calls"], _bench(i), NOW(), ["B1", "B2", "B3"])
    return b.select("id", rounded("benchmark_pct").alias("benchmark_pct"))


_THEME = "CASE WHEN length(symbol) > 0 THEN trim(symbol) " + " ".join(f"WHEN contains(lower(ticker_or_theme), '{k}') THEN '{s}'" for k, s in K.THEME_SYMBOLS) + " END"
_THEMED = f"(SELECT * EXCLUDE (symbol), {_THEME} AS symbol FROM {{fx_calls}})"
_OPEN = f"(SELECT * FROM {_THEMED} WHERE outcome IS NULL)"
_STOCKS = [f"B{n}" for n in range(10)]
_STOCK = "symbol IN (" + ", ".join(f"'{s}'" for s in _STOCKS) + ")"


@query("check_outcomes", f"""WITH {win(_OPEN)}, x AS (SELECT *, CASE WHEN {_STOCK} THEN bench END AS b FROM vd) SELECT id, verdict AS outcome, p1 AS exit_price, round(ret, 3) AS asset_return_pct, round(b, 3) AS benchmark_return_pct, round(ret - b, 3) AS excess_return_pct FROM x WHERE verdict IS NOT NULL""")
def _(i: Inputs):
    c = P.check_outcomes(i["fx_calls"], i["fx_bars"], _bench(i), NOW(), stocks=_STOCKS)
    return c.select("id", "outcome", "exit_price", "asset_return_pct", "benchmark_return_pct", "excess_return_pct")


@query("apply_outcomes", f"""WITH {win(_OPEN)} SELECT c.id, coalesce(vd.verdict, c.outcome) AS outcome FROM {{fx_calls}} c LEFT JOIN vd ON c.id = vd.id""")
def _(i: Inputs):
    return P.apply_outcomes(i["fx_calls"], P.check_outcomes(i["fx_calls"], i["fx_bars"], _bench(i), NOW())).select("id", "outcome")


@query("unscored_calls_report", f"WITH {win(_OPEN)} SELECT count(*) FILTER (WHERE ret IS NOT NULL) AS checked, count(*) FILTER (WHERE ret IS NULL AND symbol IS NOT NULL) AS skipped, count(*) FILTER (WHERE symbol IS NULL) AS unmapped FROM sc")
def _(i: Inputs):
    return P.unscored_calls_report(i["fx_calls"], i["fx_bars"], NOW())


@query("log_calls", f"""WITH n AS (SELECT *, CASE WHEN symbol IS NOT NULL THEN symbol WHEN contains(lower(ticker_or_theme), 'oil') THEN 'CL=F' WHEN contains(lower(ticker_or_theme), 'yield') THEN '^TNX' WHEN contains(lower(ticker_or_theme), 'gold') THEN 'GC=F' END AS rs FROM {{fx_calls}} WHERE outcome IS NULL),
 l AS (SELECT symbol, arg_max(close, date) AS px FROM {{fx_bars}} WHERE date >= DATE '{NOW_CALLS[:10]}' - 7 GROUP BY symbol)
SELECT id, symbol, entry_price FROM {{fx_calls}} WHERE outcome IS NOT NULL UNION ALL SELECT id, rs AS symbol, px AS entry_price FROM n LEFT JOIN l ON n.rs = l.symbol""")
def _(i: Inputs):
    c = i["fx_calls"]
    return P.log_calls(c.where("outcome IS NOT NULL"), c.where("outcome IS NULL"), i["fx_bars"], NOW()).select("id", "symbol", "entry_price")


@query("latest_close", "SELECT symbol, CAST(max(date) AS VARCHAR) AS date, arg_max(close, date) AS close FROM {fx_bars} GROUP BY symbol")
def _(i: Inputs):
    return P.latest_close(i["fx_bars"]).select("symbol", day_text("date").alias("date"), "close")


@query("forward_returns", "SELECT symbol, CAST(date AS VARCHAR) AS date, " + ", ".join(f"round((lead(close, {h}) OVER w / close - 1) * 100, 6) AS r{h}" for h in (1, 3, 5)) + " FROM {fx_bars} WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def _(i: Inputs):
    f = P.forward_returns(i["fx_bars"])
    return f.select("symbol", day_text("date").alias("date"), *[rounded(f"r{h}").alias(f"r{h}") for h in (1, 3, 5)])


@query("calendar_prices", """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM {fx_bench}), p AS (SELECT p_partkey AS id, CONCAT('B', p_partkey % 25) AS symbol, CAST(DATE '1996-01-01' + CAST(p_partkey % 900 AS INT) AS DATE) AS d FROM part),
 q AS (SELECT p.*, (SELECT min(i) FROM cal WHERE cal.date > p.d) AS i FROM p)
SELECT q.id, CAST(e.date AS VARCHAR) AS entry_date, b1.close AS entry_px, CAST(x.date AS VARCHAR) AS exit_date, b2.close AS exit_px FROM q LEFT JOIN cal e ON e.i = q.i LEFT JOIN cal x ON x.i = q.i + 5
 LEFT JOIN {fx_bars} b1 ON b1.symbol = q.symbol AND b1.date = e.date LEFT JOIN {fx_bars} b2 ON b2.symbol = q.symbol AND b2.date = x.date""")
def _(i: Inputs):
    p = i["part"].select(F.col("p_partkey").alias("id"), F.concat(F.lit("B"), (F.col("p_partkey") % 25).cast("string")).alias("symbol"),
                         F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("signal_date"))
    c = P.calendar_prices(p, i["fx_bars"], i["fx_bench"], 5)
    return c.select("id", day_text("entry_date").alias("entry_date"), "entry_px", day_text("exit_date").alias("exit_date"), "exit_px")


# ---------------------------------------------------------------- track record

@query("hit_rate_running", """SELECT count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect, count(*) FILTER (WHERE outcome = 'unclear') AS unclear, count(*) FILTER (WHERE outcome IS NULL) AS pending,
 round(count(*) FILTER (WHERE outcome = 'correct') * 100.0::DOUBLE / count(*) FILTER (WHERE outcome IN ('correct', 'incorrect')), 6) AS hit_rate_pct FROM {fx_calls}""")
def _(i: Inputs):
    return R.hit_rate_running(i["fx_calls"]).withColumn("hit_rate_pct", rounded(F.col("hit_rate_pct").cast("double")))


@query("calibrate_confidence", """SELECT bucket, count(*) AS total, count(*) FILTER (WHERE outcome = 'correct') AS correct, round(count(*) FILTER (WHERE outcome = 'correct') / count(*) * 100, 6) AS hit_rate_pct FROM
 (SELECT outcome, CASE WHEN confidence IS NULL THEN 'Unknown' WHEN confidence < 40 THEN 'Low (0-39)' WHEN confidence < 70 THEN 'Medium (40-69)' ELSE 'High (70-100)' END AS bucket FROM {fx_calls} WHERE outcome IN ('correct', 'incorrect')) GROUP BY bucket""")
def _(i: Inputs):
    return R.calibrate_confidence(i["fx_calls"]).withColumn("hit_rate_pct", rounded("hit_rate_pct"))


@query("hit_rate_by_theme", "SELECT ticker_or_theme AS theme, count(*) AS total, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'incorrect') AS incorrect FROM {fx_calls} WHERE outcome IN ('correct', 'incorrect') GROUP BY 1")
def _(i: Inputs):
    return R.hit_rate_by_theme(i["fx_calls"])


@query("wilson", """WITH g AS (SELECT ticker_or_theme AS theme, count(*) AS n, count(*) FILTER (WHERE outcome = 'correct') AS k FROM {fx_calls} GROUP BY 1), p AS (SELECT *, k / n AS p, 1 + 1.96 * 1.96 / n AS d FROM g)
SELECT theme, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / d, 6) AS lo, round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / d, 6) AS hi FROM p""")
def _(i: Inputs):
    g = i["fx_calls"].groupBy(F.col("ticker_or_theme").alias("theme")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "correct").alias("k"))
    return g.select("theme", ST.wilson(F.col("k"), F.col("n")).alias("w")).select("theme", rounded("w.lo").alias("lo"), rounded("w.hi").alias("hi"))


_DEDUP = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(symbol, ticker_or_theme), call, CAST(created_at AS DATE) ORDER BY created_at, id) AS rn FROM {_THEMED} WHERE call <> 'neutral') WHERE rn = 1)"""


def _scored(i: Inputs):
    return P.score_calls(D.dedupe_calls(i["fx_calls"]), i["fx_bars"], _bench(i), NOW(), stocks=_STOCKS)


@query("track_record", f"""WITH {win(_DEDUP)}, x AS (SELECT *, CASE WHEN {_STOCK} THEN ret - bench END AS ex FROM vd), a AS (SELECT count(*) AS directional, count(verdict) AS scored, count(*) FILTER (WHERE verdict IS NULL AND symbol IS NOT NULL) AS pending, count(*) FILTER (WHERE symbol IS NULL) AS unscorable,
  count(*) FILTER (WHERE verdict IN ('correct', 'incorrect')) AS n, count(*) FILTER (WHERE verdict = 'correct') AS hits, count(*) FILTER (WHERE call = 'bullish' AND verdict IS NOT NULL) AS n_bullish, count(*) FILTER (WHERE call = 'bullish' AND ret >= 0.5) AS n_up,
  count(ex) FILTER (WHERE call = 'bullish') AS n_vs_benchmark, count(*) FILTER (WHERE call = 'bullish' AND ex > 0) AS n_beat, avg(ex) FILTER (WHERE call = 'bullish') AS mean_excess FROM x),
 w AS (SELECT *, hits / n AS p, n_up / n_bullish AS up, 1 + 3.8416 / n AS d, 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n)) AS m FROM a)
SELECT directional, scored, pending, unscorable, n AS n_decided, hits, round(p, 6) AS hit_rate, round((p + 1.9208 / n - m) / d, 6) AS ci_lo, round((p + 1.9208 / n + m) / d, 6) AS ci_hi, n_bullish, n_up, round(up, 6) AS up_rate, n_vs_benchmark, n_beat, round(mean_excess, 6) AS mean_excess_pct,
 CASE WHEN n < 30 THEN 'too few decided calls' WHEN (p + 1.9208 / n - m) / d > greatest(up, 0.5) THEN 'some evidence of edge' ELSE 'not distinguishable from luck or drift' END AS verdict FROM w""")
def _(i: Inputs):
    t = R.track_record(_scored(i))
    return t.withColumns({c: rounded(c) for c in ("hit_rate", "ci_lo", "ci_hi", "up_rate", "mean_excess_pct")})


@query("track_record_breakdown", f"""WITH {win(_DEDUP)}, x AS (SELECT * FROM vd WHERE verdict IN ('correct', 'incorrect')), g AS (SELECT 'direction' AS dimension, call AS key, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS hits FROM x GROUP BY call UNION ALL
  SELECT 'confidence' AS dimension, CASE WHEN confidence >= 70 THEN 'high 70+' WHEN confidence >= 40 THEN 'medium 40-69' ELSE 'low <40' END AS key, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS hits FROM x WHERE confidence IS NOT NULL GROUP BY 2 UNION ALL
  SELECT * FROM (SELECT 'symbol' AS dimension, symbol AS key, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS hits FROM x GROUP BY symbol ORDER BY n DESC, key LIMIT 8)) SELECT * FROM g""")
def _(i: Inputs):
    return R.track_record_breakdown(_scored(i))


# ---------------------------------------------------------------- factor panel (weekly bars)

_PN = """u AS (SELECT symbol, sector FROM {fx_universe}), td AS (SELECT date FROM {fx_bars_weekly} GROUP BY date HAVING count(*) >= 10), g AS (SELECT s.symbol, td.date, b.close AS c, b.volume AS v, m.close AS k FROM (SELECT DISTINCT symbol FROM {fx_bars_weekly}) s CROSS JOIN td
   LEFT JOIN {fx_bars_weekly} b ON b.symbol = s.symbol AND b.date = td.date LEFT JOIN {fx_bench_weekly} m ON m.date = td.date),
 f0 AS (SELECT symbol, date, c, c * v AS dv, c / lag(c, 1) OVER w - 1 AS f_r1, c / lag(c, 5) OVER w - 1 AS f_r5, c / lag(c, 20) OVER w - 1 AS f_r20, c / lag(c, 60) OVER w - 1 AS f_r60, lag(c, 21) OVER w / lag(c, 252) OVER w - 1 AS f_mom_12_1,
   CASE WHEN count(c) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) >= 120 THEN c / max(c) OVER (w ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 END AS f_dd_high, k / lag(k, 5) OVER w - 1 AS k5, k / lag(k, 20) OVER w - 1 AS k20,
   lead(c, 2) OVER w / lead(c, 1) OVER w - lead(k, 2) OVER w / lead(k, 1) OVER w AS y1, lead(c, 6) OVER w / lead(c, 1) OVER w - lead(k, 6) OVER w / lead(k, 1) OVER w AS y5, lead(c, 21) OVER w / lead(c, 1) OVER w - lead(k, 21) OVER w / lead(k, 1) OVER w AS y20
   FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 panel AS (SELECT f0.date, f0.symbol, f_r1, f_r5, f_r20, f_r60, f_mom_12_1, CASE WHEN count(f_r1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(f_r1) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS f_vol20,
   CASE WHEN count(f_r1) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN stddev_samp(f_r1) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS f_vol60, f_dd_high,
   CASE WHEN count(dv) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) = 60 THEN dv / avg(dv) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS f_dvol_ratio, f_r5 - k5 AS f_rel5, f_r20 - k20 AS f_rel20,
   f_r20 - avg(f_r20) OVER (PARTITION BY f0.date, sector) AS f_sec_rel20, y1, y5, y20 FROM f0 JOIN u ON f0.symbol = u.symbol WINDOW w AS (PARTITION BY f0.symbol ORDER BY f0.date))"""
_FEATS = [f"f_{f}" for f in W.FEATURES]


def _panel(i: Inputs):
    return W.build_panel(i["fx_bars_weekly"], i["fx_bench_weekly"], i["fx_universe"], min_symbols=10)


@query("build_panel", f"WITH {_PN} SELECT CAST(date AS VARCHAR) AS date, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in _FEATS + ['y1', 'y5', 'y20'])} FROM panel")
def _(i: Inputs):
    p = _panel(i)
    return p.select(day_text("date").alias("date"), "symbol", *[rounded(c).alias(c) for c in _FEATS + ["y1", "y5", "y20"]])


@query("trading_days", "SELECT CAST(date AS VARCHAR) AS date FROM {fx_bars} GROUP BY date HAVING count(*) >= 14")
def _(i: Inputs):
    return W.trading_days(i["fx_bars"], i["fx_universe"], 14).select(day_text("date").alias("date"))


def _pct(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


_RK = f"ranked AS (SELECT date, symbol, y1, y5, y20, {', '.join(f'{_pct(c)} AS r_{c[2:]}' for c in _FEATS)} FROM panel)"
_RCOLS = [f"r_{f}" for f in W.FEATURES]


def _ranked(i: Inputs):
    return W.cs_rank(_panel(i), _FEATS)


@query("cs_rank", f"WITH {_PN}, {_RK} SELECT CAST(date AS VARCHAR) AS date, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in _RCOLS)} FROM ranked")
def _(i: Inputs):
    return _ranked(i).select(day_text("date").alias("date"), "symbol", *[rounded(c).alias(c) for c in _RCOLS])


@query("news_features", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, symbol, """ + ", ".join(f"round(arg_max_null({c}, ts) FILTER (WHERE model = '{m}'), 6) AS n_{c}_{m}" for c in ("idx", "z", "att_z") for m in ("ens", "finbert", "lex", "old")) +
       " FROM {fx_snaps} WHERE hour(ts) <= 20 GROUP BY 1, 2")
def _(i: Inputs):
    n = W.news_features(i["fx_snaps"])
    return n.select(day_text("date").alias("date"), "symbol", *[rounded(c).alias(c) for c in n.columns if c.startswith("n_")])


# ---------------------------------------------------------------- strategies and evaluation

_SC = """sc AS (SELECT date, symbol, 'mom' AS book, r_mom_12_1 AS score, y5 AS y FROM ranked UNION ALL SELECT date, symbol, 'rev' AS book, -r_r5 AS score, y5 AS y FROM ranked UNION ALL SELECT date, symbol, 'lowvol' AS book, -r_vol60 AS score, y5 AS y FROM ranked)"""


@query("strategy_scores", f"WITH {_PN}, {_RK}, {_SC} SELECT CAST(date AS VARCHAR) AS date, symbol, book, round(score, 6) AS score FROM sc WHERE score IS NOT NULL")
def _(i: Inputs):
    return L.strategy_scores(_ranked(i)).select(day_text("date").alias("date"), "symbol", "book", rounded("score").alias("score"))


def _with_y(i: Inputs):
    r = cut_lineage(_ranked(i))
    return L.strategy_scores(r).join(r.select("date", "symbol", F.col("y5").alias("y")), ["date", "symbol"])


_IC = f"""icr AS (SELECT book, date, {_pct('score', 'book, date')} AS a, {_pct('y', 'book, date')} AS b FROM (SELECT * FROM sc WHERE score IS NOT NULL AND y IS NOT NULL)), ic AS (SELECT book, date, count(*) AS n, corr(a, b) AS ic FROM icr GROUP BY 1, 2 HAVING count(*) >= 10)"""
_SP = f"""spr AS (SELECT book, date, y, {_pct('score', 'book, date')} AS q FROM (SELECT * FROM sc WHERE score IS NOT NULL AND y IS NOT NULL)), spd AS (SELECT book, date, count(*) AS n, avg(y) FILTER (WHERE q >= 0.9) - avg(y) FILTER (WHERE q <= 0.1) AS spread FROM spr GROUP BY 1, 2 HAVING count(*) >= 10 AND spread IS NOT NULL)"""


@query("daily_ic", f"WITH {_PN}, {_RK}, {_SC}, {_IC} SELECT book, CAST(date AS VARCHAR) AS date, n, round(ic, 6) AS ic FROM ic")
def _(i: Inputs):
    return L.daily_ic(_with_y(i), ["book"], min_n=10).select("book", day_text("date").alias("date"), "n", rounded("ic").alias("ic"))


@query("decile_spread", f"WITH {_PN}, {_RK}, {_SC}, {_SP} SELECT book, CAST(date AS VARCHAR) AS date, n, round(spread, 6) AS spread FROM spd")
def _(i: Inputs):
    return L.decile_spread(_with_y(i), ["book"], min_n=10).select("book", day_text("date").alias("date"), "n", rounded("spread").alias("spread"))


_SUM = """a AS (SELECT book, count(*) AS n_days, avg(ic) AS m, stddev_samp(ic) AS sd FROM ic GROUP BY 1), b AS (SELECT book, avg(spread) AS g, avg(CASE WHEN spread > 0 THEN 1 ELSE 0 END) AS hd FROM spd GROUP BY 1),
 summ AS (SELECT a.book, n_days, round(m, 6) AS ic_mean, round(m / (sd / sqrt(n_days)) / sqrt(5), 5) AS ic_t, round(g * 100, 6) AS spread_gross_pct, round((g - 0.004) * 100, 6) AS spread_net_pct, round(hd, 6) AS hit_days,
  m / (sd / sqrt(n_days)) / sqrt(5) > 2 AND g - 0.004 > 0 AS skill FROM a JOIN b ON a.book = b.book)"""


def _shown(s):
    return s.select("book", "n_days", rounded("ic_mean").alias("ic_mean"), rounded("ic_t", 5).alias("ic_t"), *[rounded(c).alias(c) for c in ("spread_gross_pct", "spread_net_pct", "hit_days")], "skill")


@query("summarise_strategy", f"WITH {_PN}, {_RK}, {_SC}, {_IC}, {_SP}, {_SUM} SELECT * FROM summ")
def _(i: Inputs):
    s = cut_lineage(_with_y(i))
    return _shown(L.summarise_strategy(L.daily_ic(s, ["book"], min_n=10), L.decile_spread(s, ["book"], min_n=10), 5))


_COMPLETE = "cp AS (SELECT * FROM ranked WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _RCOLS) + ")"
_FOLDS = """qs AS (SELECT CAST(unnest(generate_series(DATE '2000-07-01', (SELECT max(date) FROM cp), INTERVAL '3' MONTH)) AS DATE) AS f0), folds AS (SELECT f0, CAST(f0 - 12 AS DATE) AS cutoff, (SELECT count(*) FROM cp WHERE date <= f0 - 12 AND y5 IS NOT NULL) AS n_train,
  (SELECT count(*) FROM cp WHERE date >= f0 AND date < f0 + INTERVAL '3' MONTH) AS n_test FROM qs)"""


@query("walk_forward_folds", f"WITH {_PN}, {_RK}, {_COMPLETE}, {_FOLDS} SELECT CAST(f0 AS VARCHAR) AS fold_start, CAST(cutoff AS VARCHAR) AS cutoff, n_train, n_test FROM folds WHERE n_train >= 400 AND n_test > 0")
def _(i: Inputs):
    f = L.walk_forward_folds(_ranked(i), "2000-07-01", 5, 400)
    return f.select(day_text("fold_start").alias("fold_start"), day_text("cutoff").alias("cutoff"), "n_train", "n_test")


@query("walk_forward_rules", f"""WITH {_PN}, {_RK}, {_COMPLETE}, {_FOLDS}, tst AS (SELECT cp.* FROM cp JOIN folds ON date >= f0 AND date < f0 + INTERVAL '3' MONTH AND n_train >= 400), {_SC.replace('FROM ranked', 'FROM tst')}, {_IC}, {_SP}, {_SUM} SELECT * FROM summ""")
def _(i: Inputs):
    r = cut_lineage(_ranked(i))
    return _shown(L.evaluate_books(L.walk_forward_rules(r, "2000-07-01", 5, 400), r, 5, min_ic=10, min_tail=10, min_days=2))


@query("walk_forward")
def _(i: Inputs):
    """Rule books and boosted trees side by side, refit each quarter from the start of ``walk_forward_rules``; the operator's own rounds and depth, leaves of 20 rows for the small fixture, every third row."""
    r = cut_lineage(_ranked(i))
    w = L.walk_forward(r, "2000-07-01", 5, 400, train_every=3, min_leaf=20)
    return _shown(L.evaluate_books(w, r, 5, min_ic=10, min_tail=10, min_days=2))


@query("latest_complete_date", f"WITH {_PN}, {_RK}, {_COMPLETE} SELECT CAST(max(date) AS VARCHAR) AS date FROM cp")
def _(i: Inputs):
    r = _ranked(i)
    return i.spark.range(1).select(L.latest_complete_date(r).cast("string").alias("date"))


@query("news_scores", """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), model ORDER BY ts DESC) AS rn FROM {fx_snaps} WHERE hour(ts) <= 20) WHERE rn = 1),
 e AS (SELECT CAST(ts AS DATE) AS date, symbol, CONCAT('news_', model) AS book, z, idx, count(z) OVER (PARTITION BY CAST(ts AS DATE), model) AS nz FROM d), s AS (SELECT date, symbol, book, CASE WHEN nz > 0 THEN z ELSE idx END AS score FROM e)
SELECT CAST(date AS VARCHAR) AS date, symbol, book, round(score, 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY date, book) AS n FROM s WHERE score IS NOT NULL) WHERE n >= 10""")
def _(i: Inputs):
    return L.news_scores(W.news_features(i["fx_snaps"]), min_names=10).select(day_text("date").alias("date"), "symbol", "book", rounded("score").alias("score"))


# ---------------------------------------------------------------- books and ledger

_BOOK = "bk AS (SELECT date, symbol, book, score, row_number() OVER (PARTITION BY date, book ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY date, book) AS n FROM {fx_books})"


def _book(i: Inputs, k: int = 25):
    return L.rank_book(i["fx_books"], k, 20)


@query("rank_book", f"WITH {_BOOK} SELECT CAST(date AS VARCHAR) AS date, symbol, book, round(score, 6) AS score, rank, n FROM bk WHERE n >= 20 AND (rank <= 3 OR rank > n - 3)")
def _(i: Inputs):
    return _book(i, 3).select(day_text("date").alias("date"), "symbol", "book", rounded("score").alias("score"), "rank", "n")


@query("record_predictions", "SELECT CAST(pred_date AS VARCHAR) AS pred_date, book, symbol, rank FROM {fx_predictions} WHERE book = 'price' UNION ALL SELECT CAST(date AS VARCHAR) AS pred_date, book, symbol, rank FROM (SELECT date, symbol, book, row_number() OVER (PARTITION BY date, book ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY date, book) AS n FROM {fx_books}) WHERE book = 'volume' AND n >= 20")
def _(i: Inputs):
    p = L.record_predictions(i["fx_predictions"].where("book = 'price'"), _book(i))
    return p.select(day_text("pred_date").alias("pred_date"), "book", "symbol", "rank")


_OPEN = "op AS (SELECT book, 'long' AS side, symbol, date AS signal_date FROM bk WHERE n >= 20 AND rank <= 10 UNION ALL SELECT book, 'avoid' AS side, symbol, date AS signal_date FROM bk WHERE n >= 20 AND rank > n - 10)"


@query("open_positions", f"WITH {_BOOK}, {_OPEN} SELECT book, side, symbol, CAST(signal_date AS VARCHAR) AS signal_date, 'pending' AS status FROM op WHERE book = 'volume' UNION ALL SELECT book, side, symbol, CAST(signal_date AS VARCHAR) AS signal_date, 'kept' AS status FROM op WHERE book = 'price'")
def _(i: Inputs):
    b = _book(i)
    old = L.new_positions(b).where("book = 'price'").withColumn("status", F.lit("kept"))
    return L.open_positions(old, b).select("book", "side", "symbol", day_text("signal_date").alias("signal_date"), "status")


_SETTLE = """cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM {fx_bench_weekly}), st AS (SELECT o.*, e.date AS ed, b1.close AS p0, x.date AS xd, b2.close AS p1, m1.close AS s0, m2.close AS s1 FROM op o JOIN cal c ON c.date = o.signal_date JOIN cal e ON e.i = c.i + 1 JOIN cal x ON x.i = c.i + 6
  JOIN {fx_bars_weekly} b1 ON b1.symbol = o.symbol AND b1.date = e.date JOIN {fx_bars_weekly} b2 ON b2.symbol = o.symbol AND b2.date = x.date JOIN {fx_bench_weekly} m1 ON m1.date = e.date JOIN {fx_bench_weekly} m2 ON m2.date = x.date),
 se AS (SELECT *, (p1 / p0 - 1) * 100 AS ret, (s1 / s0 - 1) * 100 AS spy FROM st), sx AS (SELECT *, CASE WHEN side = 'long' THEN ret - spy ELSE spy - ret END AS ex FROM se),
 led AS (SELECT o.book, o.side, o.symbol, o.signal_date, CASE WHEN x.ex IS NOT NULL THEN 'closed' ELSE 'pending' END AS status, x.ed, x.xd, x.ret, x.ex, x.ex - 0.2 AS net FROM op o LEFT JOIN sx x ON o.book = x.book AND o.side = x.side AND o.symbol = x.symbol AND o.signal_date = x.signal_date)"""


def _ledger(i: Inputs):
    w = i["fx_bench_weekly"]
    return L.settle_positions(L.new_positions(_book(i)), i["fx_bars_weekly"], w, w)


@query("settle_positions", f"WITH {_BOOK}, {_OPEN}, {_SETTLE} SELECT book, side, symbol, CAST(signal_date AS VARCHAR) AS signal_date, status, CAST(ed AS VARCHAR) AS entry_date, CAST(xd AS VARCHAR) AS exit_date, round(ret, 6) AS ret_pct, round(ex, 6) AS excess_pct, round(net, 6) AS net_excess_pct FROM led")
def _(i: Inputs):
    p = _ledger(i)
    return p.select("book", "side", "symbol", *[day_text(c).alias(c) for c in ("signal_date", "entry_date", "exit_date")], "status", *[rounded(c).alias(c) for c in ("ret_pct", "excess_pct", "net_excess_pct")])


@query("ledger_report", f"""WITH {_BOOK}, {_OPEN}, {_SETTLE} SELECT book, side, count(*) AS closed_positions, round(avg(ex), 6) AS mean_excess_pct, round(avg(net), 6) AS mean_net_excess_pct, round(avg(CASE WHEN ex > 0 THEN 1 ELSE 0 END), 6) AS hit_rate,
 CAST(min(signal_date) AS VARCHAR) AS first, CAST(max(signal_date) AS VARCHAR) AS last FROM led WHERE status = 'closed' GROUP BY 1, 2""")
def _(i: Inputs):
    r = L.ledger_report(_ledger(i))
    return r.select("book", "side", "closed_positions", *[rounded(c).alias(c) for c in ("mean_excess_pct", "mean_net_excess_pct", "hit_rate")], day_text("first").alias("first"), day_text("last").alias("last"))


@query("ledger_with_open", """SELECT book, side, count(*) FILTER (WHERE status = 'closed') AS n, round(avg(net_excess_pct) FILTER (WHERE status = 'closed'), 6) AS net, round(avg(CASE WHEN excess_pct > 0 THEN 1 ELSE 0 END) FILTER (WHERE status = 'closed'), 6) AS hit,
 count(*) FILTER (WHERE status = 'pending') AS open FROM {fx_positions} GROUP BY 1, 2""")
def _(i: Inputs):
    return L.ledger_with_open(i["fx_positions"]).withColumns({"net": rounded("net"), "hit": rounded("hit")})


@query("top_predictions", "SELECT book, symbol, rank, round(score, 6) AS score FROM {fx_predictions} WHERE pred_date = (SELECT max(pred_date) FROM {fx_predictions}) AND rank <= 10")
def _(i: Inputs):
    return L.top_predictions(i["fx_predictions"]).withColumn("score", rounded("score"))


@query("avoid_predictions", "SELECT book, symbol, rank, round(score, 6) AS score FROM (SELECT *, max(rank) OVER (PARTITION BY book) AS mr FROM {fx_predictions} WHERE pred_date = (SELECT max(pred_date) FROM {fx_predictions})) WHERE rank > mr - 10")
def _(i: Inputs):
    return L.avoid_predictions(i["fx_predictions"]).withColumn("score", rounded("score"))


@query("top5_per_book", f"WITH {_BOOK} SELECT CAST(date AS VARCHAR) AS date, book, string_agg(symbol, ',' ORDER BY rank) AS top FROM bk WHERE rank <= 5 GROUP BY 1, 2")
def _(i: Inputs):
    return L.top5_per_book(i["fx_books"]).select(day_text("date").alias("date"), "book", joined("top").alias("top"))


@query("lab_report", """WITH m AS (SELECT max(date) AS d FROM {fx_books}), t AS (SELECT book, symbol, row_number() OVER (PARTITION BY book ORDER BY score DESC, symbol) AS rank FROM {fx_books}, m WHERE date = d)
SELECT CAST(d AS VARCHAR) AS as_of, (SELECT string_agg(concat(book, ':', top), ',' ORDER BY book) FROM (SELECT book, string_agg(symbol, '/' ORDER BY rank) AS top FROM t WHERE rank <= 5 GROUP BY 1)) AS top5,
 (SELECT count(*) FROM {fx_positions} WHERE status = 'pending') AS open_positions,
 (SELECT coalesce(string_agg(concat(book, ':', side, ':', n), ',' ORDER BY book, side), '') FROM (SELECT book, side, count(*) AS n FROM {fx_positions} WHERE status = 'closed' GROUP BY 1, 2)) AS ledger FROM m""")
def _(i: Inputs):
    """The document taken apart again."""
    b = i["fx_books"]
    r = L.lab_report(b, i["fx_positions"], b.agg(F.max("date")).scalar())
    kind = "top5 array<struct<book:string,top:array<string>>>, open_paper_positions long, ledger array<struct<book:string,side:string,closed_positions:long>>"
    d = r.select(day_text("as_of").alias("as_of"), F.from_json("report", kind).alias("d"))
    return d.select("as_of", F.array_join(F.transform("d.top5", lambda x: F.concat_ws(":", x["book"], F.array_join(x["top"], "/"))), ",").alias("top5"), F.col("d.open_paper_positions").alias("open_positions"),
                    F.coalesce(F.array_join(F.transform("d.ledger", lambda x: F.concat_ws(":", x["book"], x["side"], x["closed_positions"].cast("string"))), ","), F.lit("")).alias("ledger"))


@query("ticker_page", """SELECT s.symbol, CAST(max(b.date) AS VARCHAR) AS asof, arg_max(b.close, b.date) AS last, count(*) AS n_prices FROM (SELECT 'B7' AS symbol) s JOIN (SELECT * FROM {fx_bars} WHERE symbol = 'B7' ORDER BY date DESC LIMIT 90) b ON b.symbol = s.symbol GROUP BY 1""")
def _(i: Inputs):
    from ..plans.pages import ticker_page
    p = ticker_page("B7", i["fx_snaps"], i["fx_bars"], i["fx_articles"], i["fx_scores"], i["fx_universe"], i["fx_predictions"], i["fx_positions"], moment("2024-01-31 00:00:00"))
    return p.select("symbol", day_text("perf.asof").alias("asof"), F.col("perf.last").alias("last"), F.size("price").alias("n_prices"))


@query("report_json", "SELECT kind, 1 AS has_json FROM {fx_sources} GROUP BY kind")
def _(i: Inputs):
    k = R.source_kinds(i["fx_sources"])
    return T.report_json(k).select(F.get_json_object("report", "$.kind").alias("kind"), F.lit(1).alias("has_json"))

"""Sentiment index, attention, z-scores, alerts, read-side signal views and signal evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sentiment as S
from ..session import cut_lineage
from .core import Inputs, day_text, moment, query, rounded, ts_text

MODELS = ("lex", "finbert", "ens", "old")
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
_T = "strftime({c}, '%Y-%m-%d %H:%M:%S')"

# The plain definition: every (symbol, hour) against every article of the 48 hours before, no folding.
INDEX = f"""grid AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL '1' HOUR)) AS t),
 long AS ({' UNION ALL '.join(f"SELECT symbol, ts, '{m}' AS model, CAST({m} AS DOUBLE) AS score, src_w * event_w * rel * novelty * (1.0 + least(confirm, 4) * 0.1) AS w, novelty FROM {{fx_items}} WHERE {m} IS NOT NULL" for m in MODELS)}),
 hit AS (SELECT t, symbol, model, score, novelty, w * pow(0.5, (epoch(t) - epoch(ts)) / 3600.0 / 12.0) AS w, epoch_us(t) - epoch_us(ts) <= 86400000000 AS fresh FROM grid JOIN long ON ts <= t AND ts >= t - INTERVAL '48' HOUR),
 idx AS (SELECT t AS ts, symbol, model, sum(w * score) / sum(w) AS idx, count(*) FILTER (WHERE novelty = 1.0 AND fresh) AS n_lead, sum(w) AS wsum FROM hit GROUP BY 1, 2, 3)"""


def _index(i: Inputs):
    return S.sentiment_index(i["fx_items"], moment(START), moment(END), MODELS)


@query("sentiment_index", f"WITH {INDEX} SELECT {_T.format(c='ts')} AS ts, symbol, model, round(idx, 6) AS idx, n_lead, round(wsum, 6) AS wsum FROM idx")
def _(i: Inputs):
    return _index(i).select(ts_text("ts").alias("ts"), "symbol", "model", rounded("idx").alias("idx"), "n_lead", rounded("wsum").alias("wsum"))


_AT = "2024-01-20 10:17:31"


@query("sentiment_index_at", f"""WITH x AS ({' UNION ALL '.join(f"SELECT symbol, ts, '{m}' AS model, CAST({m} AS DOUBLE) AS score, src_w * event_w * rel * novelty * (1.0 + least(confirm, 4) * 0.1) AS w, novelty FROM {{fx_items}} WHERE {m} IS NOT NULL" for m in MODELS)}),
 y AS (SELECT symbol, model, score, novelty, (epoch_us(TIMESTAMP '{_AT}') - epoch_us(ts)) / 3600000000.0 AS age, w FROM x WHERE ts <= TIMESTAMP '{_AT}' AND ts >= TIMESTAMP '{_AT}' - INTERVAL '48' HOUR)
SELECT symbol, model, round(sum(w * pow(0.5, age / 12) * score) / sum(w * pow(0.5, age / 12)), 6) AS idx, count(*) FILTER (WHERE novelty = 1.0 AND age <= 24) AS n_lead FROM y GROUP BY 1, 2""")
def _(i: Inputs):
    return S.sentiment_index_at(i["fx_items"], moment(_AT), MODELS).select("symbol", "model", rounded("idx").alias("idx"), "n_lead")


ATT = """led AS (SELECT symbol, ts FROM {fx_items} WHERE novelty = 1.0), pts AS (SELECT DISTINCT symbol, ts AS t FROM idx),
 att AS (SELECT p.symbol, t, count(*) FILTER (WHERE l.ts >= t - INTERVAL '6' HOUR) AS n, count(*) FILTER (WHERE l.ts < t - INTERVAL '6' HOUR) AS prior FROM pts p LEFT JOIN led l ON l.symbol = p.symbol AND l.ts <= t AND l.ts >= t - INTERVAL '14' DAY GROUP BY 1, 2)"""


@query("attention", f"WITH {INDEX}, {ATT} SELECT {_T.format(c='t')} AS ts, symbol, n AS att_n, round((n - prior / 330.0 * 6) / sqrt(prior / 330.0 * 6 + 1), 6) AS att_z FROM att")
def _(i: Inputs):
    a = S.attention(i["fx_items"], _index(i).select("symbol", "ts").distinct())
    return a.select(ts_text("ts").alias("ts"), "symbol", "att_n", rounded("att_z").alias("att_z"))


Z = """zz AS (SELECT ts, symbol, model, idx, n_lead, CASE WHEN count(idx) OVER w >= 20 AND stddev_pop(idx) OVER w > 1e-6 THEN (idx - avg(idx) OVER w) / stddev_pop(idx) OVER w END AS z FROM {src}
  WINDOW w AS (PARTITION BY symbol, model ORDER BY ts RANGE BETWEEN INTERVAL '14' DAY PRECEDING AND INTERVAL '1' MICROSECOND PRECEDING))"""


@query("rolling_zscore", f"WITH {Z.format(src='{fx_snaps}')} SELECT {_T.format(c='ts')} AS ts, symbol, model, round(z, 5) AS z FROM zz")
def _(i: Inputs):
    return S.rolling_zscore(i["fx_snaps"].drop("z")).select(ts_text("ts").alias("ts"), "symbol", "model", rounded("z", 5).alias("z"))


def latest_unusual(i: Inputs):
    """The flagship: symbols whose newest sentiment index is furthest from its own two-week norm."""
    return S.top_signals(S.rolling_zscore(cut_lineage(_index(i))))


@query("unusual_symbols", f"""WITH {INDEX}, {Z.format(src='idx')} SELECT symbol, round(idx, 6) AS idx, round(z, 4) AS z, n_lead FROM zz WHERE model = 'ens' AND ts = (SELECT max(ts) FROM zz WHERE model = 'ens') AND n_lead >= 4
ORDER BY abs(coalesce(zz.z, 0)) DESC, symbol LIMIT 12""")
def _(i: Inputs):
    return latest_unusual(i).select("symbol", rounded("idx").alias("idx"), rounded("z", 4).alias("z"), "n_lead")


@query("backfill_index", f"""WITH {INDEX}, {Z.format(src='idx')}, {ATT} SELECT {_T.format(c='zz.ts')} AS ts, zz.symbol, model, round(idx, 6) AS idx, round(z, 4) AS z, n_lead, n AS att_n, round((n - prior / 330.0 * 6) / sqrt(prior / 330.0 * 6 + 1), 6) AS att_z
FROM zz JOIN att ON zz.symbol = att.symbol AND zz.ts = att.t""")
def _(i: Inputs):
    b = S.backfill_index(i["fx_items"], moment(START), moment(END), MODELS)
    return b.select(ts_text("ts").alias("ts"), "symbol", "model", rounded("idx").alias("idx"), rounded("z", 4).alias("z"), "n_lead", "att_n", rounded("att_z").alias("att_z"))


@query("zscore_alerts", f"""WITH RECURSIVE h AS (SELECT symbol, ts, z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {{fx_snaps}} WHERE model = 'ens' AND abs(z) >= 2 AND n_lead >= 4),
 f AS (SELECT symbol, rn, ts, z, ts AS last, true AS fired FROM h WHERE rn = 1 UNION ALL
   SELECT h.symbol, h.rn, h.ts, h.z, CASE WHEN h.ts - f.last >= INTERVAL '6' HOUR THEN h.ts ELSE f.last END, h.ts - f.last >= INTERVAL '6' HOUR FROM f JOIN h ON h.symbol = f.symbol AND h.rn = f.rn + 1)
SELECT {_T.format(c='ts')} AS ts, symbol, round(z, 6) AS z FROM f WHERE fired""")
def _(i: Inputs):
    return S.zscore_alerts(i["fx_snaps"], allowed=[]).select(ts_text("ts").alias("ts"), "symbol", rounded("z").alias("z"))


@query("alert_evidence", """SELECT symbol, id, rn AS rank FROM (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY abs(ens) * event_w DESC, id) AS rn FROM {fx_items}
 WHERE novelty = 1.0 AND ens IS NOT NULL AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts > TIMESTAMP '2024-01-19 00:00:00') WHERE rn <= 2""")
def _(i: Inputs):
    return S.alert_evidence(i["fx_items"], moment("2024-01-20 00:00:00")).select("symbol", "id", "rank")


@query("top_signals", """SELECT symbol, round(idx, 6) AS idx, round(z, 6) AS z, n_lead FROM {fx_snaps} s WHERE model = 'ens' AND ts = (SELECT max(ts) FROM {fx_snaps} WHERE model = 'ens') AND n_lead >= 2 ORDER BY abs(coalesce(s.z, 0)) DESC, symbol LIMIT 12""")
def _(i: Inputs):
    return S.top_signals(i["fx_snaps"], 2).select("symbol", rounded("idx").alias("idx"), rounded("z").alias("z"), "n_lead")


_LASTDAY = "ts >= TIMESTAMP '2024-01-30 00:00:00'"
# one row per symbol of the newest hour with an ens value
_SIG = f"""cur AS (SELECT * FROM {{fx_snaps}} WHERE ts = (SELECT max(ts) FROM {{fx_snaps}} WHERE model = 'ens')),
 sig AS (SELECT symbol, max(idx) FILTER (WHERE model = 'ens') AS ens, max(z) FILTER (WHERE model = 'ens') AS ens_z, max(n_lead) FILTER (WHERE model = 'ens') AS stories_24h, max(att_z) FILTER (WHERE model = 'ens') AS attention_z,
   max(idx) FILTER (WHERE model = 'finbert') AS finbert, max(idx) FILTER (WHERE model = 'lex') AS lex, max(idx) FILTER (WHERE model = 'old') AS old FROM cur GROUP BY symbol HAVING stories_24h > 0)"""


def _signals(i: Inputs):
    return S.ticker_signals(i["fx_snaps"], i["fx_event_bars"], i["fx_news_universe"], moment("2024-01-17 00:00:00"))


@query("ticker_signals", f"""WITH {_SIG}, sr AS (SELECT symbol, ts, round(idx, 3) AS idx, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM {{fx_snaps}} WHERE model = 'ens' AND ts >= TIMESTAMP '2024-01-17 00:00:00'),
 s6 AS (SELECT symbol, ts, idx, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM sr WHERE k % 6 = 0), ser AS (SELECT symbol, count(*) AS n_points, round(sum(idx), 3) AS sum_points FROM s6 WHERE d <= 60 GROUP BY symbol),
 pb AS (SELECT symbol, date, close, lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM {{fx_event_bars}} WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT sig.symbol, coalesce(u.name, sig.symbol) AS name, coalesce(u.sector, '') AS sector, round(ens, 6) AS ens, round(ens_z, 6) AS ens_z, stories_24h, round(attention_z, 6) AS attention_z, round(finbert, 6) AS finbert, round(lex, 6) AS lex, round(old, 6) AS old,
  n_points, sum_points, round((close / c1 - 1) * 100, 6) AS d1, round((close / c5 - 1) * 100, 6) AS d5
FROM sig LEFT JOIN {{fx_news_universe}} u ON sig.symbol = u.symbol LEFT JOIN ser ON ser.symbol = sig.symbol LEFT JOIN (SELECT * FROM pb WHERE d = 1 AND n >= 7) pb ON pb.symbol = sig.symbol""")
def _(i: Inputs):
    s = _signals(i)
    pts = F.aggregate("series", F.lit(0.0), lambda a, x: a + x["idx"])
    return s.select("symbol", "name", "sector", *[rounded(c).alias(c) for c in ("ens", "ens_z", "attention_z", "finbert", "lex", "old")], "stories_24h", F.size("series").alias("n_points"),
                    rounded(pts, 3).alias("sum_points"), rounded("perf.d1").alias("d1"), rounded("perf.d5").alias("d5"))


_BOARD = {"all": "true", "holdings": "symbol IN ('S1', 'S2', 'S3')", "macro": "symbol IN ('S7', 'S8')", "movers": "abs(coalesce(ens_z, 0)) >= 0.5 AND stories_24h >= 4", "positive": "coalesce(ens, 0) > 0.15", "negative": "coalesce(ens, 0) < -0.15"}


@query("signal_leaderboard", f"WITH {_SIG} SELECT symbol, round(CASE WHEN stories_24h >= 3 THEN abs(coalesce(ens_z, 0)) ELSE -1 END, 6) AS sort_value FROM sig WHERE abs(coalesce(ens_z, 0)) >= 1.5 AND stories_24h >= 4 UNION ALL SELECT CONCAT('pos:', symbol) AS symbol, round(coalesce(attention_z, -999), 6) AS sort_value FROM sig WHERE coalesce(ens, 0) > 0.15")
def _(i: Inputs):
    s = _signals(i)
    a = S.signal_leaderboard(s, "movers").select("symbol", rounded("sort_value").alias("sort_value"))
    b = S.signal_leaderboard(s, "positive", "attention_z").select(F.concat(F.lit("pos:"), "symbol").alias("symbol"), rounded("sort_value").alias("sort_value"))
    return a.unionByName(b)


@query("holdings_then_movers", f"""WITH {_SIG} SELECT symbol, 0 AS part FROM sig WHERE symbol IN ('S1', 'S2', 'S3', 'S4') UNION ALL
SELECT * FROM (SELECT symbol, 1 AS part FROM sig WHERE symbol NOT IN ('S1', 'S2', 'S3', 'S4') AND stories_24h >= 4 AND ens_z IS NOT NULL ORDER BY abs(ens_z) DESC, symbol LIMIT 5)""")
def _(i: Inputs):
    return S.holdings_then_movers(_signals(i), 5, ["S1", "S2", "S3", "S4"]).select("symbol", "part")


@query("downsample_series", f"""WITH s AS (SELECT symbol, ts, idx, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM {{fx_snaps}} WHERE model = 'ens' AND ts >= TIMESTAMP '2024-01-10 00:00:00'),
 d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM s WHERE k % 6 = 0) SELECT symbol, {_T.format(c='ts')} AS ts, round(idx, 3) AS idx FROM d WHERE b <= 20""")
def _(i: Inputs):
    d = S.downsample_series(i["fx_snaps"], moment("2024-01-10 00:00:00"), last=20)
    return d.select("symbol", F.explode("series").alias("p")).select("symbol", ts_text("p.ts").alias("ts"), "p.idx")


@query("ticker_series", f"SELECT model, {_T.format(c='ts')} AS ts, round(idx, 6) AS idx FROM {{fx_snaps}} WHERE symbol = 'S3' AND {{fx_snaps}}.ts >= TIMESTAMP '2024-01-17 00:00:00'")
def _(i: Inputs):
    t = S.ticker_series(i["fx_snaps"], "S3", moment("2024-01-17 00:00:00"))
    return t.select("model", F.explode("series").alias("p")).select("model", ts_text("p.ts").alias("ts"), rounded("p.idx").alias("idx"))


# ---------------------------------------------------------------- does the signal predict?

_OBS = """sn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), model ORDER BY ts DESC) AS rn FROM {fx_snaps} WHERE hour(ts) <= 20 AND n_lead >= 3 AND ts >= TIMESTAMP '2024-01-01 00:00:00') WHERE rn = 1),
 own AS (SELECT symbol, date, """ + ", ".join(f"(lead(close, {h}) OVER w / close - 1) * 100 AS r{h}" for h in (1, 3, 5)) + """ FROM {fx_event_bars} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 mkt AS (SELECT date, """ + ", ".join(f"(lead(close, {h}) OVER w / close - 1) * 100 AS m{h}" for h in (1, 3, 5)) + """ FROM {fx_event_bench} WINDOW w AS (ORDER BY date)),
 j AS (SELECT sn.model, sn.idx, sn.z, own.*, mkt.* FROM sn JOIN own ON sn.symbol = own.symbol AND CAST(sn.ts AS DATE) = own.date LEFT JOIN mkt ON mkt.date = own.date),
 obs AS (""" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {x} AS x, {h} AS horizon, '{k}' AS kind, {y} AS y FROM j WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
                                  for m, x in (("index", "idx"), ("z", "z")) for h in (1, 3, 5) for k, y in (("raw", f"r{h}"), ("vs market", f"r{h} - m{h}"))) + ")"
_RANKS = """rk AS (SELECT *, rank() OVER (PARTITION BY model, metric, horizon, kind ORDER BY x) + (count(*) OVER (PARTITION BY model, metric, horizon, kind, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY model, metric, horizon, kind ORDER BY y) + (count(*) OVER (PARTITION BY model, metric, horizon, kind, y) - 1) / 2.0 AS ry FROM obs),
 sp AS (SELECT model, metric, horizon, kind, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY ALL HAVING count(*) >= 8)"""
_K = "1.0 / (1.0 + 0.3275911 * abs(t) / sqrt(2.0))"
_P = ("CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-(abs(t) / sqrt(2.0)) * (abs(t) / sqrt(2.0))) END")
_PV = f"pv AS (SELECT *, {_P} AS p FROM (SELECT *, {_K} AS k FROM (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM sp)))"


def _obs(i: Inputs):
    return E.signal_observations(i["fx_snaps"], i["fx_event_bars"], i["fx_event_bench"], moment("2024-01-01 00:00:00"))


@query("signal_eval", f"""WITH {_OBS}, {_RANKS}, {_PV}, qq AS (SELECT model, metric, horizon, kind, quantile_cont(x, 2.0/3) AS hi, quantile_cont(x, 1.0/3) AS lo FROM obs GROUP BY ALL),
 th AS (SELECT o.model, o.metric, o.horizon, o.kind, avg(y) FILTER (WHERE x >= hi) - avg(y) FILTER (WHERE x <= lo) AS spread FROM obs o JOIN qq USING (model, metric, horizon, kind) GROUP BY ALL)
SELECT model, metric, horizon, kind, n, round(rho, 6) AS rho, round(p, 5) AS p, round(spread, 5) AS spread FROM pv JOIN th USING (model, metric, horizon, kind)""")
def _(i: Inputs):
    e = E.signal_eval(_obs(i))
    return e.select("model", "metric", "horizon", "kind", "n", rounded("rho").alias("rho"), rounded("p", 5).alias("p"), rounded("spread", 5).alias("spread"))


@query("signal_verdict", f"""WITH {_OBS}, {_RANKS}, {_PV} SELECT count(*) AS tests, count(*) FILTER (WHERE p < 0.05 AND n >= 30) AS significant, round(CAST(count(*) AS DOUBLE) * 0.05, 6) AS expected_by_chance,
 CASE WHEN count(*) FILTER (WHERE p < 0.05 AND n >= 30) <= count(*) * 0.05 + 1 THEN 'Nothing beyond chance yet.' ELSE 'Possible signal: a hypothesis for the forward paper ledger, not proof.' END AS verdict FROM pv""")
def _(i: Inputs):
    return E.signal_verdict(E.signal_eval(_obs(i))).withColumn("expected_by_chance", rounded("expected_by_chance"))


@query("spearman_test", """WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS b FROM events), sp AS (SELECT event_type, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1), """ + _PV +
       " SELECT event_type, n, round(rho, 6) AS rho, round(p, 5) AS p FROM pv")
def _(i: Inputs):
    return E.spearman_test(i["events"], ["event_type"], "user_id", "value").select("event_type", "n", rounded("rho").alias("rho"), rounded("p", 5).alias("p"))

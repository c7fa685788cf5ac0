"""Streaming jobs drained over the given tables, and the end-to-end flows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cycles
from ..session import shared_dir
from ..streaming import jobs as J
from ..streaming import marks as M
from .article_queries import _WORTHY, NOW, _rule_sql, cycle_items_sql
from .core import BASE_TABLES, NOW_NEWS, Inputs, base_table, moment, query, rounded, ts_text
from .signal_queries import ATT, END, INDEX, MODELS, START, Z
from .text_queries import LINK_UNIVERSE, NAMES, NEG, NEGATORS, PATTERNS, POS, VALENCE

_T = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
CYCLE_START = "2024-01-17 00:00:00"


class Streams(Inputs):
    """Given tables as file streams; the views over them become streams too."""

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            # as a glob the path may be one file or a folder of files
            return J.read_stream(self.spark, f"{self.sf}/{name}.parque[t]", base_table(self.spark, self.sf, name).schema)
        return super().__getitem__(name)

    def _view(self, name: str) -> str:
        view = f"stream_{super()._view(name)}"
        self[name].createOrReplaceTempView(view)
        return view


def _streams(i: Inputs) -> Streams:
    return Streams(i.spark, i.sf)


@query("stream_articles", "SELECT DISTINCT url FROM {fx_articles}")
def _(i: Inputs):
    """Which of a url's rows arrives first is up to the file order, so the distinct urls are compared."""
    return J.drain(J.stream_articles(_streams(i)["fx_articles"], "60 days").select("url"))


@query("stream_enrich", f"WITH {_rule_sql()} SELECT * FROM rules")
def _(i: Inputs):
    s = J.drain(J.stream_enrich(_streams(i)["fx_articles"], lexicon=VALENCE).select("id", "compound", "ai_sentiment", "ai_relevance_score", "ai_confidence"))
    return s.withColumn("compound", rounded("compound"))


@query("stream_sentiment_index", f"""WITH grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 01:00:00', TIMESTAMP '2024-02-02 00:00:00', INTERVAL '1' HOUR)) AS t),
 long AS ({' UNION ALL '.join(f"SELECT symbol, ts, '{m}' AS model, CAST({m} AS DOUBLE) AS score, src_w * event_w * rel * novelty * (1.0 + least(confirm, 4) * 0.1) AS w, novelty FROM {{fx_items}} WHERE {m} IS NOT NULL" for m in MODELS)}),
 hit AS (SELECT t, symbol, model, score, novelty, w * pow(0.5, (epoch(t) - epoch(ts)) / 3600.0 / 12.0) AS w, ts >= t - INTERVAL '24' HOUR AS fresh FROM grid JOIN long ON ts < t AND ts >= t - INTERVAL '48' HOUR
   WHERE t <= (SELECT max(ts) FROM {{fx_items}}) - INTERVAL '2' HOUR)
SELECT {_T.format(c='t')} AS ts, symbol, model, round(sum(w * score) / sum(w), 6) AS idx, count(*) FILTER (WHERE novelty = 1.0 AND fresh) AS n_lead FROM hit GROUP BY 1, 2, 3""")
def _(i: Inputs):
    s = J.drain(J.stream_sentiment_index(_streams(i)["fx_items"], MODELS))
    return s.select(ts_text("ts").alias("ts"), "symbol", "model", rounded("idx").alias("idx"), "n_lead")


@query("stream_zscore_alerts", f"""WITH RECURSIVE h AS (SELECT symbol, ts, z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {{fx_snaps}} WHERE model = 'ens' AND abs(z) >= 2 AND n_lead >= 4),
 f AS (SELECT symbol, rn, ts, z, ts AS last, true AS fired FROM h WHERE rn = 1 UNION ALL
   SELECT h.symbol, h.rn, h.ts, h.z, CASE WHEN h.ts - f.last >= INTERVAL '6' HOUR THEN h.ts ELSE f.last END, h.ts - f.last >= INTERVAL '6' HOUR FROM f JOIN h ON h.symbol = f.symbol AND h.rn = f.rn + 1)
SELECT {_T.format(c='ts')} AS ts, symbol, round(z, 6) AS z FROM f WHERE fired""")
def _(i: Inputs):
    """Snapshots are landed as files first, as the index job would, and then streamed."""
    snaps = i["fx_snaps"].select("ts", "symbol", "model", "z", "n_lead")
    path = f"{shared_dir(i.spark)}/snaps/{uuid.uuid4().hex}"
    snaps.write.parquet(path)
    s = J.drain(J.stream_zscore_alerts(J.read_stream(i.spark, path, snaps.schema), allowed=[]))
    return s.select(ts_text("ts").alias("ts"), "symbol", rounded("z").alias("z"))


@query("live_counts", f"SELECT {_T.format(c="date_trunc('hour', published_at)")} AS start, count(*) AS n FROM {{fx_articles}} GROUP BY 1")
def _(i: Inputs):
    u = J.latest_updates(J.drain(J.live_counts(_streams(i)["fx_articles"]), "update"), ["start"])
    return u.select(ts_text("start").alias("start"), "n")


@query("stream_notifications", """SELECT id, title FROM {fx_articles} WHERE ai_processed AND ai_relevance_score >= 70
 AND list_has_any(CASE WHEN len(ai_affected_tickers) > 0 THEN ai_affected_tickers ELSE tickers_raw END, ['NVDA', 'MSFT', 'GOOGL', 'ASML'])""")
def _(i: Inputs):
    base = f"{shared_dir(i.spark)}/notified/{uuid.uuid4().hex}"
    a = _streams(i)["fx_articles"]
    for _run in range(2):  # a second run over the same data must add nothing
        J.stream_notifications(a, f"{base}/table", f"{base}/state{_run}").awaitTermination()
    return i.spark.read.parquet(f"{base}/table").select("id", "title")


_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


@query("push_articles", f"""SELECT id, {_T.format(c='wm')} AS wm, CAST(wm > TIMESTAMP '2024-01-28 00:00:00' AS INT) AS page FROM (
  SELECT id, greatest(coalesce(ai_processed_at, {_EPOCH}), coalesce(scraped_at, {_EPOCH})) AS wm FROM {{fx_articles}} WHERE published_at > TIMESTAMP '{NOW_NEWS}' - INTERVAL '5' DAY AND {_WORTHY}) s
WHERE wm > TIMESTAMP '2024-01-27 00:00:00'""")
def _(i: Inputs):
    """A first run sees the table as it stood on the 28th, a second one all of it, a third one nothing new."""
    a, base = i["fx_articles"], f"{shared_dir(i.spark)}/pushed/{uuid.uuid4().hex}"
    early = a.where(F.greatest("ai_processed_at", "scraped_at") <= moment("2024-01-28 00:00:00"))
    for seen in (early, a, a):
        M.push_articles(seen, base, NOW(), moment("2024-01-27 00:00:00"))
    return M.pushed(i.spark, base).select("id", ts_text("wm").alias("wm"), F.col("page").cast("int").alias("page"))


@query("push_digests_calls", f"""SELECT 'digest' AS kind, CAST(id AS VARCHAR) AS id, {_T.format(c='created_at')} AS wm FROM {{fx_digests}} WHERE created_at > TIMESTAMP '2000-06-01 00:00:00' UNION ALL
SELECT 'call' AS kind, CAST(id AS VARCHAR) AS id, {_T.format(c='greatest(created_at, outcome_checked_at)')} AS wm FROM {{fx_calls}} WHERE greatest(created_at, outcome_checked_at) > TIMESTAMP '2000-06-01 00:00:00'""")
def _(i: Inputs):
    """Two runs; the second finds nothing."""
    base = f"{shared_dir(i.spark)}/pushed/{uuid.uuid4().hex}"
    for _run in range(2):
        M.push_digests_calls(i["fx_digests"], i["fx_calls"], base, moment("2000-06-01 00:00:00"))
    rows = [M.pushed(i.spark, f"{base}/{name}s").select(F.lit(name).alias("kind"), F.col("id").cast("string").alias("id"), ts_text("wm").alias("wm")) for name in ("digest", "call")]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------- end-to-end flows

def _cycle_sql() -> str:
    here = lambda t: t.replace("{fx_items}", "cycle_items").replace(START, CYCLE_START).replace(END, NOW_NEWS)
    return f"""WITH RECURSIVE {cycle_items_sql()}, {here(INDEX)}, {Z.format(src="idx")}, {here(ATT)}"""


def _cycle(i: Inputs):
    return cycles.news_cycle(i["fx_articles"], i["fx_scores"], moment(CYCLE_START), NOW(), names=NAMES, universe=LINK_UNIVERSE, patterns=PATTERNS,
                             valence_lexicon=VALENCE, positive=POS, negative=NEG, negators=NEGATORS)


@query("news_cycle", f"""{_cycle_sql()} SELECT {_T.format(c='zz.ts')} AS ts, zz.symbol, model, round(idx, 6) AS idx, round(z, 4) AS z, n_lead, n AS att_n, round((n - prior / 330.0 * 6) / sqrt(prior / 330.0 * 6 + 1), 6) AS att_z
FROM zz JOIN att ON zz.symbol = att.symbol AND zz.ts = att.t""")
def _(i: Inputs):
    """Raw articles to hourly index, z-score and attention."""
    return _cycle(i).select(ts_text("ts").alias("ts"), "symbol", "model", rounded("idx").alias("idx"), rounded("z", 4).alias("z"), "n_lead", "att_n", rounded("att_z").alias("att_z"))


@query("news_cycle_alerts", f"""{_cycle_sql()}, h AS (SELECT symbol, ts, z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM zz WHERE model = 'ens' AND abs(z) >= 2 AND n_lead >= 4),
 fl AS (SELECT symbol, rn, ts, z, ts AS last, true AS fired FROM h WHERE rn = 1 UNION ALL
   SELECT h.symbol, h.rn, h.ts, h.z, CASE WHEN h.ts - fl.last >= INTERVAL '6' HOUR THEN h.ts ELSE fl.last END, h.ts - fl.last >= INTERVAL '6' HOUR FROM fl JOIN h ON h.symbol = fl.symbol AND h.rn = fl.rn + 1)
SELECT {_T.format(c='ts')} AS ts, symbol, round(z, 4) AS z FROM fl WHERE fired""")
def _(i: Inputs):
    return cycles.news_alerts(_cycle(i), allowed=[]).select(ts_text("ts").alias("ts"), "symbol", rounded("z", 4).alias("z"))

"""Article tables: filters, edits, scoring, de-duplication, links and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import text as X
from ..operators import articles as A
from ..operators import dedupe as D
from ..operators import reports as R
from ..operators import scoring as N
from ..operators.keyed import latest_per_key, upsert
from ..session import written
from ..sources import tables as T
from .core import NOW_NEWS, Inputs, day_text, joined, moment, query, rounded, ts_text
from .text_queries import LINK_UNIVERSE, NAMES, NEG, NEGATORS, PATTERNS, POS, RATIO, RATIO_CTES, VALENCE, sq



def NOW():
    return moment(NOW_NEWS)


NOW_SQL = f"TIMESTAMP '{NOW_NEWS}'"
HOLD_SQL = f"regexp_matches(title, '{K.HOLDING_TITLE}', 'i')"
_T = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- filters and edits

@query("read_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def _(i: Inputs):
    return T.read_table(i.spark, f"{i.sf}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"],
                        predicate=(F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"))


@query("valid_articles", """SELECT id, title FROM (SELECT id, title, published_at + (CASE id % 4 WHEN 0 THEN -25 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END) * INTERVAL '1' YEAR AS p FROM {fx_articles})
WHERE length(title) > 0 AND year(p) BETWEEN 2000 AND 2025""")
def _(i: Inputs):
    years = F.expr("CASE id % 4 WHEN 0 THEN -25 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END")
    a = i["fx_articles"].withColumn("published_at", F.add_months("published_at", years * 12).cast("timestamp"))
    return A.valid_articles(a, NOW()).select("id", "title")


@query("best_text", """SELECT id, length(coalesce(nullif(full_text, ''), nullif(summary_raw, ''))) AS n, coalesce(nullif(full_text, ''), nullif(summary_raw, '')) AS body FROM {fx_articles}""")
def _(i: Inputs):
    a = i["fx_articles"].select("id", X.best_text(F.col("full_text"), F.col("summary_raw")).alias("body"))
    return a.select("id", F.length("body").cast("double").alias("n"), "body")


@query("fetch_unprocessed", f"""SELECT id, title, {_T.format(c='published_at')} AS published_at, coalesce(nullif(full_text, ''), nullif(summary_raw, '')) AS body
FROM {{fx_articles}} WHERE NOT ai_processed ORDER BY {{fx_articles}}.published_at DESC, id LIMIT 50""")
def _(i: Inputs):
    return A.fetch_unprocessed(i["fx_articles"], 50).select("id", "title", ts_text("published_at").alias("published_at"), F.col("text").alias("body"))


@query("fetch_recent", f"""SELECT id, source, coalesce(nullif(full_text, ''), nullif(summary_raw, '')) AS body FROM {{fx_articles}}
WHERE published_at >= {NOW_SQL} - INTERVAL '72' HOUR AND ai_relevance_score >= 30 ORDER BY published_at DESC, id LIMIT 200""")
def _(i: Inputs):
    return A.fetch_recent(i["fx_articles"], NOW(), 72, 30, limit=200).select("id", "source", F.col("text").alias("body"))


@query("mark_processed", f"""SELECT id, CASE WHEN doc IS NOT NULL OR ai_processed THEN 1 ELSE 0 END AS processed, coalesce(CASE WHEN q = 1 THEN 'bullish' ELSE NULL END, ai_sentiment) AS ai_sentiment,
  CAST(CASE WHEN q = 1 THEN 70 WHEN q = 0 THEN 0 ELSE ai_relevance_score END AS DOUBLE) AS relevance, CASE WHEN q = 0 THEN 'dismiss' ELSE ai_suggested_action END AS action,
  CASE WHEN doc IS NOT NULL THEN {_T.format(c=NOW_SQL)} ELSE {_T.format(c='ai_processed_at')} END AS processed_at
FROM {{fx_articles}} LEFT JOIN (SELECT doc_id AS doc, quality AS q FROM labels) ON id = doc""")
def _(i: Inputs):
    lab = i["labels"].select(F.col("doc_id").alias("id"), "quality")
    e = A.preset_edits(lab.where("quality = 1"), "bullish").unionByName(A.preset_edits(lab.where("quality = 0"), "dismiss"), allowMissingColumns=True)
    m = A.mark_processed(i["fx_articles"], e, NOW())
    return m.select("id", F.col("ai_processed").cast("int").alias("processed"), "ai_sentiment", F.col("ai_relevance_score").cast("double").alias("relevance"),
                    F.col("ai_suggested_action").alias("action"), ts_text("ai_processed_at").alias("processed_at"))


_KEY = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@query("collapse_titles", f"SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY {_KEY} ORDER BY published_at DESC, id DESC) AS rn FROM {{fx_articles}}) WHERE rn = 1")
def _(i: Inputs):
    return A.collapse_titles(i["fx_articles"]).select("id", "title")


@query("news_feed", f"""WITH j AS (SELECT a.id, title, source, published_at, ai_summary IS NOT NULL AS analysed, score AS fb, tickers_raw FROM {{fx_articles}} a
   LEFT JOIN {{fx_scores}} s ON a.id = s.article_id AND s.model = 'finbert' WHERE published_at > {NOW_SQL} - INTERVAL '240' HOUR AND published_at < TIMESTAMP '2024-01-30 00:00:00'
     AND ((source = 'SEC EDGAR' AND list_contains(tickers_raw, 'S1')) OR regexp_matches({r"regexp_replace(title, '[^\x00-\x7f]', 'a', 'g')"}, '\\b(the|and)\\b', 'i')) AND contains(lower(title), 'th') AND score > 0.15),
 p AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY published_at DESC, id DESC) AS rn FROM j)
SELECT id, title, source, analysed, round(fb, 6) AS fb, array_to_string(tickers_raw[1:4], ',') AS tickers FROM (SELECT * FROM p WHERE rn = 1 ORDER BY published_at DESC, id LIMIT 30)""")
def _(i: Inputs):
    f = A.news_feed(i["fx_articles"], i["fx_scores"], NOW(), hours=240, ticker="S1", alias="the|and", q="th", f="pos", before=moment("2024-01-30 00:00:00"), limit=30)
    return f.select("id", "title", "source", "analysed", rounded("fb").alias("fb"), joined("tickers_raw").alias("tickers"))


_DASH = {"all": "true", "bullish": "ai_sentiment = 'bullish'", "bearish": "ai_sentiment = 'bearish'", "high relevance": "ai_relevance_score >= 60", "holdings": HOLD_SQL, "filings": "source = 'SEC EDGAR'"}


@query("dashboard_news", " UNION ALL ".join(f"SELECT '{m}' AS mode, id FROM {{fx_articles}} WHERE {c} AND (contains(lower(title), 'on') OR contains(lower(coalesce(ai_summary, '')), 'on'))" for m, c in _DASH.items()))
def _(i: Inputs):
    from functools import reduce
    parts = [A.dashboard_news(i["fx_articles"], m, "On ").select(F.lit(m).alias("mode"), "id") for m in _DASH]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dashboard_news_counts", "SELECT count(*) AS \"all\", " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {m.replace(' ', '_')}" for m, c in _DASH.items() if m != "all") + " FROM {fx_articles}")
def _(i: Inputs):
    return A.dashboard_news_counts(i["fx_articles"])


WATCH = {"S1": ["s1", "theand"], "NVDA": ["nvda", "heand"], "GOOGL": ["googl"], "ES": ["ción"]}
_WATCH_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS symbol, * FROM {{fx_articles}} WHERE " + " OR ".join(
        f"list_contains(list_transform(list_concat(coalesce(ai_affected_tickers, []), tickers_raw), lambda x: lower(x)), '{k}') OR contains(lower(CONCAT(title, ' ', coalesce(ai_summary, ''))), '{k}')" for k in ks)
    for s, ks in WATCH.items())


@query("match_keywords", f"SELECT symbol, id FROM ({_WATCH_SQL})")
def _(i: Inputs):
    return A.match_keywords(i["fx_articles"], WATCH).select("symbol", "id")


_KEYWORDS = "SELECT CONCAT('P', CAST(p_partkey % 500 AS VARCHAR(20))) AS symbol, LOWER(SUBSTRING(p_name, 1, 1 + p_partkey % 5)) AS keyword FROM {part} UNION SELECT CONCAT('D', CAST(doc_id % 50 AS VARCHAR(20))), LOWER(REGEXP_EXTRACT(text, '[^ ]+ [^ ]+', 0)) FROM {documents} WHERE doc_id % 3 = 0"


@query("match_keyword_table", f"""WITH k AS MATERIALIZED (SELECT DISTINCT symbol, keyword FROM ({_KEYWORDS}) x WHERE keyword <> ''),
 a AS (SELECT id, lower(concat(title, ' ', coalesce(ai_summary, ''))) AS t, list_transform(list_concat(coalesce(ai_affected_tickers, []), coalesce(tickers_raw, [])), lambda x: lower(x)) AS tags FROM {{fx_articles}})
SELECT DISTINCT symbol, id FROM a JOIN k ON contains(t, keyword) OR list_contains(tags, keyword)""")
def _(i: Inputs):
    """The watch list is a table as large as the parts and documents."""
    for t in ("part", "documents"):
        i[t].createOrReplaceTempView(f"watched_{t}")
    watch = i.spark.sql(_KEYWORDS.format(part="watched_part", documents="watched_documents"))
    return A.match_keywords(i["fx_articles"], watch.where("keyword <> ''")).select("symbol", "id")


@query("holding_news_stats", f"""SELECT symbol, count(*) AS matches, count(*) FILTER (WHERE ai_relevance_score >= 55) AS high_relevance,
  count(*) FILTER (WHERE ai_suggested_action = 'buy' OR ai_sentiment = 'bullish') AS bullish, count(*) FILTER (WHERE ai_suggested_action = 'sell' OR ai_sentiment = 'bearish') AS bearish FROM ({_WATCH_SQL}) GROUP BY symbol""")
def _(i: Inputs):
    return R.holding_news_stats(i["fx_articles"], WATCH)


@query("is_recent", f"SELECT id, coalesce(published_at > {NOW_SQL} - INTERVAL '24' HOUR, false) AS recent FROM {{fx_articles}}")
def _(i: Inputs):
    return i["fx_articles"].select("id", A.is_recent(F.col("published_at"), NOW()).alias("recent"))


_WORTHY = f"(ai_relevance_score >= 40 OR ai_summary IS NOT NULL OR {HOLD_SQL})"


@query("mirror_worthy", f"SELECT id FROM {{fx_articles}} WHERE published_at > {NOW_SQL} - INTERVAL '5' DAY AND {_WORTHY}")
def _(i: Inputs):
    return A.mirror_worthy(i["fx_articles"], NOW()).select("id")


@query("apply_retention", f"""SELECT id, CASE WHEN published_at < {NOW_SQL} - INTERVAL '6' DAY THEN NULL ELSE summary_raw END AS summary_raw,
  CAST(length(CASE WHEN published_at < {NOW_SQL} - INTERVAL '6' DAY THEN NULL ELSE full_text END) AS DOUBLE) AS n_full FROM {{fx_articles}}""")
def _(i: Inputs):
    a = A.apply_retention(i["fx_articles"], NOW(), 6)
    return a.select("id", "summary_raw", F.length("full_text").cast("double").alias("n_full"))


@query("expire_health", f"SELECT {_T.format(c='created_at')} AS created_at, source FROM {{fx_health}} WHERE NOT created_at < {NOW_SQL} - INTERVAL '20' DAY")
def _(i: Inputs):
    return A.expire_health(i["fx_health"], NOW(), 20).select(ts_text("created_at").alias("created_at"), "source")


@query("latest_digests", f"SELECT id, {_T.format(c='created_at')} AS created_at, summary FROM {{fx_digests}} ORDER BY {{fx_digests}}.created_at DESC, id DESC LIMIT 60")
def _(i: Inputs):
    return A.latest_rows(i["fx_digests"], 60).select("id", ts_text("created_at").alias("created_at"), "summary")


@query("latest_calls", f"SELECT id, symbol, call FROM {{fx_calls}} ORDER BY created_at DESC, id DESC LIMIT 15")
def _(i: Inputs):
    return A.latest_rows(i["fx_calls"], 15).select("id", "symbol", "call")


@query("high_relevance", "SELECT id, title FROM {fx_articles} WHERE ai_relevance_score >= 60 ORDER BY published_at DESC, id LIMIT 7")
def _(i: Inputs):
    return A.high_relevance(i["fx_articles"]).select("id", "title")


# ---------------------------------------------------------------- joins

@query("articles_with_scores", "SELECT a.id, round(s.score, 6) AS score FROM {fx_articles} a LEFT JOIN {fx_scores} s ON a.id = s.article_id AND s.model = 'finbert'")
def _(i: Inputs):
    return A.articles_with_scores(i["fx_articles"], i["fx_scores"]).select("id", rounded("score").alias("score"))


@query("unscored", "SELECT id FROM {fx_articles} WHERE id NOT IN (SELECT article_id FROM {fx_scores})")
def _(i: Inputs):
    return A.unscored(i["fx_articles"], i["fx_scores"]).select("id")


@query("symbol_enrich", """SELECT c.id, coalesce(u.name, c.symbol) AS name, coalesce(u.sector, '') AS sector FROM (SELECT id, CASE WHEN id % 7 = 0 THEN CONCAT('X', id % 3) ELSE symbol END AS symbol FROM {fx_calls}) c
LEFT JOIN {fx_universe} u ON c.symbol = u.symbol""")
def _(i: Inputs):
    c = i["fx_calls"].select("id", F.expr("CASE WHEN id % 7 = 0 THEN CONCAT('X', CAST(id % 3 AS STRING)) ELSE symbol END").alias("symbol"))
    return A.symbol_enrich(c, i["fx_universe"]).select("id", "name", "sector")


@query("sources_with_overrides", "SELECT s.id, coalesce(o.enabled, s.enabled) AS enabled FROM {fx_sources} s LEFT JOIN (SELECT s_name AS name, s_acctbal > 2000 AS enabled FROM supplier WHERE s_nationkey < 12) o ON s.name = o.name")
def _(i: Inputs):
    o = i["supplier"].where("s_nationkey < 12").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > 2000).alias("enabled"))
    return A.sources_with_overrides(i["fx_sources"], o).select("id", "enabled")


# ---------------------------------------------------------------- scoring

_NUM = r"(?:[+-]?\$\d+(?:\.\d+)?[MBB]?|[+-]?\d+(?:\.\d+)?%)"


def _rule_sql() -> str:
    case = "CASE t " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in VALENCE.items()) + " ELSE 0.0 END"
    return f"""a AS (SELECT id, title, category, tickers_raw, CONCAT(title, ' ', coalesce(nullif(full_text, ''), nullif(summary_raw, ''), '')) AS txt FROM {{fx_articles}}),
  tok AS (SELECT id, unnest(regexp_extract_all(lower(txt), '[a-z'']+')) AS t FROM a),
  vv AS (SELECT id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS z
         FROM (SELECT id, CAST({case} AS DOUBLE) AS v FROM tok) GROUP BY id),
  b AS (SELECT a.id, title, category, tickers_raw, coalesce(s / sqrt(s * s + 15), 0) AS c0, coalesce(p / (p + n + z), 0) AS pos, coalesce(n / (p + n + z), 0) AS neg,
          coalesce(list_sum(list_transform(regexp_extract_all(txt, '{_NUM}'), lambda x: CASE WHEN starts_with(x, '+') THEN 0.5 WHEN starts_with(x, '-') THEN -0.5 ELSE 0.0 END)), 0.0)::DOUBLE AS num
        FROM a LEFT JOIN vv ON a.id = vv.id),
  r AS (SELECT *, greatest(-1.0, least(1.0, CASE WHEN len(tickers_raw) > 0 AND abs(c0 + num * 0.2) > 0.3 THEN (c0 + num * 0.2) * 1.2 ELSE c0 + num * 0.2 END)) AS c FROM b),
  rules AS (SELECT id, round(c, 6) AS compound, CASE WHEN c >= 0.25 THEN 'bullish' WHEN c <= -0.25 THEN 'bearish' WHEN pos > 0.1 AND neg > 0.1 THEN 'mixed' ELSE 'neutral' END AS ai_sentiment,
    greatest(0, least(100, CASE WHEN category = 'sec-filing' THEN 85 ELSE 30 + CASE WHEN len(tickers_raw) > 0 THEN 20 ELSE 0 END + CASE WHEN list_has_any(tickers_raw, ['NVDA', 'MSFT', 'GOOGL', 'ASML']) THEN 25 ELSE 0 END
       + CASE WHEN category IN ('macro', 'energy') THEN 10 ELSE 0 END END + CASE WHEN num <> 0 THEN 15 ELSE 0 END + CASE WHEN contains(lower(title), 'update') OR contains(lower(title), 'alert') THEN 10 ELSE 0 END)) AS ai_relevance_score,
    CASE WHEN category = 'sec-filing' THEN 70 ELSE 40 END AS ai_confidence FROM r)"""


@query("rule_classify", f"WITH {_rule_sql()} SELECT * FROM rules")
def _(i: Inputs):
    return N.rule_classify(i["fx_articles"], lexicon=VALENCE).select("id", rounded("compound").alias("compound"), "ai_sentiment", "ai_relevance_score", "ai_confidence")


@query("bulk_classify", f"""WITH {_rule_sql()} SELECT x.id, CASE WHEN x.ai_processed THEN x.ai_sentiment ELSE u.ai_sentiment END AS ai_sentiment,
  CASE WHEN x.ai_processed THEN x.ai_relevance_score ELSE u.ai_relevance_score END AS ai_relevance_score FROM {{fx_articles}} x JOIN rules u ON x.id = u.id""")
def _(i: Inputs):
    return N.bulk_classify(i["fx_articles"], NOW(), lexicon=VALENCE).select("id", "ai_sentiment", "ai_relevance_score")


_STD = """SELECT *, CASE WHEN {x} IS NULL THEN NULL ELSE greatest(-1.0, least(1.0, ({x} - CASE WHEN count({x}) OVER s >= 8 THEN avg({x}) OVER s ELSE avg({x}) OVER g END)
   / (2.5 * CASE WHEN count({x}) OVER s >= 8 THEN coalesce(nullif(stddev_pop({x}) OVER s, 0), 0.25) ELSE coalesce(nullif(stddev_pop({x}) OVER g, 0), 0.25) END))) END AS {out}
 FROM {src} WINDOW s AS (PARTITION BY source), g AS ()"""


@query("standardise_by_source", "SELECT id, round(std, 6) AS std FROM (" + _STD.format(x="finbert", out="std", src="(SELECT id, finbert, CASE WHEN id % 400 = 3 THEN 'tiny' ELSE source END AS source FROM {fx_items})") + ")")
def _(i: Inputs):
    it = i["fx_items"].select("id", "finbert", F.expr("CASE WHEN id % 400 = 3 THEN 'tiny' ELSE source END").alias("source"))
    return N.standardise_by_source(it, {"finbert": "std"}).select("id", rounded("std").alias("std"))


def _items(i: Inputs):
    return N.score_articles(i["fx_articles"], i["fx_scores"], NAMES, LINK_UNIVERSE, PATTERNS, valence_lexicon=VALENCE, positive=POS, negative=NEG, negators=NEGATORS)


_ITEMS_SQL = f"""a AS (SELECT id, source, published_at, ai_sentiment, lower(CONCAT(title, '. ', summary_raw)) AS txt FROM {{fx_articles}}),
  tok AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(txt, '[a-z'']+') AS w FROM a)),
  sg AS (SELECT id, t, CASE WHEN t IN ({sq(POS)}) THEN 1 WHEN t IN ({sq(NEG)}) THEN -1 ELSE 0 END AS s, lag(g, 1) OVER w AS l1, lag(g, 2) OVER w AS l2, lag(g, 3) OVER w AS l3
      FROM (SELECT *, CASE WHEN t IN ({sq(NEGATORS)}) THEN 1 ELSE 0 END AS g FROM tok) WINDOW w AS (PARTITION BY id ORDER BY pos)),
  pn AS (SELECT id, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN k < 0 THEN 1 ELSE 0 END) AS n FROM (SELECT id, CASE WHEN coalesce(l1, 0) + coalesce(l2, 0) + coalesce(l3, 0) > 0 THEN -s ELSE s END AS k FROM sg) GROUP BY id),
  vv AS (SELECT id, sum(v) AS s FROM (SELECT id, CAST(CASE t {' '.join(f"WHEN '{w}' THEN {v}" for w, v in VALENCE.items())} ELSE 0.0 END AS DOUBLE) AS v FROM tok) GROUP BY id),
  rw AS (SELECT a.id, source, 0.6 * tanh((coalesce(p, 0) - coalesce(n, 0)) / sqrt(coalesce(p, 0) + coalesce(n, 0) + 2.0)) + 0.4 * coalesce(s / sqrt(s * s + 15), 0) AS raw_lex, sc.score AS raw_fb,
    CASE ai_sentiment WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 WHEN 'neutral' THEN 0.0 WHEN 'mixed' THEN 0.0 END AS old
    FROM a LEFT JOIN pn ON a.id = pn.id LEFT JOIN vv ON a.id = vv.id LEFT JOIN {{fx_scores}} sc ON sc.article_id = a.id),
  s1 AS ({_STD.format(x='raw_lex', out='lex', src='rw')}), s2 AS ({_STD.format(x='raw_fb', out='finbert', src='s1')})"""


@query("score_articles", f"""WITH {_ITEMS_SQL} SELECT id, round(raw_lex, 6) AS raw_lex, round(lex, 5) AS lex, round(finbert, 5) AS finbert, CAST(old AS DOUBLE) AS old,
  round(CASE WHEN finbert IS NULL THEN lex ELSE (lex + finbert) / 2 END, 5) AS ens FROM s2""")
def _(i: Inputs):
    return _items(i).select("id", rounded("raw_lex").alias("raw_lex"), rounded("lex", 5).alias("lex"), rounded("finbert", 5).alias("finbert"), "old", rounded("ens", 5).alias("ens"))


def length_scorer(texts: list[str]) -> list[tuple[float, float]]:
    """A stand-in scorer for queries and tests: shares of two letters."""
    return [(t.count("e") / max(len(t), 1), t.count("o") / max(len(t), 1)) for t in texts]


@query("score_with_model", """SELECT article_id, 'finbert' AS model, round(e - o, 9) AS score, round(e, 9) AS p_pos, round(o, 9) AS p_neg FROM (
  SELECT id AS article_id, (length(t) - length(replace(t, 'e', ''))) / length(t) AS e, (length(t) - length(replace(t, 'o', ''))) / length(t) AS o
  FROM (SELECT id, CONCAT(trim(title), '. ', trim(summary_raw)) AS t FROM {fx_articles} WHERE id NOT IN (SELECT article_id FROM {fx_scores}) AND NOT regexp_matches(title, '[Α-Ωα-ωά-ώ]')))""")
def _(i: Inputs):
    s = N.score_with_model(i["fx_articles"], i["fx_scores"], NOW(), length_scorer)
    return s.select("article_id", "model", *[rounded(c, 9).alias(c) for c in ("score", "p_pos", "p_neg")])


@query("scoring_backlog", f"""SELECT count(*) FILTER (WHERE s.article_id IS NULL AND NOT regexp_matches(title, '[Α-Ωα-ωά-ώ]')) AS remaining, count(*) FILTER (WHERE s.article_id IS NOT NULL AND published_at > {NOW_SQL} - INTERVAL '24' HOUR) AS scored_24h,
  count(*) FILTER (WHERE published_at > {NOW_SQL} - INTERVAL '24' HOUR) AS n_24h FROM {{fx_articles}} a LEFT JOIN {{fx_scores}} s ON a.id = s.article_id WHERE published_at > {NOW_SQL} - INTERVAL '30' DAY""")
def _(i: Inputs):
    return N.scoring_backlog(i["fx_articles"], i["fx_scores"], NOW())


def _cells(i: Inputs):
    it = _items(i).withColumn("novelty", F.when(F.col("id") % 4 == 0, 0.25).otherwise(1.0))
    return N.populate_cells(it)


def cycle_items_sql() -> str:
    """CTE ``cycle_items``: scored, linked and clustered articles, one row per article and symbol."""
    from .text_queries import _event_sql, _link_sql
    sw = "CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN {w}" for k, w in K.SOURCE_WEIGHTS) + " ELSE 0.8 END"
    text = "CONCAT(title, '. ', regexp_replace(summary_raw, '[^\\x00-\\x7f]', 'a', 'g'))"
    return f"""{_ITEMS_SQL}, lk AS ({_link_sql()}), {STORY_CTES},
 ev AS (SELECT id, published_at AS ts, CAST({sw} AS DOUBLE) AS src_w, CAST({_event_sql(text, 1)} AS DOUBLE) AS event_w FROM {{fx_articles}}),
 cycle_items AS MATERIALIZED (SELECT ev.id, ts, symbol, CAST(rel AS DOUBLE) AS rel, src_w, event_w, CAST(CASE WHEN leader_id IS NULL THEN 1.0 ELSE 0.25 END AS DOUBLE) AS novelty, coalesce(f.n, 0) AS confirm,
   lex, finbert, CASE WHEN finbert IS NULL THEN lex ELSE (lex + finbert) / 2 END AS ens, old
   FROM ev JOIN s2 ON s2.id = ev.id JOIN lk ON lk.id = ev.id JOIN walk ON walk.id = ev.id LEFT JOIN f ON f.id = ev.id)"""


def _cells_sql() -> str:
    from .text_queries import _link_sql
    ev = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}', 'i') THEN '{n}'" for n, _, p in K.EVENTS) + " ELSE 'other' END"
    pts = "CASE event " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.EVENT_POINTS.items()) + " ELSE 0 END"
    sw = "CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN {w}" for k, w in K.SOURCE_WEIGHTS) + " ELSE 0.8 END"
    macro = sq(K.MACRO)
    return f"""{_ITEMS_SQL}, lk AS ({_link_sql()}),
  ag AS (SELECT id, count(*) FILTER (WHERE rel >= 0.9) AS named, count(*) FILTER (WHERE rel >= 0.7 AND rel < 0.9) AS tagged, count(*) AS any_, count(*) FILTER (WHERE rel >= 0.9 AND symbol IN ('NVDA', 'MSFT', 'GOOGL', 'ASML')) AS hold,
     count(*) FILTER (WHERE rel >= 0.9 AND symbol IN ({macro})) AS mac, list(symbol ORDER BY rel DESC, symbol) FILTER (WHERE symbol NOT IN ({macro})) AS syms FROM lk GROUP BY id),
  e AS (SELECT x.id, title, source, {ev} AS event FROM (SELECT id, title, source, CONCAT(title, '. ', regexp_replace(summary_raw, '[^\\x00-\\x7f]', 'a', 'g')) AS t FROM {{fx_articles}}) x),
  c AS (SELECT e.id, event, regexp_matches(title, '[Α-Ωα-ωά-ώ]') AS greek, coalesce(raw_fb, raw_lex) AS basis, raw_fb, {sw} AS w, coalesce(named, 0) AS named, coalesce(tagged, 0) AS tagged, coalesce(any_, 0) AS any_, coalesce(hold, 0) AS hold,
     coalesce(mac, 0) AS mac, coalesce(syms, []) AS syms FROM e JOIN (SELECT id, raw_lex, raw_fb FROM rw) rw ON e.id = rw.id LEFT JOIN ag ON e.id = ag.id),
  rl AS (SELECT *, CASE WHEN hold > 0 THEN 45 WHEN named > 0 THEN 25 WHEN tagged > 0 THEN 10 WHEN any_ > 0 THEN 6 ELSE 0 END + {pts} + CASE WHEN w >= 1.2 THEN 8 WHEN w >= 1.0 THEN 4 WHEN w <= 0.7 THEN -4 ELSE 0 END
     + CAST(round_even(abs(basis) * 15, 0) AS INT) - CASE WHEN id % 4 = 0 THEN 25 ELSE 0 END + CASE WHEN mac > 0 AND hold = 0 THEN 8 ELSE 0 END AS rel0 FROM c),
  cells AS (SELECT id, CASE WHEN greek THEN 'neutral' WHEN basis > 0.25 THEN 'bullish' WHEN basis < -0.25 THEN 'bearish' ELSE 'neutral' END AS ai_sentiment,
     greatest(0, least(100, CASE WHEN greek THEN least(rel0, 30) ELSE rel0 END)) AS ai_relevance_score, array_to_string(syms[1:5], ',') AS tickers, CAST(trunc(least(100, abs(basis) * 100)) AS INT) AS ai_confidence,
     round(raw_fb, 4) AS fb_score, event, CASE WHEN greek THEN 'el' ELSE 'en' END AS lang FROM rl)"""


@query("populate_cells", f"WITH {_cells_sql()} SELECT * FROM cells")
def _(i: Inputs):
    return _cells(i).withColumn("tickers", joined("ai_affected_tickers")).drop("ai_affected_tickers")


@query("populate_summary", f"WITH {_cells_sql()} SELECT ai_sentiment, count(*) AS n, count(*) FILTER (WHERE ai_relevance_score >= 60) AS n_high FROM cells GROUP BY ai_sentiment")
def _(i: Inputs):
    return N.populate_summary(_cells(i))


def _stored_cells(c):
    """A stored copy of the cells ``c`` in which some rows differ."""
    return c.select("id", F.when(F.col("id") % 4 == 0, "note").alias("ai_summary"), F.when(F.col("id") % 3 == 0, "mixed").otherwise(F.col("ai_sentiment")).alias("ai_sentiment"), "ai_relevance_score",
                    F.reverse("ai_affected_tickers").alias("ai_affected_tickers"), "ai_confidence", "fb_score", F.when(F.col("id") % 16 == 0, "stale").otherwise(F.col("event")).alias("event"), "lang")


@query("cells_delta", f"""WITH {_cells_sql()} SELECT id, id % 4 = 0 AS analysed, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'mixed' ELSE ai_sentiment END AS ai_sentiment, event FROM cells
WHERE (id % 4 = 0 AND id % 16 = 0) OR (id % 4 <> 0 AND id % 3 = 0)""")
def _(i: Inputs):
    """Both sides come from cells that are written once, so texts are scored once."""
    c = written(_cells(i), "cells")
    return N.cells_delta(_stored_cells(c), c).select("id", "analysed", "ai_sentiment", "event")


# ---------------------------------------------------------------- de-duplication and links

@query("dedupe_url_last", "SELECT url, id, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS rn FROM {fx_articles}) WHERE rn = 1")
def _(i: Inputs):
    return D.dedupe_url_last(i["fx_articles"], "id").select("url", "id", "title")


@query("dedupe_url_merge", """SELECT url, min(id) AS id, arg_min(title, id) AS title, array_to_string(list_sort(list_distinct(flatten(list(tickers_raw)))), ',') AS tickers FROM {fx_articles} GROUP BY url""")
def _(i: Inputs):
    return D.dedupe_url_merge(i["fx_articles"], "id").select("url", "id", "title", joined("tickers_raw").alias("tickers"))


@query("fuzzy_title_dedupe", f"""WITH RECURSIVE titles AS MATERIALIZED (SELECT title AS s, min(id) AS id FROM {{fx_articles}} WHERE title IS NOT NULL GROUP BY title), {RATIO_CTES},
 hist AS MATERIALIZED (SELECT s, c, count(*) AS k FROM (SELECT s, unnest(string_split(s, '')) AS c FROM titles) GROUP BY ALL),
 bound AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM masked a JOIN titles b ON (a.n < length(b.s) OR (a.n = length(b.s) AND a.s < b.s)) AND 200 * a.n > 85 * (a.n + length(b.s))
   JOIN hist h ON h.s = a.s JOIN hist g ON g.s = b.s AND g.c = h.c GROUP BY a.s, b.s, a.n HAVING 200 * sum(least(h.k, g.k)) > 85 * (a.n + length(b.s))),
 pairs AS MATERIALIZED (SELECT x, y FROM bound JOIN masked a ON a.s = x JOIN titles b ON b.s = y WHERE {RATIO} > 85),
 near AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
 stored AS (SELECT DISTINCT title AS s FROM (SELECT title FROM {{fx_articles}} WHERE id % 2 = 0 ORDER BY published_at DESC, id LIMIT 200)),
 fresh AS (SELECT t.id, t.s, row_number() OVER (ORDER BY t.id) AS rn FROM titles t WHERE t.s NOT IN (SELECT s FROM stored) AND t.s NOT IN (SELECT x FROM near WHERE y IN (SELECT s FROM stored))),
 ranked AS MATERIALIZED (SELECT f.rn, f.id, f.s, list(o.rn) FILTER (WHERE o.rn IS NOT NULL) AS others FROM fresh f LEFT JOIN near ON near.x = f.s LEFT JOIN fresh o ON o.s = near.y AND o.rn < f.rn GROUP BY ALL),
 walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, false AS stays
   UNION ALL SELECT r.rn, CASE WHEN coalesce(list_has_any(r.others, kept), false) THEN kept ELSE list_append(kept, r.rn) END, NOT coalesce(list_has_any(r.others, kept), false) FROM walk JOIN ranked r ON r.rn = walk.rn + 1)
SELECT r.id, r.s AS title FROM walk JOIN ranked r ON r.rn = walk.rn WHERE stays""")
def _(i: Inputs):
    """Titles kept against the 200 newest stored ones (the even ids) and each other."""
    a = i["fx_articles"].select("id", "title", "published_at", F.col("id").alias("ordinal"))
    recent = a.where("id % 2 = 0").orderBy(F.desc("published_at"), "id").limit(200)
    return D.fuzzy_title_dedupe(a, recent).select("id", "title")


_SET = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z'']+'), lambda w: length(w) > 3))), ' ')"


def _titled(i: Inputs):
    return i["fx_articles"].select("id", F.col("published_at").alias("ts"), X.title_tokens(F.col("title")).alias("ntitle"))


@query("near_duplicate_titles", f"""WITH t AS (SELECT {_SET} AS k, published_at AS ts FROM {{fx_articles}}), s AS (SELECT DISTINCT k, string_split(k, ' ') AS w FROM t WHERE k <> ''),
 p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM s a JOIN s b ON a.k < b.k),
 q AS (SELECT a, b, n / (m - n) AS jaccard FROM p WHERE n / (m - n) >= 0.6)
SELECT a AS title_set, b AS similar_set, round(jaccard, 6) AS jaccard FROM q WHERE EXISTS (SELECT 1 FROM t x JOIN t y ON x.k = q.a AND y.k = q.b AND abs(epoch(x.ts) - epoch(y.ts)) <= 172800)""")
def _(i: Inputs):
    return D.near_duplicate_titles(_titled(i)).withColumn("jaccard", rounded("jaccard"))


STORY_CTES = f"""r AS MATERIALIZED (SELECT id, epoch_us(published_at) AS t, {_SET} AS k, row_number() OVER (ORDER BY published_at, id) AS rn FROM {{fx_articles}}),
 s AS (SELECT DISTINCT k, string_split(k, ' ') AS w FROM r WHERE k <> ''),
 p AS MATERIALIZED (SELECT a.k AS k, list(b.k) AS near FROM s a JOIN s b ON len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-12 GROUP BY 1),
 walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader_id, CAST([] AS STRUCT(id BIGINT, t BIGINT, k VARCHAR)[]) AS leaders
   UNION ALL SELECT rn, id, hit.id, CASE WHEN hit IS NULL THEN list_append(open, {{'id': id, 't': t, 'k': k}}) ELSE open END
   FROM (SELECT r.rn, r.id, r.t, r.k, open, list_last(list_filter(open, lambda l: list_contains(p.near, l.k))) AS hit
     FROM (SELECT r.*, list_filter(walk.leaders, lambda l: r.t - l.t <= 172800000000) AS open FROM walk JOIN r ON r.rn = walk.rn + 1) r LEFT JOIN p ON p.k = r.k)),
 f AS (SELECT leader_id AS id, count(*) AS n FROM walk WHERE leader_id IS NOT NULL GROUP BY 1)"""


@query("story_clusters", f"""WITH RECURSIVE {STORY_CTES} SELECT walk.id, CAST(CASE WHEN leader_id IS NULL THEN 1.0 ELSE 0.25 END AS DOUBLE) AS novelty, leader_id, CAST(coalesce(f.n, 0) AS INT) AS confirm FROM walk LEFT JOIN f ON f.id = walk.id WHERE walk.rn > 0""")
def _(i: Inputs):
    return D.story_clusters(_titled(i)).select("id", "novelty", "leader_id", "confirm")


_RESOLVED = "CASE WHEN length(symbol) > 0 THEN trim(symbol) " + " ".join(f"WHEN contains(lower(ticker_or_theme), '{k}') THEN '{s}'" for k, s in K.THEME_SYMBOLS) + " ELSE ticker_or_theme END"


@query("dedupe_calls", f"""SELECT view, call, CAST(day AS VARCHAR) AS day, id FROM (SELECT *, row_number() OVER (PARTITION BY view, call, day ORDER BY created_at, id) AS rn FROM
  (SELECT *, {_RESOLVED} AS view, CAST(created_at AS DATE) AS day FROM {{fx_calls}} WHERE call <> 'neutral')) WHERE rn = 1""")
def _(i: Inputs):
    return D.dedupe_calls(i["fx_calls"]).select("view", "call", day_text("day").alias("day"), "id")


_REC3 = f"published_at >= {NOW_SQL} - INTERVAL '3' DAY"


@query("mirror_selection", f"""WITH r AS (SELECT * FROM {{fx_articles}} WHERE {_REC3}), u AS (SELECT * FROM (SELECT * FROM r WHERE ai_relevance_score >= 60 ORDER BY published_at DESC, id LIMIT 1000) UNION ALL
  SELECT * FROM (SELECT * FROM r WHERE list_has_any(tickers_raw, ['NVDA', 'MSFT', 'GOOGL', 'ASML']) ORDER BY published_at DESC, id LIMIT 1000) UNION ALL SELECT * FROM (SELECT * FROM r WHERE ai_summary IS NOT NULL ORDER BY published_at DESC, id LIMIT 500))
SELECT url, min(id) AS id FROM u GROUP BY url""")
def _(i: Inputs):
    return A.mirror_selection(i["fx_articles"], NOW(), k=1000, k_analysed=500).select("url", "id")


@query("latest_per_key", f"SELECT source, id, {_T.format(c='published_at')} AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id DESC) AS rn FROM {{fx_articles}}) WHERE rn = 1")
def _(i: Inputs):
    return latest_per_key(i["fx_articles"].select("source", "id", "published_at"), ["source"], ["published_at", "id"]).select("source", "id", ts_text("published_at").alias("published_at"))


_LINKS = f"""tg AS (SELECT DISTINCT id, published_at, upper(trim(t)) AS tk FROM (SELECT id, published_at, unnest(CASE WHEN len(ai_affected_tickers) > 0 THEN ai_affected_tickers ELSE tickers_raw END) AS t FROM {{fx_articles}}
   WHERE published_at >= {NOW_SQL} - INTERVAL '72' HOUR) WHERE trim(t) <> '' AND length(trim(t)) <= 6 AND upper(trim(t)) NOT IN ({sq(K.LINK_STOPWORDS)}))"""
_LINK_LIST = f"""{_LINKS}, lp AS (SELECT DISTINCT a.id, b.id AS other, b.published_at AS ts FROM tg a JOIN tg b ON a.tk = b.tk AND a.id <> b.id),
  lr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, other) AS rn FROM lp)"""


@query("correlated_articles", f"WITH {_LINK_LIST} SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rn) AS links FROM lr WHERE rn <= 20 GROUP BY id")
def _(i: Inputs):
    c = D.correlated_articles(i["fx_articles"], NOW())
    return c.select("id", F.array_join(F.col("ai_correlated_article_ids").cast("array<string>"), ",").alias("links"))


@query("top_clusters", f"WITH {_LINKS} SELECT tk AS ticker, count(*) AS n FROM tg GROUP BY tk HAVING count(*) >= 2 ORDER BY n DESC, tk LIMIT 10")
def _(i: Inputs):
    return D.top_clusters(i["fx_articles"], NOW())


@query("related_articles", f"WITH {_LINK_LIST}, f AS (SELECT min(id) AS id FROM lr) SELECT a.id, a.title FROM {{fx_articles}} a WHERE a.id IN (SELECT other FROM lr WHERE rn <= 20 AND id = (SELECT id FROM f))")
def _(i: Inputs):
    links = D.correlated_articles(i["fx_articles"], NOW())
    return D.related_articles(i["fx_articles"], links, links.agg(F.min("id")).scalar()).select("id", "title")


@query("upsert_ignore", "SELECT id, source FROM {fx_articles} WHERE id % 3 <> 0 UNION ALL SELECT id, 'batch' AS source FROM {fx_articles} WHERE id % 3 = 0")
def _(i: Inputs):
    a = i["fx_articles"].select("id", "source")
    return upsert(a.where("id % 3 <> 0"), a.withColumn("source", F.lit("batch")), ["id"], "ignore")


@query("upsert_overwrite", "SELECT id, CASE WHEN id % 2 = 0 THEN 'batch' ELSE source END AS source FROM {fx_articles}")
def _(i: Inputs):
    a = i["fx_articles"].select("id", "source")
    return upsert(a, a.where("id % 2 = 0").withColumn("source", F.lit("batch")), ["id"], "overwrite")


@query("align_to_schema", "SELECT id, title, lang FROM {fx_articles}")
def _(i: Inputs):
    return T.align_to_schema(i["fx_articles"], ["lang", "id", "title", "not_there"])


# ---------------------------------------------------------------- reports

@query("article_counts", f"""SELECT count(*) AS total, count(*) FILTER (WHERE published_at > {NOW_SQL} - INTERVAL '1' HOUR) AS h1, count(*) FILTER (WHERE published_at > {NOW_SQL} - INTERVAL '24' HOUR) AS h24,
 count(*) FILTER (WHERE published_at > {NOW_SQL} - INTERVAL '24' HOUR AND ai_relevance_score >= 40) AS worthy24, {_T.format(c='max(published_at)')} AS newest FROM {{fx_articles}}""")
def _(i: Inputs):
    return R.article_counts(i["fx_articles"], NOW()).withColumn("newest", ts_text("newest"))


@query("articles_per_day", f"SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM {{fx_articles}} WHERE published_at > {NOW_SQL} - INTERVAL '14' DAY GROUP BY 1")
def _(i: Inputs):
    return R.articles_per_day(i["fx_articles"], NOW()).withColumn("day", day_text("day"))


@query("sentiment_mix", f"SELECT coalesce(ai_sentiment, 'none') AS sentiment, count(*) AS n FROM {{fx_articles}} WHERE published_at > {NOW_SQL} - INTERVAL '24' HOUR GROUP BY 1")
def _(i: Inputs):
    return R.sentiment_mix(i["fx_articles"], NOW())


@query("source_kinds", "SELECT kind, count(*) AS n, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE fail_count >= 3) AS failing FROM {fx_sources} GROUP BY kind")
def _(i: Inputs):
    return R.source_kinds(i["fx_sources"])


@query("failing_sources", "SELECT name, fail_count FROM {fx_sources} WHERE fail_count >= 3 ORDER BY fail_count DESC, name LIMIT 8")
def _(i: Inputs):
    return R.failing_sources(i["fx_sources"]).select("name", "fail_count")


@query("ingest_runs", f"SELECT {_T.format(c='created_at')} AS created_at, entries_fetched, errors FROM {{fx_health}} WHERE source = 'INGEST_ALL' AND {{fx_health}}.created_at > {NOW_SQL} - INTERVAL '72' HOUR")
def _(i: Inputs):
    return R.ingest_runs(i["fx_health"], NOW(), 72).withColumn("created_at", ts_text("created_at"))


@query("source_health", """SELECT source, CAST(sum(entries) AS BIGINT) AS entries_fetched, count(*) FILTER (WHERE status NOT IN (200, 304)) AS errors, count(*) FILTER (WHERE fetch_state = 'ok') AS full_text_fetched,
  count(*) FILTER (WHERE fetch_state = 'failed') AS full_text_failed, count(*) FILTER (WHERE fetch_state = 'skipped') AS skipped_domains FROM {fx_fetches} GROUP BY source""")
def _(i: Inputs):
    return R.source_health(i["fx_fetches"])


@query("status_codes", "SELECT status, count(*) AS n FROM {fx_fetches} GROUP BY status")
def _(i: Inputs):
    return R.status_codes(i["fx_fetches"])


@query("ticker_heatmap", """SELECT t AS ticker, count(*) AS total, count(*) FILTER (WHERE ai_sentiment = 'bullish') AS bullish, count(*) FILTER (WHERE ai_sentiment = 'bearish') AS bearish,
  count(*) FILTER (WHERE ai_sentiment = 'bullish') - count(*) FILTER (WHERE ai_sentiment = 'bearish') AS net FROM (SELECT unnest(tickers_raw) AS t, ai_sentiment FROM {fx_articles}) GROUP BY t ORDER BY total DESC, t LIMIT 16""")
def _(i: Inputs):
    return R.ticker_heatmap(i["fx_articles"])


_VALUE = "h.symbol, shares * price / CASE WHEN currency = 'USD' THEN 1.08 ELSE 1.0 END AS v FROM {fx_holdings} h LEFT JOIN {fx_quotes} q ON h.symbol = q.symbol"


@query("holdings_quotes", f"SELECT symbol, round(v, 4) AS value_eur FROM (SELECT {_VALUE})")
def _(i: Inputs):
    return R.holdings_quotes(i["fx_holdings"], i["fx_quotes"], F.lit(1.08)).select("symbol", rounded("value_eur", 4).alias("value_eur"))


@query("portfolio_value", f"SELECT count(*) AS n, round(sum(v), 2) AS total_eur, true AS all_priced, round(sum(v) - 1000000, 2) AS unrealized_eur, round((sum(v) - 1000000) / 1000000 * 100, 4) AS unrealized_pct FROM (SELECT {_VALUE})")
def _(i: Inputs):
    p = R.portfolio_value(i["fx_holdings"], i["fx_quotes"], F.lit(1.08), F.lit(1_000_000.0))
    return p.select("n", rounded("total_eur", 2).alias("total_eur"), "all_priced", rounded("unrealized_eur", 2).alias("unrealized_eur"), rounded("unrealized_pct", 4).alias("unrealized_pct"))


@query("portfolio_weights", f"SELECT symbol, round(v / sum(v) OVER () * 100, 8) AS weight_pct FROM (SELECT {_VALUE})")
def _(i: Inputs):
    return R.portfolio_weights(i["fx_holdings"], i["fx_quotes"], F.lit(1.08)).select("symbol", rounded("weight_pct", 8).alias("weight_pct"))


@query("digest_coverage", f"SELECT {_T.format(c=NOW_SQL + chr(32) + chr(45) + chr(32) + 'INTERVAL 24 HOUR')} AS period_start, count(*) AS articles_covered FROM {{fx_articles}} WHERE published_at >= {NOW_SQL} - INTERVAL '24' HOUR")
def _(i: Inputs):
    return R.digest_coverage(i["fx_articles"], NOW()).select(ts_text("period_start").alias("period_start"), "articles_covered")


@query("write_digest", f"SELECT CAST(id AS VARCHAR) AS id, summary, 0 AS themes FROM {{fx_digests}} UNION ALL SELECT 'new' AS id, CONCAT('day in review ', '') AS summary, 2 AS themes")
def _(i: Inputs):
    d = R.write_digest(i["fx_digests"].withColumn("id", F.col("id").cast("string")), i["fx_articles"], NOW(), "day in review ", "rates, oil", digest_id="new")
    return d.select("id", "summary", F.coalesce(F.size("key_themes"), F.lit(0)).alias("themes")).withColumn("themes", F.greatest("themes", F.lit(0)))


@query("stale_sources", f"SELECT id, name FROM {{fx_sources}} WHERE enabled AND (last_fetch IS NULL OR epoch({NOW_SQL}) - epoch(last_fetch) >= poll_minutes * 60 * 0.9)")
def _(i: Inputs):
    return R.stale_sources(i["fx_sources"], NOW()).select("id", "name")


@query("source_state_update", f"""WITH s AS (SELECT *, NOT enabled AND coalesce(last_fetch < {NOW_SQL} - INTERVAL '7' DAY, false) AS dead FROM {{fx_sources}}), v AS (SELECT s.*, CASE WHEN dead THEN 0 ELSE fail_count END AS f, enabled OR dead AS en FROM s)
SELECT v.id, CASE WHEN r.status = 'skipped' THEN f WHEN r.status IN ('200', '304') THEN 0 ELSE f + 1 END AS fail_count, CASE WHEN r.status = 'skipped' THEN en WHEN r.status IN ('200', '304') THEN true ELSE f + 1 < 12 END AS enabled,
  CASE WHEN r.status IN ('200', '304') THEN 'e1' ELSE v.etag END AS etag, CASE WHEN r.status = 'skipped' THEN items_total ELSE items_total + r.n END AS items_total, {_T.format(c=f"CASE WHEN r.status = 'skipped' THEN last_fetch ELSE {NOW_SQL} END")} AS last_fetch
FROM v JOIN {{fx_results}} r ON v.id = r.id""")
def _(i: Inputs):
    return R.source_state_update(i["fx_sources"], i["fx_results"], NOW()).select("id", "fail_count", "enabled", "etag", "items_total", ts_text("last_fetch").alias("last_fetch"))


_SINCE = f"{{fx_articles}}.published_at > {NOW_SQL} - INTERVAL"


@query("status_report", f"""SELECT CAST({NOW_SQL} AS VARCHAR) AS updated_at, (SELECT count(*) FROM {{fx_articles}}) AS total, (SELECT count(*) FROM {{fx_articles}} WHERE {_SINCE} '1' HOUR) AS h1,
 (SELECT count(*) FROM {{fx_articles}} WHERE {_SINCE} '24' HOUR) AS h24, (SELECT count(*) FROM {{fx_articles}} WHERE {_SINCE} '24' HOUR AND ai_relevance_score >= 40) AS worthy24,
 (SELECT count(*) FROM {{fx_articles}} a WHERE published_at > {NOW_SQL} - INTERVAL '30' DAY AND NOT regexp_matches(title, '[Α-Ωα-ωά-ώ]') AND id NOT IN (SELECT article_id FROM {{fx_scores}} WHERE article_id IS NOT NULL)) AS remaining,
 (SELECT string_agg(concat(kind, ':', n, ':', e, ':', f), ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n, count(*) FILTER (enabled) AS e, count(*) FILTER (fail_count >= 3) AS f FROM {{fx_sources}} GROUP BY 1)) AS kinds,
 (SELECT string_agg(concat(d, ':', n), ',' ORDER BY d) FROM (SELECT CAST(published_at AS DATE) AS d, count(*) AS n FROM {{fx_articles}} WHERE {_SINCE} '14' DAY GROUP BY 1)) AS days,
 (SELECT coalesce(string_agg(concat(s, ':', n), ',' ORDER BY s), '') FROM (SELECT coalesce(ai_sentiment, 'none') AS s, count(*) AS n FROM {{fx_articles}} WHERE {_SINCE} '24' HOUR GROUP BY 1)) AS mix,
 (SELECT count(*) FROM {{fx_health}} WHERE source = 'INGEST_ALL' AND {{fx_health}}.created_at > {NOW_SQL} - INTERVAL '24' HOUR) AS runs""")
def _(i: Inputs):
    """The document taken apart again."""
    r = R.status_report(i["fx_articles"], i["fx_scores"], i["fx_sources"], i["fx_health"], NOW())
    kind = ("counts struct<total:long,h1:long,h24:long,worthy24:long>, scoring struct<remaining:long>, sources array<struct<kind:string,n:long,enabled:long,failing:long>>, "
            "per_day array<struct<day:string,n:long>>, mix24 array<struct<sentiment:string,n:long>>, ingest array<struct<created_at:string>>")
    flat = lambda c, *fs: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fs])), ",")
    return r.select(ts_text("updated_at").alias("updated_at"), F.from_json("data", kind).alias("d")).select(
        "updated_at", "d.counts.*", "d.scoring.remaining", flat("d.sources", "kind", "n", "enabled", "failing").alias("kinds"), flat("d.per_day", "day", "n").alias("days"),
        flat("d.mix24", "sentiment", "n").alias("mix"), F.coalesce(F.size("d.ingest"), F.lit(0)).cast("long").alias("runs"))


# ---------------------------------------------------------------- notifications and increments

_CAND = f"""cand AS (SELECT *, list_filter(['NVDA', 'MSFT', 'GOOGL', 'ASML'], lambda h: list_contains(CASE WHEN len(ai_affected_tickers) > 0 THEN ai_affected_tickers ELSE tickers_raw END, h)) AS held FROM
  (SELECT * FROM {{fx_articles}} WHERE ai_processed AND ai_relevance_score >= 70 AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)))"""


def _candidates(i: Inputs):
    return A.notify_candidates(i["fx_articles"], i["labels"].where("quality = 0").select(F.col("doc_id").alias("id")))


@query("notify_candidates", f"WITH {_CAND} SELECT id, title, array_to_string(list_sort(held), ',') AS held FROM cand WHERE len(held) > 0")
def _(i: Inputs):
    return _candidates(i).select("id", "title", joined(F.array_sort("held")).alias("held"))


@query("phone_alerts", f"WITH {_CAND} SELECT id FROM cand WHERE len(held) > 0 AND published_at > {NOW_SQL} - INTERVAL '24' HOUR AND ((list_contains(held, 'GOOGL') AND regexp_matches(title, 'th|en', 'i')) OR (list_contains(held, 'NVDA') AND regexp_matches(title, 'and', 'i'))) AND (length(ai_summary) > 0 OR ai_relevance_score >= 85) ORDER BY published_at DESC, id LIMIT 3")
def _(i: Inputs):
    return A.phone_alerts(_candidates(i), NOW(), aliases={"GOOGL": "th|en", "NVDA": "and"}).select("id")


@query("notify_digests", "SELECT id, summary FROM {fx_digests} WHERE id % 2 = 0 ORDER BY created_at DESC, id DESC LIMIT 5")
def _(i: Inputs):
    d = i["fx_digests"]
    return A.notify_digests(d, d.where("id % 2 = 1").select("id")).select("id", "summary")


@query("incremental_articles", f"""SELECT id, {_T.format(c='wm')} AS wm FROM (SELECT id, greatest(coalesce(ai_processed_at, TIMESTAMP '1970-01-01 00:00:00'), coalesce(scraped_at, TIMESTAMP '1970-01-01 00:00:00')) AS wm FROM {{fx_articles}}
  WHERE published_at > {NOW_SQL} - INTERVAL '5' DAY AND {_WORTHY}) s WHERE s.wm > TIMESTAMP '2024-01-28 00:00:00'""")
def _(i: Inputs):
    return A.incremental_articles(i["fx_articles"], moment("2024-01-28 00:00:00"), NOW()).select("id", ts_text("wm").alias("wm"))


@query("incremental_digests_calls", """SELECT 'digest' AS kind, CAST(id AS VARCHAR) AS id FROM {fx_digests} WHERE created_at > TIMESTAMP '2000-06-01 00:00:00' UNION ALL
SELECT 'call' AS kind, CAST(id AS VARCHAR) AS id FROM {fx_calls} WHERE created_at > TIMESTAMP '2000-06-01 00:00:00' OR outcome_checked_at > TIMESTAMP '2000-06-01 00:00:00'""")
def _(i: Inputs):
    return A.incremental_digests_calls(i["fx_digests"], i["fx_calls"], moment("2000-06-01 00:00:00")).select("kind", "id")

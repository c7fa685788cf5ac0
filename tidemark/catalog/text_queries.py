"""Text and scalar operators over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import stats as S
from ..functions import text as X
from ..operators.scoring import company_dictionary, link_symbols
from ..operators.sentiment import by_symbol
from ..sources import feeds
from .core import Inputs, day_text, joined, moment, query, rounded, ts_text

POS, NEG, NEGATORS = ["that", "with", "ener", "tion"], ["this", "than", "ouan", "inand"], ["the", "not", "las"]
VALENCE = {"the": 0.5, "and": -0.5, "that": 1.5, "with": -2.0, "this": 1.5, "der": 1.0, "las": -1.0}
PATTERNS = {"AAA": r"\bthe\b", "BBB": r"tion\b", "CCC": r"(?-i:\bEn\b)|oned", "RATES": r"heand|thand"}
NAMES = {"Theand": "S1", "Theand thble": "S2", "And": "S3", "Erreth was": "NVDA"}
LINK_UNIVERSE = [f"S{i}" for i in range(20)] + ["NVDA", "MSFT"]

sq = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
ASCII = r"regexp_replace({c}, '[^\x00-\x7f]', 'a', 'g')"


_FOUND = rf"""list_concat(list_filter(regexp_extract_all(t, '\b[A-Z]{{2,5}}\b'), lambda x: x NOT IN ({sq(K.TICKER_STOPWORDS)})),
    list_transform(regexp_extract_all(lower(t), '\b({"|".join(sorted(K.COMPANY_ALIASES, key=len, reverse=True))})\b'),
                   lambda x: CASE x {" ".join("WHEN '%s' THEN '%s'" % kv for kv in K.COMPANY_ALIASES.items())} END))"""


@query("extract_tickers", rf"""
SELECT doc_id AS id, array_to_string(list_sort(list_distinct({_FOUND})), ',') AS tickers
FROM (SELECT doc_id, {ASCII.format(c="text")} AS t FROM documents)""")
def _(i: Inputs):
    return i["documents"].select(F.col("doc_id").alias("id"), joined(X.extract_tickers(F.col("text"))).alias("tickers"))


_TAG_UNIVERSE = ["FURN", "MACH", "AU-B", "BU-B", "BUIL", "HO-B", "AUTO", "MA-B"]


@query("tickers_in", f"""
WITH t AS (SELECT c_custkey AS id, list_concat(['x'], regexp_extract_all(s, '\\$([A-Z]{{1,5}})\\b', 1)) AS a,
           list_transform(regexp_extract_all(s, '\\((?:NASDAQ|NYSE|NYSEARCA|NYSEAMERICAN|AMEX)[:\\s]+([A-Z][A-Z.\\-]{{0,5}})\\)', 1), lambda x: replace(x, '.', '-')) AS b
    FROM (SELECT c_custkey, CONCAT(c_name, ' $', substring(c_mktsegment, 1, 4), ' (NYSE: ', substring(c_mktsegment, 1, 2), '.B) $x') AS s FROM customer))
SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(a, b), lambda x: x IN ({sq(_TAG_UNIVERSE)})))), ',') AS tickers FROM t""")
def _(i: Inputs):
    text = F.concat("c_name", F.lit(" $"), F.substring("c_mktsegment", 1, 4), F.lit(" (NYSE: "), F.substring("c_mktsegment", 1, 2), F.lit(".B) $x"))
    return i["customer"].select(F.col("c_custkey").alias("id"), joined(X.tickers_in(text, _TAG_UNIVERSE)).alias("tickers"))


def _link_sql() -> str:
    t, s = ASCII.format(c="title"), ASCII.format(c="summary_raw")
    parts = [f"SELECT id, '{sym}' AS symbol, CASE WHEN regexp_matches({t}, '{p}', 'i') THEN 1.0 ELSE 0.5 END AS rel FROM {{fx_articles}} "
             f"WHERE regexp_matches({t}, '{p}', 'i') OR regexp_matches({s}, '{p}', 'i')" for sym, p in PATTERNS.items()]
    rx = "(" + "|".join(sorted(NAMES, key=lambda n: (-len(n), n))) + ")"
    name_case = "CASE m " + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in NAMES.items()) + " END"
    for col, rel in (("title", 1.0), ("summary_raw", 0.5)):
        parts.append(f"SELECT id, {name_case} AS symbol, {rel} AS rel FROM (SELECT id, unnest(regexp_extract_all({col}, '{rx}', 1)) AS m FROM {{fx_articles}})")
    parts.append(f"SELECT id, tk AS symbol, 0.8 AS rel FROM (SELECT id, unnest(tickers_raw) AS tk FROM {{fx_articles}}) WHERE tk IN ({sq(LINK_UNIVERSE)})")
    return ("SELECT id, symbol, max(CAST(rel AS DOUBLE)) AS rel FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1, 2")


@query("symbols_of", _link_sql())
def _(i: Inputs):
    a = link_symbols(i["fx_articles"].select("id", "title", "summary_raw", "tickers_raw"), NAMES, PATTERNS, LINK_UNIVERSE)
    return by_symbol(a.select("id", "syms"))


#: Names from the corpus itself, the first two words of every seventh document, and company names: more than a plan should hold as literals.
_NAMED = "SELECT CONCAT('D', CAST(MIN(doc_id) AS VARCHAR(20))) AS symbol, name FROM (SELECT doc_id, REGEXP_EXTRACT(text, '^[^ ]+ [^ .,]+', 0) AS name FROM {documents} WHERE doc_id % 7 = 0) d WHERE LENGTH(name) >= 4 GROUP BY name"
_ESCAPED = r"regexp_replace(name, '([\\.^$|?*+()\[\]{{}}&-])', '\\\1', 'g')"


@query("symbols_from_universe", rf"""WITH n AS MATERIALIZED ({_NAMED}),
 a AS (SELECT id, coalesce(title, '') AS t, coalesce(summary_raw, '') AS s, tickers_raw FROM {{fx_articles}}),
 f AS (SELECT id, t, s, concat('(', string_agg({_ESCAPED}, '|' ORDER BY length(name) DESC, name), ')') AS rx FROM a JOIN n ON contains(concat(t, chr(10), s), name) GROUP BY ALL),
 hit AS (SELECT id, unnest(regexp_extract_all(t, rx, 1)) AS name, 1.0 AS rel FROM f UNION ALL SELECT id, unnest(regexp_extract_all(s, rx, 1)), 0.5 FROM f),
 tag AS (SELECT id, unnest(regexp_extract_all(concat(t, ' ', s), '\$([A-Z]{{{{1,5}}}})', 1)) AS symbol, 0.9 AS rel FROM a UNION ALL SELECT id, unnest(tickers_raw), 0.8 FROM a),
 o AS (SELECT id, symbol, rel FROM hit JOIN n USING (name) UNION ALL SELECT id, symbol, rel FROM tag WHERE symbol IN (SELECT symbol FROM n) OR symbol IN (SELECT CONCAT('S', CAST(p_partkey AS VARCHAR(20))) FROM {{part}}))
SELECT id, symbol, CAST(max(rel) AS DOUBLE) AS rel FROM o GROUP BY ALL""")
def _(i: Inputs):
    """The dictionary and the universe are tables: nothing of them is collected."""
    i["documents"].createOrReplaceTempView("named_documents")
    names = i.spark.sql(_NAMED.format(documents="named_documents"))
    universe = i["part"].select(F.concat(F.lit("S"), "p_partkey").alias("symbol"))
    a = link_symbols(i["fx_articles"].select("id", "title", "summary_raw", "tickers_raw"), names, {}, universe)
    return by_symbol(a.select("id", "syms"))


_FIRM = "CONCAT(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Holdings Group' WHEN 2 THEN ', Corp' WHEN 3 THEN ' The' ELSE '' END)"
_SFX = K.CORPORATE_SUFFIX


@query("company_dictionary", f"""
SELECT symbol, name FROM (SELECT symbol, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(n, '{_SFX}', '', 'i')), '{_SFX}', '', 'i')), '{_SFX}', '', 'i')) AS name
  FROM (SELECT CONCAT('P', p_partkey) AS symbol, {_FIRM} AS n FROM part))
WHERE name NOT IN ({sq(K.AMBIGUOUS_NAMES)}) AND length(name) >= 4 AND (contains(name, ' ') OR length(name) >= 5)""")
def _(i: Inputs):
    u = i["part"].select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.expr(_FIRM).alias("name"))
    return company_dictionary(u)


def _event_sql(c: str, what: int) -> str:
    val = (lambda e: f"'{e[0]}'") if what == 0 else (lambda e: str(e[1]))
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{e[2]}', 'i') THEN {val(e)}" for e in K.EVENTS) + f" ELSE {'%s' % (repr(K.OTHER_EVENT[0]) if what == 0 else K.OTHER_EVENT[1])} END"


_HEAD = ["sec charges bank", "Fed weighs rate cut", "raises outlook", "launches new chip", "shortage of parts", "merger talks", "quiet day", "price target up", "profit rose"]
_HEAD_SQL = "CASE doc_id % 9 " + " ".join(f"WHEN {n} THEN '{h}'" for n, h in enumerate(_HEAD)) + " END"


@query("event_of", f"""
SELECT doc_id AS id, {_event_sql('t', 0)} AS event, CAST({_event_sql('t', 1)} AS DOUBLE) AS event_w
FROM (SELECT doc_id, CONCAT({_HEAD_SQL}, '. ', {ASCII.format(c='text')}) AS t FROM documents)""")
def _(i: Inputs):
    e = X.event_of(F.concat(F.expr(_HEAD_SQL), F.lit(". "), "text"))
    return i["documents"].select(F.col("doc_id").alias("id"), e.alias("e")).select("id", "e.event", "e.event_w")


@query("source_weight", f"""
SELECT id, CAST(CASE {' '.join(f"WHEN contains(lower(source), '{k}') THEN {w}" for k, w in K.SOURCE_WEIGHTS)} ELSE 0.8 END AS DOUBLE) AS src_w FROM {{fx_articles}}""")
def _(i: Inputs):
    return i["fx_articles"].select("id", X.source_weight(F.col("source")).alias("src_w"))


_TOKENS = """tok AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents))"""
_LEX_SQL = f"""SELECT id, coalesce(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END), 0) AS p, coalesce(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END), 0) AS n FROM (
    SELECT id, CASE WHEN coalesce(l1, 0) + coalesce(l2, 0) + coalesce(l3, 0) > 0 THEN -s ELSE s END AS s FROM (
      SELECT id, CASE WHEN t IN ({sq(POS)}) THEN 1 WHEN t IN ({sq(NEG)}) THEN -1 ELSE 0 END AS s, lag(g, 1) OVER w AS l1, lag(g, 2) OVER w AS l2, lag(g, 3) OVER w AS l3
      FROM (SELECT *, CASE WHEN t IN ({sq(NEGATORS)}) THEN 1 ELSE 0 END AS g FROM tok) WINDOW w AS (PARTITION BY id ORDER BY pos))) GROUP BY id"""


@query("lexicon_score", f"""
WITH {_TOKENS}, pn AS ({_LEX_SQL})
SELECT d.doc_id AS id, round(tanh((coalesce(p, 0) - coalesce(n, 0)) / sqrt(coalesce(p, 0) + coalesce(n, 0) + 2.0)), 6) AS score
FROM documents d LEFT JOIN pn ON d.doc_id = pn.id""")
def _(i: Inputs):
    return i["documents"].select(F.col("doc_id").alias("id"), rounded(X.lexicon_score(F.col("text"), POS, NEG, NEGATORS)).alias("score"))


_VAL_CASE = "CASE t " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in VALENCE.items()) + " ELSE 0.0 END"
_VAL_SQL = f"""SELECT id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS n,
    sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS z FROM (SELECT id, CAST({_VAL_CASE} AS DOUBLE) AS v FROM tok) GROUP BY id"""


@query("valence_compound", f"""
WITH {_TOKENS}, v AS ({_VAL_SQL})
SELECT d.doc_id AS id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS compound, round(coalesce(p / (p + n + z), 0), 6) AS pos, round(coalesce(n / (p + n + z), 0), 6) AS neg
FROM documents d LEFT JOIN v ON d.doc_id = v.id""")
def _(i: Inputs):
    v = i["documents"].select(F.col("doc_id").alias("id"), X.valence(F.col("text"), VALENCE).alias("v"))
    return v.select("id", rounded("v.compound").alias("compound"), rounded("v.pos").alias("pos"), rounded("v.neg").alias("neg"))


@query("token_counts", f"WITH {_TOKENS} SELECT t AS token, count(*) AS n, count(DISTINCT id) AS docs FROM tok GROUP BY t")
def _(i: Inputs):
    t = i["documents"].select("doc_id", F.explode(X.tokenize(F.col("text"))).alias("token"))
    return t.groupBy("token", "doc_id").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


_NUM = r"(?:[+-]?\$\d+(?:\.\d+)?[MBB]?|[+-]?\d+(?:\.\d+)?%)"


@query("numeric_impact", f"""
SELECT id, coalesce(list_sum(list_transform(m, lambda x: CASE WHEN starts_with(x, '+') THEN 0.5 WHEN starts_with(x, '-') THEN -0.5 ELSE 0.0 END)), 0.0)::DOUBLE AS impact, len(m) AS figures
FROM (SELECT c_custkey AS id, regexp_extract_all(CONCAT(c_name, ' moved ', CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END, CAST(CAST(c_acctbal AS INT) AS VARCHAR(12)), '% and -$', CAST(c_custkey AS VARCHAR(12)), 'M, +$5B'), '{_NUM}') AS m FROM customer)""")
def _(i: Inputs):
    text = F.expr("CONCAT(c_name, ' moved ', CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END, CAST(CAST(RINT(c_acctbal) AS INT) AS STRING), '% and -$', CAST(c_custkey AS STRING), 'M, +$5B')")
    return i["customer"].select(F.col("c_custkey").alias("id"), X.numeric_impact(text).alias("impact"), F.size(F.regexp_extract_all(text, F.lit(K.NUMERIC), F.lit(1))).alias("figures"))


_TT = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z'']+'), lambda w: length(w) > 3)))"


@query("title_jaccard", f"""
WITH a AS (SELECT id, {_TT.format(c='title')} AS x, {_TT.format(c='summary_raw')} AS y FROM {{fx_articles}})
SELECT id, array_to_string(x, ' ') AS tokens, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM a""")
def _(i: Inputs):
    a = i["fx_articles"].select("id", X.title_tokens(F.col("title")).alias("x"), X.title_tokens(F.col("summary_raw")).alias("y"))
    return a.select("id", F.array_join("x", " ").alias("tokens"), rounded(X.jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


#: Titles as bit masks, a list of 120-bit parts for every character: (s, n, masks, full), and their common subsequence in bit-parallel form
RATIO_CTES = """ch AS (SELECT s, c, list({'part': part, 'm': m}) AS ms FROM (SELECT s, c, i // 120 AS part, CAST(sum(CAST(1 AS HUGEINT) << CAST(i % 120 AS INT)) AS HUGEINT) AS m
   FROM (SELECT s, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS i FROM titles) GROUP BY ALL) GROUP BY ALL),
 masked AS MATERIALIZED (SELECT s, length(s) AS n, map(list(c), list(list_transform(range((length(s) + 119) // 120), lambda k: coalesce(list_filter(ms, lambda x: x.part = k)[1].m, CAST(0 AS HUGEINT))))) AS masks,
   list_transform(range((length(s) + 119) // 120), lambda k: (CAST(1 AS HUGEINT) << CAST(least(120, length(s) - 120 * k) AS INT)) - 1) AS ones FROM ch GROUP BY s)"""
_STEP = """list_reduce(range(1, len(row) + 1), lambda z, k: {'c': (row[k] + (row[k] & m[k]) + z.c) >> 120, 'l': list_append(z.l, ((row[k] + (row[k] & m[k]) + z.c) & ((CAST(1 AS HUGEINT) << 120) - 1)) | (row[k] - (row[k] & m[k])))},
   {'c': CAST(0 AS HUGEINT), 'l': CAST([] AS HUGEINT[])}).l"""
#: Similarity in percent of a masked title ``a`` and another title ``b``
RATIO = f"""(200 * (a.n - list_sum(list_transform(list_zip(list_reduce(list_filter(list_transform(string_split(b.s, ''), lambda c: a.masks[c]), lambda m: m IS NOT NULL), lambda row, m: {_STEP}, a.ones), a.ones),
   lambda x: bit_count(x[1] & x[2])))) / (a.n + length(b.s)))"""


@query("title_ratio", f"""WITH q AS (SELECT x.id, CASE WHEN length(x.title) <= length(y.title) THEN x.title ELSE y.title END AS short, CASE WHEN length(x.title) <= length(y.title) THEN y.title ELSE x.title END AS s FROM {{fx_articles}} x JOIN {{fx_articles}} y ON y.id = x.id + 1),
 titles AS (SELECT DISTINCT short AS s FROM q), {RATIO_CTES} SELECT b.id, round({RATIO}, 6) AS ratio FROM q b JOIN masked a ON a.s = b.short""")
def _(i: Inputs):
    """Similarity of every title with the next one by id (joined on id + 1, so no global sort)."""
    a = i["fx_articles"].select("id", "title")
    b = a.select((F.col("id") - 1).alias("id"), F.col("title").alias("next_title"))
    return a.join(b, "id").select("id", rounded(X.title_ratio(F.col("title"), F.col("next_title"))).alias("ratio"))


_ITEMS = "CONCAT('Item ', CAST(o_orderkey % 9 + 1 AS VARCHAR(2)), '.0', CAST(o_orderkey % 4 + 1 AS VARCHAR(2)), ' and Item 9.01 and Item ', CAST(o_orderkey % 9 + 1 AS VARCHAR(2)), '.0', CAST(o_orderkey % 4 + 1 AS VARCHAR(2)))"
_ITEM_CASE = "CASE c " + " ".join("WHEN '%s' THEN '%s'" % kv for kv in K.FILING_ITEMS.items()) + " {e} END"


@query("decode_items", rf"""
WITH t AS (SELECT id, unnest(c) AS c, generate_subscripts(c, 1) AS pos FROM (SELECT o_orderkey AS id, regexp_extract_all({_ITEMS}, '\d\.\d\d') AS c FROM orders)),
     d AS (SELECT id, n, min(pos) AS pos FROM (SELECT id, pos, {_ITEM_CASE.format(e='ELSE c')} AS n FROM t) GROUP BY id, n)
SELECT d.id, string_agg(n, ', ' ORDER BY pos) AS decoded, (SELECT string_agg(trim(CONCAT(c, ' ', coalesce({_ITEM_CASE.format(e='')}, ''))), '; ' ORDER BY pos) FROM t WHERE t.id = d.id) AS items FROM d GROUP BY d.id""")
def _(i: Inputs):
    text = F.expr(_ITEMS)
    return i["orders"].select(F.col("o_orderkey").alias("id"), X.decode_items(text).alias("decoded"), F.array_join(X.filing_items(text), "; ").alias("items"))


@query("resolve_symbol", f"""
SELECT id, CASE WHEN length(symbol) > 0 THEN trim(symbol) {' '.join("WHEN contains(lower(ticker_or_theme), '%s') THEN '%s'" % kv for kv in K.THEME_SYMBOLS)} END AS resolved FROM {{fx_calls}}""")
def _(i: Inputs):
    return i["fx_calls"].select("id", X.resolve_symbol(F.col("ticker_or_theme"), F.col("symbol")).alias("resolved"))


@query("norm_title_key", r"""
SELECT id, trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key FROM {fx_articles}""")
def _(i: Inputs):
    return i["fx_articles"].select("id", X.norm_title_key(F.col("title")).alias("title_key"))


def _main_text_sql() -> str:
    t = r"regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "head", "nav", "header", "footer", "aside", "form", "svg", "iframe"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?is)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?s)<[^>]+>', ' ', 'g')"
    for ent, ch in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        t = f"replace({t}, '{ent}', {ch})"
    t = rf"regexp_replace({t}, '[ \t\x0B\f\r]+', ' ', 'g')"
    return rf"trim(regexp_replace({t}, '\s*\n\s*', chr(10), 'g'), CONCAT(' ', chr(10)))"


@query("extract_main_text", f"""
SELECT page_id AS id, CASE WHEN length(t) >= 200 THEN t END AS main_text, contains(url, 'example.org') AS blocked FROM (SELECT page_id, url, {_main_text_sql()} AS t FROM pages)""")
def _(i: Inputs):
    return i["pages"].select(F.col("page_id").alias("id"), X.main_text(F.col("html")).alias("main_text"), X.is_blocked(F.col("url"), ["example.org"]).alias("blocked"))


@query("backfill_full_text", rf"""WITH m AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 5 = 0 AS before, {_main_text_sql()} AS t FROM pages),
 newest AS (SELECT url, arg_max(CASE WHEN length(t) >= 200 THEN t END, page_id) FILTER (true) AS x, max(page_id) AS pid FROM m GROUP BY 1), l AS (SELECT n.url, CASE WHEN length(m.t) >= 200 THEN m.t END AS x FROM newest n JOIN m ON m.page_id = n.pid),
 j AS (SELECT m.page_id AS id, before, contains(m.url, 'investing.com') AS blocked, CASE WHEN NOT contains(m.url, 'investing.com') THEN l.x END AS x, title FROM m LEFT JOIN l ON l.url = m.url),
 k AS (SELECT *, {ASCII.format(c="concat_ws(' ', title, x)")} AS t FROM j)
SELECT id, CASE WHEN before THEN 'before' WHEN blocked THEN 'skipped' WHEN x IS NOT NULL THEN 'ok' ELSE 'failed' END AS fetch_state, CASE WHEN NOT before THEN CAST(length(x) AS DOUBLE) END AS n,
 CASE WHEN before OR x IS NULL THEN 'ZZ' ELSE array_to_string(list_sort(list_distinct(list_append({_FOUND}, 'ZZ'))), ',') END AS tickers FROM k""")
def _(i: Inputs):
    """Articles at the stored pages' urls: fetch outcome, text length and merged tickers."""
    p = i["pages"]
    a = p.select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.array(F.lit("ZZ")).alias("tickers_raw"),
                 (F.col("page_id") % 5 == 0).alias("full_text_fetch_attempted"), F.lit(None).cast("string").alias("full_text"), F.lit(None).cast("timestamp").alias("full_text_fetched_at"))
    out = feeds.backfill_full_text(a, p, moment("2024-01-31 00:00:00"))
    return out.select("id", F.coalesce("fetch_state", F.lit("before")).alias("fetch_state"), F.length("full_text").cast("double").alias("n"), joined("tickers_raw").alias("tickers"))


@query("merge_tickers", """
SELECT id, array_to_string(n, ',') AS tickers, n <> o AS changed FROM (SELECT id, list_sort(list_distinct(tickers_raw)) AS o,
    list_sort(list_distinct(list_concat(tickers_raw, coalesce(ai_affected_tickers, [])))) AS n FROM {fx_articles})""")
def _(i: Inputs):
    m = i["fx_articles"].select("id", X.merge_tickers(F.col("tickers_raw"), F.col("ai_affected_tickers")).alias("m"))
    return m.select("id", joined("m.tickers").alias("tickers"), "m.changed")


@query("parse_published", """
SELECT o_orderkey AS id, strftime(CASE o_orderkey % 4 WHEN 3 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE o_orderdate + (o_orderkey % 20) * INTERVAL '1' HOUR END, '%Y-%m-%d %H:%M:%S') AS published_at FROM orders""")
def _(i: Inputs):
    o = i["orders"].withColumn("t", F.expr("o_orderdate + (o_orderkey % 20) * INTERVAL '1' HOUR"))
    iso, rfc = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    k = F.col("o_orderkey") % 4
    a, b = F.when(k == 0, iso).when(k == 3, "no date"), F.when(k == 1, rfc).when(k == 2, iso)
    return o.select(F.col("o_orderkey").alias("id"), ts_text(X.parse_published(a, b, now=moment("2024-01-31 00:00:00"))).alias("published_at"))


@query("split_themes", """
SELECT id, array_to_string(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: length(x) > 0), '|') AS themes
FROM (SELECT p_partkey AS id, CONCAT(p_name, ', ', p_brand, ' ,,', p_type) AS s FROM part)""")
def _(i: Inputs):
    s = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ,,"), "p_type")
    return i["part"].select(F.col("p_partkey").alias("id"), joined(X.split_themes(s), "|").alias("themes"))


_SPAM_SQL = "CONCAT(CASE id % 8 WHEN 0 THEN 'Last Chance: ' WHEN 1 THEN '20% off ' WHEN 2 THEN 'Hurryup ' WHEN 3 THEN 'αβγ ' WHEN 4 THEN 'Nvidia and ASML ' ELSE '' END, title)"


@query("is_spam", f"""
SELECT id, regexp_matches(CONCAT(t, ' ', s), '{K.SPAM.replace("'", "''")}', 'i') AS spam, CASE WHEN regexp_matches(t, '[Α-Ωα-ωά-ώ]') THEN 'el' ELSE 'en' END AS lang_tag,
  (list_contains(tk, 'NVDA') AND regexp_matches(t, 'nvidia|nvda', 'i')) OR (list_contains(tk, 'MSFT') AND regexp_matches(t, 'microsoft|msft', 'i')) AS names_holding
FROM (SELECT id, {ASCII.format(c="summary_raw")} AS s, {_SPAM_SQL} AS t, tickers_raw AS tk FROM {{fx_articles}})""")
def _(i: Inputs):
    t = F.expr(_SPAM_SQL)
    return i["fx_articles"].select("id", X.is_spam(t, F.col("summary_raw")).alias("spam"), X.lang_tag(t).alias("lang_tag"),
                                   X.about_holding(t, F.col("tickers_raw")).alias("names_holding"))


@query("entry_day", """
SELECT id, CAST(CAST(created_at AS DATE) - CASE WHEN hour(created_at) >= CASE WHEN id % 2 = 0 THEN 16 ELSE 21 END THEN 0 ELSE 1 END AS VARCHAR) AS entry_day,
  CASE WHEN confidence IS NULL THEN 'Unknown' WHEN confidence < 40 THEN 'Low (0-39)' WHEN confidence < 70 THEN 'Medium (40-69)' ELSE 'High (70-100)' END AS bucket FROM {fx_calls}""")
def _(i: Inputs):
    sym = F.when(F.col("id") % 2 == 0, "X.DE").otherwise("X")
    return i["fx_calls"].select("id", day_text(S.entry_day(sym, F.col("created_at"))).alias("entry_day"), S.confidence_bucket(F.col("confidence")).alias("bucket"))


# ---------------------------------------------------------------- landed feeds

_XML_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("parse_feed_items", r"""
SELECT * FROM (SELECT CASE WHEN id % 4 = 0 THEN 'Yahoo Finance' ELSE CONCAT('feed', id % 7) END AS source, CONCAT('http://example.com/a/', id) AS url,
   trim(regexp_replace(title, '^[\s]+|[\s]+$', '', 'g')) AS title, nullif(trim(regexp_replace(regexp_replace(summary_raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS summary_raw,
   strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN id % 4 = 0 THEN CONCAT('S', id % 20) ELSE '' END AS tickers FROM {fx_articles})
WHERE title <> ''""")
def _(i: Inputs):
    a = i["fx_articles"].withColumns({"t": F.expr(_XML_ESC.format(c="title")), "s": F.expr(_XML_ESC.format(c="summary_raw"))})
    item = lambda date: F.concat(F.lit("<title>"), "t", F.lit("</title>"), date)
    rss = F.concat(F.lit("<rss><channel><item>"), item(F.concat(F.lit("<link>http://example.com/a/"), F.col("id").cast("string"), F.lit("</link><description>"), "s",
                   F.lit("</description><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>"))), F.lit("</item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry>"), item(F.concat(F.lit('<link href="http://example.com/a/'), F.col("id").cast("string"), F.lit('"/><summary>'), "s",
                    F.lit("</summary><updated>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated>"))), F.lit("</entry></feed>"))
    yahoo = F.col("id") % 4 == 0
    raw = a.select(F.concat(F.lit("feed"), (F.col("id") % 7).cast("string")).alias("name"), F.when(yahoo, "yahoo_ticker").otherwise("rss").alias("kind"), "category",
                   F.when(yahoo, F.concat(F.lit("S"), (F.col("id") % 20).cast("string"))).alias("ticker"), F.when(F.col("id") % 2 == 0, rss).otherwise(atom).alias("raw_xml"))
    p = feeds.parse_feed_items(raw, moment("2024-01-31 00:00:00"))
    return p.select("source", "url", "title", "summary_raw", ts_text("published_at").alias("published_at"), joined("tickers_raw").alias("tickers"))


@query("parse_news_json", """
SELECT * FROM (SELECT coalesce(source, 'NewsAPI') AS source, url, title, nullif(summary_raw, '') AS summary_raw, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'general' AS category FROM {fx_articles})
WHERE title <> ''""")
def _(i: Inputs):
    art = F.struct("title", "url", F.col("summary_raw").alias("description"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.struct(F.col("source").alias("name")).alias("source"))
    raw = i["fx_articles"].select(F.to_json(F.struct(F.array(art).alias("articles"))).alias("payload"))
    p = feeds.parse_news_json(raw, moment("2024-01-31 00:00:00"))
    return p.select("source", "url", "title", "summary_raw", ts_text("published_at").alias("published_at"), "category")


_FILING_SUM = "CASE o_orderkey % 3 WHEN 0 THEN 'Item 2.02 and Item 9.01' WHEN 1 THEN 'Item 6.66' ELSE 'none' END"


@query("parse_filing_feed", f"""
SELECT o_orderkey AS id, CONCAT(symbol, ' (Firm ', o_custkey, ') filed 8-K', CASE o_orderkey % 3 WHEN 0 THEN ': 2.02 Results of Operations (Earnings); 9.01 Financial Statements/Exhibits'
   WHEN 1 THEN ': 6.66' ELSE '' END) AS title, symbol AS tickers
FROM orders JOIN {{fx_universe}} ON cik = LPAD(CAST(o_custkey % 40 AS VARCHAR), 10, '0') WHERE o_orderkey % 5 <> 0""")
def _(i: Inputs):
    cik = F.lpad((F.col("o_custkey") % 40).cast("string"), 10, "0")
    role = F.when(F.col("o_orderkey") % 5 == 0, "(Other)").otherwise("(Filer)")
    e = i["orders"].select(F.col("o_orderkey").alias("id"), F.concat(F.lit("8-K - Firm "), F.col("o_custkey").cast("string"), F.lit(" ("), cik, F.lit(") "), role).alias("title"), F.expr(_FILING_SUM).alias("summary_raw"))
    return feeds.parse_filing_feed(e, i["fx_universe"]).select("id", "title", joined("tickers_raw").alias("tickers"))


@query("watchlist_filings", """
SELECT CONCAT('http://f/', s_suppkey) AS url, CONCAT(s_name, CASE WHEN s_suppkey % 3 <> 0 THEN ' (TK)' ELSE '' END, ': 8-K', CASE WHEN s_suppkey % 2 = 0 THEN ' -- Regulation FD Disclosure, Financial Statements/Exhibits' ELSE '' END) AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN 'items 7.01 and 9.01' ELSE '8-K' END AS summary_raw, CASE WHEN s_suppkey % 3 <> 0 THEN 'TK' ELSE '' END AS tickers FROM supplier""")
def _(i: Inputs):
    k = F.col("s_suppkey")
    e = i["supplier"].select(F.when(k % 3 != 0, F.concat("s_name", F.lit(" (TK)"))).otherwise(F.col("s_name")).alias("name"), F.lit("8-K").alias("form_type"),
                             F.lit(None).cast("string").alias("form_name"), F.when(k % 2 == 0, " items 7.01 and 9.01 ").alias("items_desc"),
                             F.concat(F.lit("http://f/"), k.cast("string")).alias("link"), F.lit("2024-01-02T00:00:00Z").alias("updated"), F.lit(None).cast("string").alias("filing_date"))
    return feeds.watchlist_filings(e).select("url", "title", "summary_raw", joined("tickers_raw").alias("tickers"))

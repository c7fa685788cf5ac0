"""The given tables seen as news and price inputs.

One SQL text per view, valid in Spark and in DuckDB, so both engines read the same rows. ``{name}`` is a given table or
another view. Titles are a document's first sentence or line and summaries all the rest; no view drops rows of its table.
"""

_TITLE = r"TRIM(REGEXP_EXTRACT(text, '^[^.\n]*', 0))"
_REST = r"SUBSTRING(text, LENGTH(REGEXP_EXTRACT(text, '^[^.\n]*', 0)) + 2)"
_PUB = "TIMESTAMP '2024-01-17 00:00:00' + ((doc_id * 37) % 20160) * INTERVAL '1' MINUTE"


def _bars(day: str) -> str:
    return f"""SELECT {day} AS date, CONCAT('B', CAST(l_partkey % 25 AS VARCHAR(10))) AS symbol,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS close, SUM(l_quantity) AS volume
FROM {{lineitem}} GROUP BY 1, 2"""


def _bench(day: str) -> str:
    return f"""SELECT {day} AS date, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS close
FROM {{lineitem}} GROUP BY 1"""


_DAY, _WEEK = "CAST(l_shipdate AS DATE)", "CAST(date_trunc('week', l_shipdate) AS DATE)"

FIXTURES = {
    "fx_articles": f"""
SELECT doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'SEC EDGAR' WHEN 1 THEN 'Reuters' WHEN 2 THEN 'Seeking Alpha' ELSE source END AS source,
       CONCAT('http://example.com/', CAST(doc_id % 900 AS VARCHAR(20))) AS url, {_TITLE} AS title, {_REST} AS summary_raw,
       CASE WHEN doc_id % 2 = 0 THEN text END AS full_text, 'desk' AS author, {_PUB} AS published_at,
       {_PUB} + (doc_id % 90) * INTERVAL '1' MINUTE AS scraped_at,
       CASE doc_id % 5 WHEN 0 THEN 'macro' WHEN 1 THEN 'energy' WHEN 2 THEN 'sec-filing' ELSE 'equities' END AS category,
       SPLIT(CASE WHEN doc_id % 9 = 0 THEN CONCAT('NVDA,S', CAST(doc_id % 20 AS VARCHAR(10))) WHEN doc_id % 11 = 0 THEN 'MSFT'
             ELSE CONCAT('S', CAST(doc_id % 20 AS VARCHAR(10))) END, ',') AS tickers_raw,
       doc_id % 3 <> 0 AS ai_processed, CASE WHEN doc_id % 3 <> 0 THEN {_PUB} + INTERVAL '2' HOUR END AS ai_processed_at,
       CASE doc_id % 5 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed' END AS ai_sentiment,
       CAST((doc_id * 37) % 101 AS INT) AS ai_relevance_score,
       CASE WHEN doc_id % 6 = 0 THEN SPLIT(CONCAT('GOOGL,S', CAST((doc_id + 3) % 20 AS VARCHAR(10))), ',') END AS ai_affected_tickers,
       CASE WHEN doc_id % 4 = 0 THEN CONCAT('About ', {_TITLE}) END AS ai_summary,
       CASE doc_id % 8 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS ai_suggested_action, CAST(NULL AS VARCHAR(10)) AS ai_risk_flag,
       CAST(doc_id % 100 AS INT) AS ai_confidence, doc_id % 2 = 0 AS full_text_fetch_attempted, lang
FROM {{documents}}""",
    "fx_scores": """
SELECT doc_id AS article_id, 'finbert' AS model, CAST(quality AS DOUBLE) * CAST(0.8 AS DOUBLE) - CAST(toxic AS DOUBLE) * CAST(0.6 AS DOUBLE)
       - CAST(0.3 AS DOUBLE) AS score, TIMESTAMP '2024-01-30 00:00:00' AS scored_at
FROM {labels}""",
    "fx_items": """
SELECT event_id AS id, ts, event_type AS source, CONCAT('S', CAST(user_id % 20 AS VARCHAR(10))) AS symbol,
       CAST(CASE event_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS rel,
       CAST(CASE event_type WHEN 'purchase' THEN 1.2 WHEN 'view' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS src_w,
       CAST(CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'error' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS event_w,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0.25 ELSE 1.0 END AS DOUBLE) AS novelty, CAST(event_id % 7 AS INT) AS confirm,
       (value - 50.0) / 50.0 AS lex, CASE WHEN event_id % 3 <> 0 THEN (100.0 - value) / 100.0 END AS finbert,
       (value - 60.0) / 80.0 AS ens, CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 3 - 1 AS DOUBLE) END AS old,
       CONCAT(event_type, ' ', CAST(event_id AS VARCHAR(20))) AS title
FROM {events}""",
    "fx_snaps": """
SELECT date_trunc('hour', ts) AS ts, CONCAT('S', CAST(user_id % 20 AS VARCHAR(10))) AS symbol,
       CASE event_type WHEN 'view' THEN 'lex' WHEN 'click' THEN 'finbert' WHEN 'purchase' THEN 'old' ELSE 'ens' END AS model,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 100.0 - 0.5 AS idx,
       CASE WHEN MAX(event_id) % 9 <> 0 THEN (MAX(value) - 60.0) / 45.0 END AS z, CAST(COUNT(*) + MAX(event_id) % 6 AS INT) AS n_lead,
       CAST(COUNT(*) AS DOUBLE) AS wsum, CAST(COUNT(*) AS INT) AS att_n, (MIN(value) - 20.0) / 30.0 AS att_z
FROM {events} GROUP BY 1, 2, 3""",
    "fx_event_bars": """
SELECT CAST(ts AS DATE) AS date, CONCAT('S', CAST(user_id % 20 AS VARCHAR(10))) AS symbol,
       50.0 + CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS close, CAST(COUNT(*) AS DOUBLE) AS volume
FROM {events} GROUP BY 1, 2""",
    "fx_event_bench": """
SELECT CAST(ts AS DATE) AS date, 50.0 + CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS close FROM {events} GROUP BY 1""",
    "fx_bars": _bars(_DAY),
    "fx_bars_weekly": _bars(_WEEK),
    "fx_bench": _bench(_DAY),
    "fx_bench_weekly": _bench(_WEEK),
    "fx_universe": """
SELECT CONCAT('B', CAST(n_nationkey AS VARCHAR(10))) AS symbol, n_name AS name, r_name AS sector,
       LPAD(CAST(n_nationkey AS VARCHAR(10)), 10, '0') AS cik
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "fx_news_universe": """
SELECT CONCAT('S', CAST(n_nationkey AS VARCHAR(10))) AS symbol, n_name AS name, r_name AS sector
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "fx_calls": """
SELECT o_orderkey AS id, o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS created_at,
       CASE WHEN o_orderkey % 10 <> 0 THEN CONCAT('B', CAST(o_custkey % 25 AS VARCHAR(10))) END AS symbol,
       CASE o_orderkey % 6 WHEN 0 THEN 'crude oil squeeze' WHEN 1 THEN 'US 10-year yield' WHEN 2 THEN 'Gold bid' ELSE o_orderpriority END AS ticker_or_theme,
       CASE WHEN o_orderkey % 3 = 0 THEN 'bearish' WHEN o_orderkey % 7 = 0 THEN 'neutral' ELSE 'bullish' END AS call,
       CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 101 AS INT) END AS confidence,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(3 + o_orderkey % 5 AS INT) END AS horizon_days,
       CASE WHEN o_orderkey % 13 = 0 THEN 1600.0 + CAST(o_orderkey % 100 AS DOUBLE) END AS entry_price,
       CASE o_orderkey % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'unclear' WHEN 3 THEN 'correct' END AS outcome,
       CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate + INTERVAL '9' DAY END AS outcome_checked_at
FROM {orders}""",
    "fx_sources": """
SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, CONCAT('http://feeds.example.com/', CAST(s_suppkey AS VARCHAR(10))) AS url,
       CASE s_nationkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'sec' WHEN 2 THEN 'yahoo_ticker' ELSE 'nasdaq_ticker' END AS kind,
       CAST(CASE WHEN s_suppkey % 15 = 0 THEN 11 ELSE s_suppkey % 6 END AS INT) AS fail_count, s_suppkey % 6 < 5 AS enabled,
       CAST(15 + 15 * (s_suppkey % 3) AS INT) AS poll_minutes, CAST(s_suppkey * 10 AS INT) AS items_total,
       CASE WHEN s_suppkey % 8 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - (s_suppkey * 7 % 480) * INTERVAL '1' HOUR
            + (s_suppkey % 50) * INTERVAL '1' MINUTE END AS last_fetch,
       CASE WHEN s_suppkey % 8 <> 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS last_success, CAST(200 AS INT) AS last_status,
       CAST('e0' AS VARCHAR(10)) AS etag, CAST('m0' AS VARCHAR(10)) AS last_modified
FROM {supplier}""",
    "fx_fetches": """
SELECT event_id AS id, CONCAT('feed', CAST(user_id % 40 AS VARCHAR(10))) AS source, CAST(event_id % 30 AS INT) AS entries,
       CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 304 WHEN 'purchase' THEN 429 ELSE 200 END AS INT) AS status,
       CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' END AS fetch_state, ts AS created_at
FROM {events}""",
    "fx_health": """
SELECT date_trunc('hour', ts) AS created_at, CASE event_type WHEN 'view' THEN 'INGEST_ALL' ELSE event_type END AS source,
       CAST(COUNT(*) AS INT) AS entries_fetched, CAST(SUM(CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS errors
FROM {events} GROUP BY 1, 2""",
    "fx_results": """
SELECT CAST(s_suppkey AS INT) AS id, CASE s_suppkey % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN '500' WHEN 2 THEN '304' ELSE '200' END AS status,
       CAST(s_suppkey % 20 AS INT) AS n, 'e1' AS etag, 'm1' AS last_modified
FROM {supplier}""",
    "fx_holdings": """
SELECT CONCAT('P', CAST(p_partkey AS VARCHAR(10))) AS symbol, p_name AS name, CAST(p_size AS DOUBLE) AS shares FROM {part}""",
    "fx_quotes": """
SELECT CONCAT('P', CAST(p_partkey AS VARCHAR(10))) AS symbol, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency
FROM {part}""",
    "fx_digests": """
SELECT conv_id * 1000 + turn AS id, TIMESTAMP '2024-01-01 00:00:00' + ((conv_id * 53 + turn) % 43200) * INTERVAL '1' MINUTE AS created_at, text AS summary
FROM {conversations}""",
    "fx_books": """
SELECT date, symbol, 'price' AS book, close AS score FROM {fx_bars_weekly} UNION ALL
SELECT date, symbol, 'volume' AS book, volume AS score FROM {fx_bars_weekly}""",
    "fx_predictions": """
SELECT date AS pred_date, book, CAST(5 AS INT) AS horizon, symbol, score,
       CAST(ROW_NUMBER() OVER (PARTITION BY date, book ORDER BY score DESC, symbol) AS INT) AS rank
FROM {fx_books}""",
    "fx_positions": """
SELECT book, CASE WHEN rank <= 12 THEN 'long' ELSE 'avoid' END AS side, symbol, pred_date AS signal_date, CAST(5 AS INT) AS horizon,
       CASE WHEN rank % 3 = 0 THEN 'pending' ELSE 'closed' END AS status,
       CASE WHEN rank % 3 <> 0 THEN CAST(rank % 7 - 3 AS DOUBLE) / 2.0 END AS excess_pct,
       CASE WHEN rank % 3 <> 0 THEN CAST(rank % 7 - 3 AS DOUBLE) / 2.0 - CAST(0.2 AS DOUBLE) END AS net_excess_pct
FROM {fx_predictions}""",
}

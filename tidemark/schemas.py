"""Schemas of the tables that the operators expect, for callers that read landed files; the price reader passes its own."""

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(), "t": T.TimestampType(), "d": T.DateType(), "i": T.IntegerType(), "l": T.LongType(),
    "f": T.DoubleType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "n": T.DecimalType(18, 6),
    "m": T.MapType(T.StringType(), T.StringType()),
}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(":") for x in spec.split())])


ARTICLES = _schema(
    "id:s source:s url:s title:s summary_raw:s full_text:s author:s published_at:t scraped_at:t category:s tickers_raw:as "
    "ai_processed:b ai_processed_at:t ai_sentiment:s ai_relevance_score:i ai_affected_tickers:as ai_summary:s "
    "ai_suggested_action:s ai_risk_flag:s ai_confidence:i ai_correlated_article_ids:as full_text_fetch_attempted:b "
    "full_text_fetched_at:t notified_at:t fb_score:f event:s lang:s")
ARTICLE_SCORES = _schema("article_id:s model:s score:f p_pos:f p_neg:f scored_at:t")
SNAPSHOTS = _schema("ts:t symbol:s model:s idx:f z:f n_lead:i wsum:f att_n:i att_z:f")
ALERTS = _schema("ts:t symbol:s kind:s detail:s")
DIGESTS = _schema("id:s created_at:t period_start:t period_end:t articles_covered:i summary:s key_themes:as guidance:s watchlist_notes:m")
CALLS = _schema(
    "id:s created_at:t digest_id:s ticker_or_theme:s call:s rationale:s confidence:i outcome:s outcome_checked_at:t "
    "horizon_days:i symbol:s invalidation:s entry_price:n entry_at:t exit_price:n asset_return_pct:n "
    "benchmark_return_pct:n excess_return_pct:n resolved_at:t")
PRICES = _schema("date:d symbol:s close:f volume:f")
UNIVERSE = _schema("symbol:s name:s sector:s cik:s")
PREDICTIONS = _schema("pred_date:d book:s horizon:i symbol:s score:f rank:i")
POSITIONS = _schema(
    "book:s side:s symbol:s signal_date:d entry_date:d entry_px:f exit_date:d exit_px:f ret_pct:f spy_ret_pct:f "
    "excess_pct:f net_excess_pct:f horizon:i status:s")
SOURCES = _schema(
    "id:i name:s url:s kind:s category:s ticker:s weight:f enabled:b poll_minutes:i etag:s last_modified:s last_status:i "
    "last_fetch:t last_success:t fail_count:i items_total:i")
SOURCE_HEALTH = _schema("created_at:t source:s entries_fetched:i errors:i skipped_domains:i full_text_fetched:i full_text_failed:i")
HOLDINGS = _schema("symbol:s name:s shares:n keywords:as display_order:i")
PORTFOLIO_META = _schema("cost_basis_eur:n as_of:d")
EVENTS_IN = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                          T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                          T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

"""Article filters, edits and read-side projections. ``now`` is always passed in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import text as X
from ..session import cut_lineage
from .keyed import first_per_key, latest_per_key, patch
from .phrases import short_phrases, values_of_contained, with_contained, with_known


def hours_before(now: Column, hours: int) -> Column:
    return now - F.make_dt_interval(hours=F.lit(hours))


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def is_recent(ts: Column, now: Column, hours: int = 24) -> Column:
    return F.coalesce(ts > hours_before(now, hours), F.lit(False))


def valid_articles(df: DataFrame, now: Column, min_year: int = 2000) -> DataFrame:
    """Rows with a title and a readable timestamp in [min_year, next year]."""
    ts = F.col("published_at")
    return df.where((F.length("title") > 0) & ts.isNotNull() & (F.year(ts) >= min_year) & (F.year(ts) <= F.year(now) + 1))


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy(F.desc("published_at"), "id").limit(limit) if limit else df


def fetch_unprocessed(articles: DataFrame, limit: int | None = None) -> DataFrame:
    rows = articles.where(~F.col("ai_processed"))
    return _newest(rows.select("id", "source", "title", "published_at", "category", "tickers_raw", "url",
                               X.best_text(F.col("full_text"), F.col("summary_raw")).alias("text")), limit)


def fetch_recent(articles: DataFrame, now: Column, hours: int = 24, min_relevance: int = 0, limit: int | None = None,
                 max_chars: int | None = None) -> DataFrame:
    rows = articles.where(F.col("published_at") >= hours_before(now, hours))
    if min_relevance:
        rows = rows.where(F.col("ai_relevance_score") >= min_relevance)
    return _newest(rows.select(
        "id", "source", "title", "published_at", "category", "tickers_raw", "ai_sentiment", "ai_relevance_score", "ai_summary",
        "url", X.best_text(F.col("full_text"), F.col("summary_raw"), max_chars).alias("text")), limit)


def mark_processed(articles: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Apply analyst edits (one row per id, null columns leave the old value) and stamp the time."""
    e = edits.withColumns({"ai_processed": F.lit(True), "ai_processed_at": now})
    return patch(articles, e, ["id"])


def preset_edits(ids: DataFrame, action: str) -> DataFrame:
    """The bulk actions of the news page as edit rows."""
    if action in ("bullish", "bearish"):
        return ids.select("id", F.lit(action).alias("ai_sentiment"), F.lit(70).alias("ai_relevance_score"))
    if action == "dismiss":
        return ids.select("id", F.lit(0).alias("ai_relevance_score"), F.lit("dismiss").alias("ai_suggested_action"))
    raise ValueError(f"unknown action {action!r}")


def collapse_titles(feed: DataFrame) -> DataFrame:
    """One row per normalised title: the newest."""
    keyed = feed.withColumn("title_key", X.norm_title_key(F.col("title")))
    return latest_per_key(keyed, ["title_key"], ["published_at", F.col("id")]).drop("title_key")


def news_feed(articles: DataFrame, scores: DataFrame, now: Column, hours: int = 72, ticker: str | None = None,
              alias: str | Column | None = None, q: str | None = None, f: str | None = None, before: Column | None = None,
              limit: int | None = None, model: str = "finbert") -> DataFrame:
    """The filtered, key-paged news list with one row per story title.

    Titles are collapsed first and the newest ``limit`` stories taken after. ``alias`` is a pattern, or a column with one; without it a ticker's
    known alias or the ticker itself is looked for.
    """
    a = articles.where(F.col("published_at") > hours_before(now, hours))
    if ticker:
        pattern = K.TICKER_PAGE_ALIASES.get(ticker, ticker.lower()) if alias is None else alias
        pattern = F.concat(F.lit(r"(?iu)\b("), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(r")\b"))
        a = a.where(((F.col("source") == "SEC EDGAR") & F.array_contains("tickers_raw", ticker))
                    | F.regexp_like("title", pattern))
    if q:
        a = a.where(F.contains(F.lower("title"), F.lit(q.lower())))
    if before is not None:
        a = a.where(F.col("published_at") < before)
    if f == "analysed":
        a = a.where(F.col("ai_summary").isNotNull())
    elif f == "holdings":
        a = a.where(F.col("title").rlike(X.ANY_CASE + K.HOLDING_TITLE))
    elif f == "filings":
        a = a.where(F.col("source") == "SEC EDGAR")
    rows = articles_with_scores(a, scores, model)
    if f == "pos":
        rows = rows.where(F.col("score") > 0.15)
    elif f == "neg":
        rows = rows.where(F.col("score") < -0.15)
    page = collapse_titles(rows.select("id", "title", "url", "source", "published_at", "tickers_raw", "ai_sentiment", "ai_relevance_score",
                               F.col("ai_summary").isNotNull().alias("analysed"), F.col("score").alias("fb")))
    return _newest(page, limit).withColumns({"greek": F.col("title").rlike(K.GREEK), "tickers_raw": F.slice("tickers_raw", 1, 4)})


def dashboard_news(articles: DataFrame, filter: str = "all", query: str = "", source: str = "all") -> DataFrame:
    df = articles if source == "all" else articles.where(F.col("source") == source)
    text = query.strip().lower()
    if text:
        df = df.where(F.contains(F.lower("title"), F.lit(text))
                      | F.contains(F.lower(X.text_or_empty(F.col("ai_summary"))), F.lit(text)))
    by = {"all": F.lit(True), "bullish": F.col("ai_sentiment") == "bullish", "bearish": F.col("ai_sentiment") == "bearish",
          "high relevance": F.coalesce("ai_relevance_score", F.lit(0)) >= 60,
          "holdings": F.col("title").rlike(X.ANY_CASE + K.HOLDING_TITLE), "filings": F.col("source") == "SEC EDGAR"}
    return df.where(by[filter])


def dashboard_news_counts(articles: DataFrame) -> DataFrame:
    """How many articles each news filter would show."""
    return articles.agg(
        F.count("*").alias("all"), F.count_if(F.col("ai_sentiment") == "bullish").alias("bullish"),
        F.count_if(F.col("ai_sentiment") == "bearish").alias("bearish"),
        F.count_if(F.coalesce("ai_relevance_score", F.lit(0)) >= 60).alias("high_relevance"),
        F.count_if(F.col("title").rlike(X.ANY_CASE + K.HOLDING_TITLE)).alias("holdings"),
        F.count_if(F.col("source") == "SEC EDGAR").alias("filings"))


def match_keywords(articles: DataFrame, watch: dict[str, list[str]] | DataFrame, max_keywords: int | None = None, short_rows: int = 100_000) -> DataFrame:
    """(article columns, symbol) for each watched symbol with a keyword equal to a tag or inside title + summary; keywords are lower case.

    A list typed by people becomes literals of one pass. A table (symbol, keyword) of any size meets the articles through the index of
    :mod:`.phrases` and an equi-join on tags, in one pass too; its shortest keywords, at most ``short_rows`` rows of it, are looked up in the scanning task.
    An article comes once for each of its symbols; null keywords match nothing. ``max_keywords`` bounds the keywords in one literal expression of a list;
    longer lists are matched block by block, each symbol in one block.
    """
    if isinstance(watch, DataFrame):
        return _match_table(articles, watch, short_rows)
    blocks, held = [{}], 0
    for symbol, keys in watch.items():
        if blocks[-1] and max_keywords and held + len(keys) > max_keywords:
            blocks.append({})
            held = 0
        blocks[-1][symbol] = keys
        held += len(keys)
    return reduce(lambda x, y: x.unionByName(y), [_match_block(articles, b) for b in blocks])


def _match_table(articles: DataFrame, watch: DataFrame, short_rows: int) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("ai_summary", F.lit(""))))
    tags = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("ai_affected_tickers", "tickers_raw")])
    keys = cut_lineage(watch.where(F.col("keyword").isNotNull()).select("symbol", "keyword").distinct())
    # short keywords, which nearly every text holds, give their symbols in the scanning task; the others go through the index
    short = cut_lineage(short_phrases(keys.where(F.col("symbol").isNotNull()).select(F.col("keyword").alias("phrase"), F.col("symbol").alias("value")), most=short_rows))
    rest = keys.join(short.select(F.col("phrase").alias("keyword"), F.col("value").alias("symbol")), ["symbol", "keyword"], "left_anti")
    a = with_contained(articles, text, rest.select(F.col("keyword").alias("phrase"), F.lit("").alias("value")), "__in_text")
    a = with_known(a, F.transform(tags, lambda t: F.lower(t)), keys.select(F.col("keyword").alias("symbol")), "__in_tags")
    # sets of keywords are looked up once: by their hash, so keywords are compared again
    none = F.array().cast("array<string>")
    a = a.withColumns({"__phrases": F.array_sort(F.col("__in_text.phrase"))}).withColumns({"__set": F.xxhash64("__phrases"), "__tagset": F.xxhash64("__in_tags")})

    def symbols_of(words: str, name: str, table: DataFrame) -> DataFrame:
        each = a.select(F.col(name).alias("__of"), F.explode(words).alias("keyword")).distinct().join(table, "keyword")
        return each.groupBy(F.col("__of").alias(name)).agg(F.collect_set(F.struct("keyword", "symbol")).alias(f"{name}_why"))

    for words, name, table in (("__phrases", "__set", rest), ("__in_tags", "__tagset", keys)):
        a = a.join(symbols_of(words, name, table), name, "left")
    why = lambda words, name: F.coalesce(F.transform(F.filter(f"{name}_why", lambda x: F.array_contains(words, x["keyword"])), lambda x: x["symbol"]), none)
    far = F.concat(why("__phrases", "__set"), why("__in_tags", "__tagset"))
    a = a.select(*articles.columns, far.alias("__far"), values_of_contained(short)(text).alias("__near"))
    return a.select(*articles.columns, F.explode(F.array_distinct(F.concat("__far", "__near"))).alias("symbol"))


def _match_block(articles: DataFrame, watch: dict[str, list[str]]) -> DataFrame:
    tags = F.transform(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>"))
                                  for c in ("ai_affected_tickers", "tickers_raw")]), lambda t: F.lower(t))
    a = articles.withColumns({"__tags": tags, "__text": F.lower(F.concat_ws(" ", "title", F.coalesce("ai_summary", F.lit(""))))})
    hits = [F.when(reduce(lambda x, y: x | y, [F.array_contains("__tags", k) | F.contains(F.col("__text"), F.lit(k)) for k in keys]),
                   F.lit(s)) for s, keys in watch.items() if keys]
    return a.withColumn("symbol", F.explode(F.array_compact(F.array(*hits) if hits else F.array().cast("array<string>")))).drop("__tags", "__text")


def mirror_worthy(articles: DataFrame, now: Column, days: int = 5, worthy: int = 40) -> DataFrame:
    keep = ((F.col("ai_relevance_score") >= worthy) | F.col("ai_summary").isNotNull()
            | F.col("title").rlike(X.ANY_CASE + K.HOLDING_TITLE))
    return articles.where((F.col("published_at") > days_before(now, days)) & keep)


def apply_retention(articles: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Blank heavy text of old rows."""
    old = F.col("published_at") < days_before(now, days)
    return articles.withColumns({c: F.when(~F.coalesce(old, F.lit(False)), F.col(c)) for c in ("full_text", "summary_raw")})


def expire_health(health: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return health.where(~(F.col("created_at") < days_before(now, days)))


def latest_rows(df: DataFrame, n: int, ts: str = "created_at") -> DataFrame:
    """The newest n digests or calls."""
    return df.orderBy(F.desc(ts), F.desc("id")).limit(n)


def high_relevance(articles: DataFrame, k: int = 7, floor: int = 60) -> DataFrame:
    return articles.where(F.col("ai_relevance_score") >= floor).orderBy(F.desc("published_at"), "id").limit(k)


def articles_with_scores(articles: DataFrame, scores: DataFrame, model: str = "finbert") -> DataFrame:
    s = scores.where(F.col("model") == model).select(F.col("article_id").alias("id"), "score")
    return articles.join(s, "id", "left")


def unscored(articles: DataFrame, scores: DataFrame, model: str = "finbert") -> DataFrame:
    s = scores.where(F.col("model") == model).select(F.col("article_id").alias("id"))
    return articles.join(s, "id", "left_anti")


def symbol_enrich(df: DataFrame, universe: DataFrame, macro=None) -> DataFrame:
    """Add name and sector; unknown symbols show themselves, macro themes the sector 'Macro'."""
    u = universe.select("symbol", F.col("name").alias("__n"), F.col("sector").alias("__s"))
    is_macro = F.col("symbol").isin(list(macro or K.MACRO))
    return df.join(u, "symbol", "left").select(
        *df.columns, F.coalesce("__n", "symbol").alias("name"),
        F.coalesce("__s", F.when(is_macro, "Macro").otherwise("")).alias("sector"))


def sources_with_overrides(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    o = overrides.select("name", F.col("enabled").alias("__on"))
    return sources.join(o, "name", "left").withColumn("enabled", F.coalesce("__on", "enabled")).drop("__on")


def incremental_articles(articles: DataFrame, mark: Column, now: Column, limit: int | None = None, mark_id: Column | None = None) -> DataFrame:
    """Worthy rows changed after the high-water mark, oldest change first.

    Without ``limit`` the next mark is the last wm. With one, rows of a single wm may fall on two pages: pass the last row's id as ``mark_id`` too.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    wm = F.greatest(F.coalesce("ai_processed_at", epoch), F.coalesce("scraped_at", epoch))
    near = (F.col("ai_processed_at") >= mark) | (F.col("scraped_at") >= mark) | (mark <= epoch)  # plain comparisons reach the scan
    rows = mirror_worthy(articles.where(near), now).withColumn("wm", wm)
    rows = rows.where((F.col("wm") > mark) | ((F.col("wm") == mark) & (F.col("id") > mark_id)) if mark_id is not None else F.col("wm") > mark)
    return rows.orderBy("wm", "id").limit(limit) if limit else rows


def incremental_digests_calls(digests: DataFrame, calls: DataFrame, mark: Column) -> DataFrame:
    """(kind, id, created_at) of digests and calls created, or calls checked, after the mark."""
    d = digests.where(F.col("created_at") > mark).select(F.lit("digest").alias("kind"), F.col("id").cast("string").alias("id"), "created_at")
    c = calls.where((F.col("created_at") > mark) | (F.col("outcome_checked_at") > mark)).select(
        F.lit("call").alias("kind"), F.col("id").cast("string").alias("id"), "created_at")
    return d.unionByName(c)


def mirror_selection(articles: DataFrame, now: Column, holdings=None, days: int = 3, k: int | None = None,
                     k_analysed: int | None = None) -> DataFrame:
    """Union of the newest relevant, newest holding-tagged and analysed rows, one per url."""
    holdings = list(holdings or K.HOLDINGS)
    recent = articles.where(F.col("published_at") >= days_before(now, days))
    tagged = F.coalesce(F.arrays_overlap("tickers_raw", F.array(*map(F.lit, holdings))), F.lit(False))
    parts = [_newest(recent.where(F.col("ai_relevance_score") >= 60), k), _newest(recent.where(tagged), k),
             _newest(recent.where(F.col("ai_summary").isNotNull()), k_analysed)]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return first_per_key(both, ["url"], [F.col("id")])


def notify_candidates(articles: DataFrame, notified: DataFrame, threshold: int = 70, holdings=None, limit: int | None = None) -> DataFrame:
    """Processed, relevant rows tagged with a holding and not notified before, the newest ``limit`` of them if one is given."""
    holdings = list(holdings or K.HOLDINGS)
    rows = articles.where(F.col("ai_processed") & (F.col("ai_relevance_score") >= threshold)).join(notified.select("id"), "id", "left_anti")
    tags = F.when(F.size("ai_affected_tickers") > 0, F.col("ai_affected_tickers")).otherwise(F.col("tickers_raw"))
    held = rows.withColumn("held", F.array_intersect(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, holdings))))
    return _newest(held.where(F.size("held") > 0), limit)


def phone_alerts(candidates: DataFrame, now: Column, k: int = 3, aliases: dict[str, str] | None = None) -> DataFrame:
    """The few candidates worth a phone alert: fresh, naming the holding in the headline, analysed or very relevant."""
    ok = (is_recent(F.col("published_at"), now) & X.about_holding(F.col("title"), F.col("held"), aliases)
          & ((F.length("ai_summary") > 0) | (F.col("ai_relevance_score") >= 85)))
    return candidates.where(ok).orderBy(F.desc("published_at"), "id").limit(k)


def notify_digests(digests: DataFrame, notified: DataFrame, k: int = 5) -> DataFrame:
    return digests.join(notified.select("id"), "id", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(k)

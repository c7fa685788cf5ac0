"""Report queries: counts, hit rates, health, portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from .articles import days_before, hours_before, match_keywords
from .keyed import patch
from .scoring import scoring_backlog

_decided = lambda c="outcome": F.col(c).isin("correct", "incorrect")


def hit_rate_running(calls: DataFrame, outcome: str = "outcome") -> DataFrame:
    o = F.col(outcome)
    g = calls.agg(F.count_if(o == "correct").alias("correct"), F.count_if(o == "incorrect").alias("incorrect"),
                  F.count_if(o == "unclear").alias("unclear"), F.count_if(o.isNull()).alias("pending"))
    return g.withColumn("hit_rate_pct", F.try_divide(F.col("correct") * 100.0, F.col("correct") + F.col("incorrect")))


def calibrate_confidence(calls: DataFrame, outcome: str = "outcome") -> DataFrame:
    d = calls.where(_decided(outcome)).groupBy(S.confidence_bucket(F.col("confidence")).alias("bucket"))
    return d.agg(F.count("*").alias("total"), F.count_if(F.col(outcome) == "correct").alias("correct")).withColumn("hit_rate_pct", F.col("correct") / F.col("total") * 100)


def hit_rate_by_theme(calls: DataFrame, theme: str = "ticker_or_theme", outcome: str = "outcome") -> DataFrame:
    g = calls.where(_decided(outcome)).groupBy(F.col(theme).alias("theme"))
    return g.agg(F.count("*").alias("total"), F.count_if(F.col(outcome) == "correct").alias("correct"),
                 F.count_if(F.col(outcome) == "incorrect").alias("incorrect")).orderBy(F.desc("total"), "theme")


def track_record(scored: DataFrame, logged: Column | None = None, threshold: float = 0.5, min_n: int = 30) -> DataFrame:
    """The one-row honest summary of scored directional calls (see ``score_calls`` after ``dedupe_calls``)."""
    done = F.col("verdict").isNotNull()
    dec, hit, bull = F.col("verdict").isin("correct", "incorrect"), F.col("verdict") == "correct", done & (F.col("call") == "bullish")
    ex = bull & F.col("excess_pct").isNotNull()
    g = scored.agg(
        F.count("*").alias("directional"), F.count_if(done).alias("scored"), F.count_if(~done & F.col("symbol").isNotNull()).alias("pending"),
        F.count_if(F.col("symbol").isNull()).alias("unscorable"), F.count_if(dec).alias("n_decided"), F.count_if(hit).alias("hits"),
        F.count_if(bull).alias("n_bullish"), F.count_if(bull & (F.col("return_pct") >= threshold)).alias("n_up"),
        F.count_if(ex).alias("n_vs_benchmark"), F.count_if(ex & (F.col("excess_pct") > 0)).alias("n_beat"), F.avg(F.when(ex, F.col("excess_pct"))).alias("mean_excess_pct"))
    g = g.withColumns({"hit_rate": F.try_divide("hits", "n_decided"), "ci": S.wilson(F.col("hits"), F.col("n_decided")), "up_rate": F.try_divide("n_up", "n_bullish")})
    base = F.greatest(F.coalesce(F.nullif(F.col("up_rate"), F.lit(0.0)), F.lit(0.5)), F.lit(0.5))
    v = (F.when(F.col("n_decided") < min_n, "too few decided calls").when(F.col("ci.lo") > base, "some evidence of edge").otherwise("not distinguishable from luck or drift"))
    return g.select("directional", "scored", "pending", "unscorable", "n_decided", "hits", "hit_rate", F.col("ci.lo").alias("ci_lo"), F.col("ci.hi").alias("ci_hi"),
                    "n_bullish", "n_up", "up_rate", "n_vs_benchmark", "n_beat", "mean_excess_pct", v.alias("verdict"))


def track_record_breakdown(scored: DataFrame, k_symbols: int = 8) -> DataFrame:
    """(dimension, key, n, hits) by direction, confidence and the most called symbols."""
    d = scored.where(F.col("verdict").isin("correct", "incorrect"))
    conf = F.col("confidence")
    band = F.when(conf >= 70, "high 70+").when(conf >= 40, "medium 40-69").when(conf.isNotNull(), "low <40")
    dims = F.array(F.struct(F.lit("direction").alias("dimension"), F.col("call").alias("key")), F.struct(F.lit("symbol").alias("dimension"), F.col("symbol").alias("key")),
                   F.struct(F.lit("confidence").alias("dimension"), band.alias("key")))
    g = d.select(F.explode(dims).alias("x"), "verdict").where(F.col("x.key").isNotNull()).groupBy("x.dimension", "x.key").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "correct").alias("hits"))
    top = g.where("dimension = 'symbol'").orderBy(F.desc("n"), "key").limit(k_symbols)
    return g.where("dimension <> 'symbol'").unionByName(top)


def article_counts(articles: DataFrame, now: Column, worthy: int = 40) -> DataFrame:
    ts = F.col("published_at")
    day = ts > hours_before(now, 24)
    return articles.agg(F.count("*").alias("total"), F.count_if(ts > hours_before(now, 1)).alias("h1"), F.count_if(day).alias("h24"),
                        F.count_if(day & (F.col("ai_relevance_score") >= worthy)).alias("worthy24"), F.max(ts).alias("newest"))


def articles_per_day(articles: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return articles.where(F.col("published_at") > days_before(now, days)).groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))


def sentiment_mix(articles: DataFrame, now: Column | None = None, hours: int = 24) -> DataFrame:
    a = articles if now is None else articles.where(F.col("published_at") > hours_before(now, hours))
    return a.groupBy(F.coalesce("ai_sentiment", F.lit("none")).alias("sentiment")).agg(F.count("*").alias("n"))


def source_kinds(sources: DataFrame) -> DataFrame:
    return sources.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("fail_count") >= 3).alias("failing"))


def failing_sources(sources: DataFrame, k: int = 8) -> DataFrame:
    return sources.where(F.col("fail_count") >= 3).orderBy(F.desc("fail_count"), "name").limit(k)


def ingest_runs(health: DataFrame, now: Column, hours: int = 24, source: str = "INGEST_ALL") -> DataFrame:
    h = health.where((F.col("source") == source) & (F.col("created_at") > hours_before(now, hours)))
    return h.select("created_at", "entries_fetched", "errors").orderBy("created_at")


def source_health(fetches: DataFrame) -> DataFrame:
    """Per source: entries, errors and full-text outcomes, blocked domains counted as skipped.

    ``fetches``: source, entries, status (HTTP code or 0), fetch_state (ok, failed, skipped or null).
    """
    bad = ~F.col("status").isin(200, 304)
    return fetches.groupBy("source").agg(
        F.sum("entries").cast("long").alias("entries_fetched"), F.count_if(bad).alias("errors"), F.count_if(F.col("fetch_state") == "ok").alias("full_text_fetched"),
        F.count_if(F.col("fetch_state") == "failed").alias("full_text_failed"), F.count_if(F.col("fetch_state") == "skipped").alias("skipped_domains"))


def status_codes(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy("status").agg(F.count("*").alias("n"))


def ticker_heatmap(articles: DataFrame, k: int = 16) -> DataFrame:
    t = articles.select(F.explode("tickers_raw").alias("ticker"), "ai_sentiment").groupBy("ticker").agg(
        F.count("*").alias("total"), F.count_if(F.col("ai_sentiment") == "bullish").alias("bullish"), F.count_if(F.col("ai_sentiment") == "bearish").alias("bearish"))
    return t.withColumn("net", F.col("bullish") - F.col("bearish")).orderBy(F.desc("total"), "ticker").limit(k)


def holdings_quotes(holdings: DataFrame, quotes: DataFrame, eur_usd: Column) -> DataFrame:
    """Holdings with quote and value in EUR (null without a price)."""
    j = holdings.join(quotes.select("symbol", "price", "currency"), "symbol", "left")
    v = F.col("shares") * F.col("price")
    return j.withColumn("value_eur", F.when((F.col("currency") == "USD") & eur_usd.isNotNull() & (eur_usd != 0), v / eur_usd).otherwise(v))


def portfolio_value(holdings: DataFrame, quotes: DataFrame, eur_usd: Column, cost_basis: Column) -> DataFrame:
    """One row: total, unrealised gain and percent (null unless everything is priced)."""
    g = holdings_quotes(holdings, quotes, eur_usd).agg(F.count("*").alias("n"), F.coalesce(F.sum("value_eur"), F.lit(0.0)).alias("total_eur"),
                                                       F.coalesce(F.bool_and(F.col("value_eur").isNotNull()), F.lit(True)).alias("all_priced"))
    gain = F.when(F.col("all_priced"), F.col("total_eur") - cost_basis)
    return g.withColumn("unrealized_eur", gain).withColumn("unrealized_pct", F.try_divide(F.col("unrealized_eur"), cost_basis) * 100)


def portfolio_weights(holdings: DataFrame, quotes: DataFrame, eur_usd: Column) -> DataFrame:
    """Each holding's value and share of the total; the total is a scalar subquery."""
    v = holdings_quotes(holdings, quotes, eur_usd)
    t = v.agg(F.struct(F.sum("value_eur").alias("total"), F.bool_and(F.col("value_eur").isNotNull()).alias("all"))).scalar()
    return v.withColumn("__t", t).withColumn("weight_pct", F.when(F.col("__t.all"), F.col("value_eur") / F.col("__t.total") * 100)).drop("__t")


def holding_news_stats(articles: DataFrame, watch: dict[str, list[str]]) -> DataFrame:
    m = match_keywords(articles, watch)
    action = F.coalesce("ai_suggested_action", F.lit(""))
    return m.groupBy("symbol").agg(
        F.count("*").alias("matches"), F.count_if(F.col("ai_relevance_score") >= 55).alias("high_relevance"),
        F.count_if((action == "buy") | (F.coalesce("ai_sentiment", F.lit("")) == "bullish")).alias("bullish"),
        F.count_if((action == "sell") | (F.coalesce("ai_sentiment", F.lit("")) == "bearish")).alias("bearish"))


def digest_coverage(articles: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    since = hours_before(now, hours)
    return articles.where(F.col("published_at") >= since).agg(F.count("*").cast("int").alias("articles_covered")).select(
        since.alias("period_start"), now.alias("period_end"), "articles_covered")


def write_digest(digests: DataFrame, articles: DataFrame, now: Column, summary: str, themes: str = "", guidance: str | None = None,
                 watchlist_notes: dict[str, str] | None = None, hours: int = 24, digest_id: str | None = None) -> DataFrame:
    """The digest table with one more row covering the window."""
    notes = F.create_map(*[F.lit(x) for kv in watchlist_notes.items() for x in kv]) if watchlist_notes else F.lit(None).cast("map<string,string>")
    row = digest_coverage(articles, now, hours).select(
        F.coalesce(F.lit(digest_id), F.uuid()).alias("id"), now.alias("created_at"), "period_start", "period_end", "articles_covered", F.lit(summary).alias("summary"),
        X.split_themes(F.lit(themes)).alias("key_themes"), F.lit(guidance).cast("string").alias("guidance"), notes.alias("watchlist_notes"))
    return digests.unionByName(row, allowMissingColumns=True)


def stale_sources(sources: DataFrame, now: Column, slack: float = 0.9, max_poll: int | None = None, limit: int | None = None) -> DataFrame:
    """Enabled sources that are due: never fetched, or older than slack x poll interval; stalest first."""
    age = F.unix_micros(now) - F.unix_micros("last_fetch")
    due = F.col("last_fetch").isNull() | (age >= F.col("poll_minutes") * slack * 60_000_000)
    s = sources.where(F.col("enabled") & due)
    if max_poll:
        s = s.where(F.col("poll_minutes") <= max_poll)
    s = s.orderBy(F.asc_nulls_first("last_fetch"), "id")
    return s.limit(limit) if limit else s


def source_state_update(sources: DataFrame, results: DataFrame, now: Column, give_up: int = 12, revive_days: int = 7) -> DataFrame:
    """Sources after one run. ``results``: id, status ('skipped' or an HTTP code or error as text; what is no number is kept as 0), n, etag, last_modified; one row per source.

    Long-disabled sources are revived first. Good answers reset the failure count and keep new validators.
    """
    dead = ~F.col("enabled") & (F.col("last_fetch") < days_before(now, revive_days))
    s = sources.withColumns({"fail_count": F.when(dead, 0).otherwise(F.col("fail_count")), "enabled": F.col("enabled") | F.coalesce(dead, F.lit(False))})
    r = results.where(F.col("status") != "skipped")
    r = r.join(s.select("id", F.col("fail_count").alias("__f"), F.col("items_total").alias("__t")), "id")
    ok = F.col("status").isin("200", "304")
    fails = F.when(ok, 0).otherwise(F.coalesce("__f", F.lit(0)) + 1)
    edits = r.select("id", F.when(ok, F.col("etag")).alias("etag"), F.when(ok, F.col("last_modified")).alias("last_modified"), F.coalesce(F.col("status").try_cast("int"), F.lit(0)).alias("last_status"),
                     now.alias("last_fetch"), F.when(ok, now).alias("last_success"), fails.cast("int").alias("fail_count"),
                     (F.coalesce("__t", F.lit(0)) + F.col("n")).cast("int").alias("items_total"), (fails < give_up).alias("enabled"))
    return patch(s, edits, ["id"])


def status_report(articles: DataFrame, scores: DataFrame, sources: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """One JSON document with the counters of the status page, assembled from scalar subqueries."""
    arr = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()
    one = lambda df: df.select(F.struct(*df.columns)).scalar()
    doc = F.struct(one(article_counts(articles, now)).alias("counts"), one(scoring_backlog(articles, scores, now)).alias("scoring"), arr(source_kinds(sources)).alias("sources"),
                   arr(ingest_runs(health, now)).alias("ingest"), arr(articles_per_day(articles, now)).alias("per_day"), arr(sentiment_mix(articles, now)).alias("mix24"))
    return articles.sparkSession.range(1).select(now.alias("updated_at"), F.to_json(doc).alias("data"))

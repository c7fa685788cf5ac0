"""Answers that only show over restarts, odd inputs or long lists."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark import lookups as K
from tidemark.catalog.core import moment
from tidemark.functions import text as X
from tidemark.operators import articles as A
from tidemark.operators import asof as P
from tidemark.operators import dedupe as D
from tidemark.operators import evaluate as E
from tidemark.operators import lab as L
from tidemark.operators import reports as R
from tidemark.plans import pages as G
from tidemark.streaming import jobs as J

ARTICLE = "id long, title string, published_at timestamp, ai_processed boolean, ai_relevance_score int, ai_affected_tickers array<string>, tickers_raw array<string>"


def article(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}", None, True, 90, ["NVDA"], []) for i in ids], ARTICLE).withColumn("published_at", moment("2024-01-01 00:00:00"))


def test_notified_once_over_two_checkpoints(spark, tmp_path):
    src, published = str(tmp_path / "in"), []
    article(spark, 1).write.mode("append").parquet(src)
    schema = article(spark, 1).schema
    for run in ("a", "b", "a"):
        if run == "b":
            article(spark, 2).write.mode("append").parquet(src)
        s = J.read_stream(spark, src, schema)
        J.stream_notifications(s, str(tmp_path / "table"), str(tmp_path / f"state-{run}"), publish=lambda df: published.extend(r["id"] for r in df.collect())).awaitTermination()
    assert sorted(published) == [1, 2]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [1, 2]


def test_status_that_is_no_number(spark):
    sources = spark.createDataFrame([(1, 0, True, None, None, None, None, 5, None)], "id int, fail_count int, enabled boolean, etag string, last_modified string, last_fetch timestamp, last_success timestamp, items_total int, last_status int")
    results = spark.createDataFrame([(1, "timeout", 0, None, None)], "id int, status string, n int, etag string, last_modified string")
    row = R.source_state_update(sources, results, moment("2024-01-01 00:00:00")).first()
    assert (row["last_status"], row["fail_count"], row["items_total"]) == (0, 1, 5)


CALL = "id long, created_at timestamp, symbol string, ticker_or_theme string, call string, confidence int, horizon_days int, entry_price double, outcome string"


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(1, None, "Crude oil squeeze", "bullish", None), (2, None, "WTI crude", "bullish", None), (3, "CL=F", "oil", "bearish", None), (4, "NVDA", "x", "bullish", "correct"),
            (5, None, "weather", "bullish", None), (6, "NVDA", "x", "neutral", None), (7, "ABC", "x", "bullish", None)]
    out = spark.createDataFrame([(i, None, s, t, c, 50, 5, None, o) for i, s, t, c, o in rows], CALL)
    return out.withColumn("created_at", F.timestamp_add("MINUTE", F.col("id").cast("int"), moment("2024-01-02 22:00:00")))


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([(s, d, p) for s, ps in (("CL=F", (100.0, 110.0)), ("NVDA", (100.0, 90.0)), ("ABC", (10.0, 11.0))) for d, p in zip(("2024-01-02", "2024-01-07"), ps)], "symbol string, d string, close double").select(
        F.col("d").cast("date").alias("date"), "symbol", "close", F.lit(1.0).alias("volume"))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("2024-01-02", 100.0), ("2024-01-07", 101.0)], "d string, close double").select(F.col("d").cast("date").alias("date"), "close")


def test_themes_resolve_before_calls_fold(calls):
    got = sorted((r["view"], r["call"], r["id"]) for r in D.dedupe_calls(calls).collect())
    assert got == [("ABC", "bullish", 7), ("CL=F", "bearish", 3), ("CL=F", "bullish", 1), ("NVDA", "bullish", 4), ("weather", "bullish", 5)]


def test_only_open_calls_are_reported(calls, bars):
    row = P.unscored_calls_report(calls, bars, moment("2024-02-01 00:00:00")).first()
    assert (row["checked"], row["skipped"], row["unmapped"]) == (5, 0, 1)  # 1, 2, 3, 6, 7; 5 has no symbol; 4 is scored


def test_excess_for_stocks_only(calls, bars, bench):
    rows = {r["id"]: r for r in P.score_calls(D.dedupe_calls(calls), bars, bench, moment("2024-02-01 00:00:00")).collect()}
    assert round(rows[4]["excess_pct"], 6) == -11 and rows[1]["excess_pct"] is None and rows[7]["excess_pct"] is None
    assert rows[1]["verdict"] == "correct" and rows[3]["verdict"] == "incorrect" and rows[5]["verdict"] is None
    named = {r["id"]: r["excess_pct"] for r in P.score_calls(D.dedupe_calls(calls), bars, bench, moment("2024-02-01 00:00:00"), stocks=["ABC"]).collect()}
    assert round(named[7], 6) == 9 and named[4] is None


def test_macro_symbols_have_prices(spark):
    snaps = spark.createDataFrame([("OIL", "ens", 0.5, 1.0, 5)], "symbol string, model string, idx double, z double, n_lead int").withColumn("ts", moment("2024-01-02 10:00:00"))
    bars = spark.createDataFrame([("CL=F", f"2024-01-0{k}", 100.0 + k) for k in range(2, 9)], "symbol string, d string, close double").select("symbol", F.col("d").cast("date").alias("date"), "close")
    obs = E.signal_observations(snaps, bars, bars.select("date", "close"), moment("2024-01-01 00:00:00"))
    assert obs.where("kind = 'raw' and metric = 'index'").count() == 3


@pytest.mark.parametrize("pattern", ["colou{0,1}r", "colou?r", "colou*r", r"\bcolou{0,1}r\b|grey{2}", "colo[u|v]?r"])
def test_prefilter_drops_no_match(spark, pattern):
    rows = spark.createDataFrame([("color up",), ("a COLOUR",), ("greyy",), ("none",)], "t string")
    got = [r["h"] for r in rows.select(X.any_case(F.col("t"), F.lower("t"), pattern).alias("h")).collect()]
    assert got == [re.search(pattern, r["t"], re.I) is not None for r in rows.collect()]


def news(spark, n):
    return spark.range(n).select(F.col("id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" end")).alias("title"), F.lit(None).cast("string").alias("ai_summary"),
                                 F.array(F.concat(F.lit("T"), F.col("id").cast("string"))).alias("ai_affected_tickers"), F.array().cast("array<string>").alias("tickers_raw"))


def test_long_watch_list_in_blocks(spark):
    watch = {f"S{k}": [f"t{k}", f"word{k} "] for k in range(300)}
    got = {(r["symbol"], r["id"]) for r in A.match_keywords(news(spark, 40), watch, max_keywords=100).select("symbol", "id").collect()}
    assert got == {(f"S{k}", k) for k in range(40)}


def test_holding_behind_many_candidates(spark):
    others = article(spark, *range(1, 61)).withColumn("ai_affected_tickers", F.array(F.lit("XYZ"))).withColumn("published_at", moment("2024-01-02 00:00:00"))
    got = A.notify_candidates(others.unionByName(article(spark, 99)), article(spark), limit=50).collect()
    assert [r["id"] for r in got] == [99]


def test_pages_of_one_mark_lose_nothing(spark):
    now, mark = moment("2024-01-03 00:00:00"), moment("2024-01-01 00:00:00")
    rows = article(spark, *range(900)).withColumns({"ai_processed_at": moment("2024-01-02 00:00:00"), "scraped_at": F.lit(None).cast("timestamp"), "ai_summary": F.lit("x")})
    first = A.incremental_articles(rows, mark, now, limit=800).collect()
    rest = A.incremental_articles(rows, F.lit(first[-1]["wm"]), now, limit=800, mark_id=F.lit(first[-1]["id"])).collect()
    assert {r["id"] for r in first + rest} == set(range(900)) and len(first) + len(rest) == 900


def test_alias_from_the_company_name(spark):
    rows = spark.createDataFrame([(1, "Zebra corp wins", "u", "s"), (2, "zzz falls", "u", "s")], "id long, title string, url string, source string").withColumns(
        {"published_at": moment("2024-01-02 00:00:00"), "tickers_raw": F.array().cast("array<string>"), "ai_sentiment": F.lit("x"), "ai_relevance_score": F.lit(1), "ai_summary": F.lit("s")})
    scores = spark.createDataFrame([], "article_id long, model string, score double")
    got = A.news_feed(rows, scores, moment("2024-01-03 00:00:00"), ticker="ZZZ", alias=F.lit(r"\Qzebra\E")).collect()
    assert [r["id"] for r in got] == [1] and "ZZZ" not in K.TICKER_PAGE_ALIASES


def test_names_as_literal_patterns(spark):
    names = ["plain", r"a\Eb.*", r"\E", r"x\\Ey\Q", "a+b(c)", ""]
    df = spark.createDataFrame([(n, t) for n in names for t in names], "n string, t string")
    for r in df.select("n", "t", F.rlike("t", G.literal_pattern(F.col("n"))).alias("hit")).collect():
        assert r.hit == (r.n in r.t), (r.n, r.t)


def test_every_row_or_every_third(spark):
    rows = spark.createDataFrame([(d, s) for d in range(4) for s in range(5)], "date int, symbol int")
    assert L.every_nth(rows, 1).count() == 20 and L.every_nth(rows, 3).count() == 7

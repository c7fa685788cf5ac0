"""Landed feed documents to article rows. Fetching is outside: these parse what a crawler has stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lookups as K
from ..functions import text as X

_S = T.StringType()


def _struct(*names, **nested) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names] + [T.StructField(n, t) for n, t in nested.items()])


_ITEM = _struct("title", "link", "description", "summary", "author", "pubDate", "published", "updated")
_ENTRY = _struct("title", "summary", "content", "published", "updated",
                 link=T.ArrayType(_struct("_href", "_rel")), author=_struct("name"))
FEED_XML = T.StructType([
    T.StructField("channel", _struct(item=T.ArrayType(_ITEM))),  # RSS 2.0
    T.StructField("item", T.ArrayType(_ITEM)),                   # RSS 1.0
    T.StructField("entry", T.ArrayType(_ENTRY)),                 # Atom
])
NEWS_JSON = T.StructType([T.StructField("articles", T.ArrayType(_struct(
    "title", "url", "description", "author", "publishedAt", source=_struct("name"))))])


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def _clip(c: Column, n: int | None) -> Column:
    return F.substring(c, 1, n) if n else c


def _alternate(links: Column) -> Column:
    """The address an Atom entry stands for: its first alternate link (a link without ``rel`` is one), else its first link."""
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.try_element_at(alternate, F.lit(1)), F.try_element_at(links, F.lit(1)))["_href"]


def feed_entries(raw: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """One row per RSS or Atom entry, beside the feed's own columns."""
    rss = lambda x: F.struct(
        x["title"].alias("title"), x["link"].alias("link"),
        F.coalesce(F.nullif(x["summary"], F.lit("")), x["description"]).alias("summary"), x["author"].alias("author"),
        x["published"].alias("d1"), x["updated"].alias("d2"), x["pubDate"].alias("d3"))
    atom = lambda x: F.struct(
        x["title"].alias("title"), _alternate(x["link"]).alias("link"),
        F.coalesce(F.nullif(x["summary"], F.lit("")), x["content"]).alias("summary"), x["author"]["name"].alias("author"),
        x["published"].alias("d1"), x["updated"].alias("d2"), F.lit(None).cast("string").alias("d3"))
    none = F.array().cast("array<struct<title:string,link:string,summary:string,author:string,d1:string,d2:string,d3:string>>")
    keep = [c for c in raw.columns if c != xml]
    return (raw.withColumn("__x", F.from_xml(F.col(xml), FEED_XML))
            .select(*keep, F.explode(F.concat(
                F.coalesce(F.transform("__x.channel.item", rss), none), F.coalesce(F.transform("__x.item", rss), none),
                F.coalesce(F.transform("__x.entry", atom), none))).alias("e"))
            .select(*keep, "e.*"))


def parse_feed_items(raw: DataFrame, now: Column, universe: list[str] | None = None, xml: str = "raw_xml",
                     title_chars: int | None = None, summary_chars: int | None = None) -> DataFrame:
    """Feed documents (name, kind, category, ticker, raw_xml) to article rows.

    Entries without a title or link, and spam, are dropped. ``universe`` limits the cashtags taken from plain feeds.
    """
    e = feed_entries(raw, xml)
    title, link = F.trim(X.text_or_empty(F.col("title"))), F.trim(X.text_or_empty(F.col("link")))
    summary = strip_tags(X.text_or_empty(F.col("summary")))
    label = F.coalesce(F.try_element_at(X._map_lookup(K.FEED_LABELS), F.col("kind")), F.col("name"))
    e = e.select("name", "kind", "category", "ticker", title.alias("title"), link.alias("url"), summary.alias("summary"),
                 "author", label.alias("source"),
                 X.parse_published(F.col("d1"), F.col("d2"), F.col("d3"), now=now).alias("published_at"))
    e = e.where((F.col("title") != "") & (F.col("url") != "") & ~X.is_spam(F.col("title"), F.col("summary")))
    found = X.tickers_in(F.concat_ws(" ", "title", "summary"), universe or [])
    return e.select("source", "url", _clip(F.col("title"), title_chars).alias("title"),
                    F.nullif(_clip(F.col("summary"), summary_chars), F.lit("")).alias("summary_raw"), "author", "published_at",
                    "category", F.when(F.length("ticker") > 0, F.array("ticker")).otherwise(found).alias("tickers_raw"), "kind")


def parse_filing_feed(entries: DataFrame, cik_map: DataFrame) -> DataFrame:
    """Regulatory filing titles ('8-K - Name (0000000000) (Filer)') to readable article titles of known companies."""
    t = F.col("title")
    got = entries.where(t.rlike(K.FILING_TITLE)).select(
        *[c for c in entries.columns if c not in ("title", "tickers_raw")],
        F.regexp_extract(t, K.FILING_TITLE, 1).alias("form"), F.regexp_extract(t, K.FILING_TITLE, 2).alias("company"),
        F.regexp_extract(t, K.FILING_TITLE, 3).alias("cik"), X.filing_items(F.col("summary_raw")).alias("items"))
    j = got.join(cik_map.select("cik", "symbol"), "cik")
    head = F.concat(F.col("symbol"), F.lit(" ("), F.col("company"), F.lit(") filed "), F.col("form"))
    tail = F.when(F.size("items") > 0, F.concat(F.lit(": "), F.array_join("items", "; "))).otherwise("")
    return j.select(*[c for c in got.columns if c not in ("cik", "company", "items")], "symbol",
                    F.concat(head, tail).alias("title"), F.array("symbol").alias("tickers_raw"))


def watchlist_filings(entries: DataFrame) -> DataFrame:
    """Per-company filing entries (name, form_type, form_name, items_desc, link, updated, filing_date) to article rows."""
    items = F.trim(X.text_or_empty(F.col("items_desc")))
    form = F.trim(F.coalesce("form_name", "form_type"))
    decoded = X.decode_items(items)
    name = F.col("name")
    inside = F.rtrim(F.element_at(F.split(name, r"\("), -1), F.lit(")"))
    return entries.where(F.length("link") > 0).select(
        F.lit("SEC EDGAR").alias("source"), F.col("link").alias("url"),
        F.concat(name, F.lit(": "), form, F.when(decoded != "", F.concat(F.lit(" -- "), decoded)).otherwise("")).alias("title"),
        F.coalesce(F.nullif(items, F.lit("")), form).alias("summary_raw"), F.lit(None).cast("string").alias("author"),
        X.parse_feed_date(F.coalesce(F.nullif(F.col("updated"), F.lit("")), F.col("filing_date"))).alias("published_at"),
        F.lit("sec-filing").alias("category"),
        F.when(name.contains("("), F.array(inside)).otherwise(F.array().cast("array<string>")).alias("tickers_raw"))


def parse_news_json(raw: DataFrame, now: Column, payload: str = "payload", summary_chars: int | None = None) -> DataFrame:
    """News API responses to article rows."""
    a = raw.select(F.explode(F.from_json(payload, NEWS_JSON)["articles"]).alias("a")).select("a.*")
    title, url = F.trim(X.text_or_empty(F.col("title"))), F.trim(X.text_or_empty(F.col("url")))
    desc = X.text_or_empty(F.col("description"))
    return a.select(
        F.coalesce(F.col("source.name"), F.lit("NewsAPI")).alias("source"), url.alias("url"), title.alias("title"),
        F.nullif(_clip(desc, summary_chars), F.lit("")).alias("summary_raw"), "author",
        F.coalesce(X.parse_ts(F.col("publishedAt")), now).alias("published_at"), F.lit("general").alias("category"),
        X.extract_tickers(F.concat_ws(" ", title, desc)).alias("tickers_raw")).where("title <> '' AND url <> ''")


def backfill_full_text(articles: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Attach the main text of stored pages by url and re-derive tickers from it. Blocked hosts are marked and skipped.

    ``fetch_state`` is ok, failed or skipped. Several stored copies of a page count as one: the newest.
    """
    todo = articles.where(~F.coalesce(F.col("full_text_fetch_attempted"), F.lit(False)))
    done = articles.where(F.coalesce(F.col("full_text_fetch_attempted"), F.lit(False)))
    p = pages.groupBy("url").agg(F.max("page_id").alias("pid"))
    html = pages.select(F.col("page_id").alias("pid"), X.main_text(F.col("html")).alias("__text"))
    j = todo.join(p.select("url", "pid").join(html, "pid"), "url", "left")
    blocked = X.is_blocked(F.col("url"))
    text = F.when(~blocked, F.col("__text"))
    merged = X.merge_tickers(F.col("tickers_raw"), X.extract_tickers(F.concat_ws(" ", "title", text)))["tickers"]
    out = j.select(*[c for c in articles.columns if c not in ("full_text", "tickers_raw", "full_text_fetch_attempted", "full_text_fetched_at")],
                   F.coalesce(text, F.col("full_text")).alias("full_text"),
                   F.when(text.isNotNull(), merged).otherwise(F.col("tickers_raw")).alias("tickers_raw"),
                   F.lit(True).alias("full_text_fetch_attempted"), now.alias("full_text_fetched_at"),
                   F.when(blocked, "skipped").when(text.isNotNull(), "ok").otherwise("failed").alias("fetch_state"))
    return out.unionByName(done, allowMissingColumns=True)

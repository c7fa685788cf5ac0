"""Page-level documents composed from operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lookups as K
from ..operators import sentiment as S
from ..operators.articles import days_before, news_feed


def _list(df: DataFrame, *cols: str) -> Column:
    """The rows of a small, filtered frame as one sorted array (a scalar subquery)."""
    return df.agg(F.array_sort(F.collect_list(F.struct(*cols)))).scalar()


def literal_pattern(c: Column) -> Column:
    """A pattern for the text itself; an end of quotation inside the text is quoted on its own."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def ticker_page(symbol: str, snaps: DataFrame, bars: DataFrame, articles: DataFrame, scores: DataFrame, universe: DataFrame,
                predictions: DataFrame, positions: DataFrame, now: Column, days: int = 14, closes: int = 90, news: int = 25) -> DataFrame:
    """Everything the page of one symbol shows, as one row."""
    own = bars.where((F.col("symbol") == symbol) & F.col("close").isNotNull())
    perf = S.price_change(own, (1, 5, 20), 25).select(F.struct("last", "d1", "d5", "d20", "asof")).scalar()
    price = _list(own.orderBy(F.desc("date")).limit(closes), "date", "close")
    cur = snaps.where((F.col("symbol") == symbol) & (F.col("ts") == S.latest_ts(snaps)))
    last = predictions.agg(F.max("pred_date")).scalar()
    lab = predictions.where((F.col("symbol") == symbol) & (F.col("pred_date") == last))
    pos = positions.where(F.col("symbol") == symbol).orderBy(F.desc("signal_date"), "book", "side").limit(12)
    named = universe.where(F.col("symbol") == symbol).agg(F.lower(F.split_part(F.max("name"), F.lit(" "), F.lit(1)))).scalar()
    alias = K.TICKER_PAGE_ALIASES.get(symbol) or literal_pattern(F.coalesce(named, F.lit(symbol.lower())))
    items = news_feed(articles, scores, now, hours=240, ticker=symbol, alias=alias, limit=news)
    known = universe.where(F.col("symbol") == symbol).agg(F.struct(F.max("name").alias("name"), F.max("sector").alias("sector"))).scalar()
    sector = F.coalesce(known["sector"], F.lit("Macro" if symbol in K.MACRO else ""))
    one = snaps.sparkSession.range(1)
    return one.select(F.lit(symbol).alias("symbol"), F.coalesce(known["name"], F.lit(symbol)).alias("name"), sector.alias("sector"), perf.alias("perf"), _list(S.ticker_series(snaps, symbol, days_before(now, days)), "model", "series").alias("series"),
                      _list(cur, "model", "idx", "z", "n_lead", "att_z").alias("current"), price.alias("price"), _list(items, "published_at", "id", "title", "source", "fb").alias("news"),
                      _list(lab, "book", "rank", "score").alias("lab"), _list(pos, "signal_date", "book", "side", "status", "net_excess_pct").alias("positions"))

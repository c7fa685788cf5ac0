"""The three end-to-end flows: articles to alerts, bars to ledger, calls to track record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators import asof as P
from ..operators import dedupe as D
from ..operators import lab as L
from ..operators import panel as W
from ..operators import reports as R
from ..operators import scoring as N
from ..operators import sentiment as S
from ..session import cut_lineage


def news_items(articles: DataFrame, model_scores: DataFrame | None = None, **scoring) -> DataFrame:
    """Scored, clustered articles with novelty and confirmations."""
    return D.story_clusters(N.score_articles(articles, model_scores, **scoring))


def news_cycle(articles: DataFrame, model_scores: DataFrame | None, start: Column, end: Column, **scoring) -> DataFrame:
    """Hourly index, z-score and attention per symbol and model from raw articles."""
    items = cut_lineage(news_items(articles, model_scores, **scoring).select(
        "id", "ts", "syms", "src_w", "event_w", "novelty", "confirm", "lex", "finbert", "ens", "old"))
    return S.backfill_index(S.by_symbol(items), start, end)


def news_alerts(snaps: DataFrame, **rules) -> DataFrame:
    return S.zscore_alerts(snaps, **rules)


def lab_scores(bars: DataFrame, bench: DataFrame, universe: DataFrame, min_symbols: int = 400) -> DataFrame:
    """Rule book scores of every date from bars."""
    panel = W.build_panel(bars, bench, universe, min_symbols=min_symbols)
    return L.strategy_scores(W.cs_rank(panel, [f"f_{f}" for f in W.FEATURES]))


def lab_day(scores: DataFrame, ledger: DataFrame, bars: DataFrame, bench: DataFrame, calendar: DataFrame, k: int = 25, min_names: int = 50, horizon: int = 5) -> DataFrame:
    """The ledger after opening today's positions and settling what has run its course."""
    book = L.rank_book(scores, k, min_names)
    return L.settle_positions(L.open_positions(ledger, book, horizon=horizon), bars, bench, calendar)


def accountability(calls: DataFrame, bars: DataFrame, bench: DataFrame, now: Column, stocks=None, threshold: float = 0.5, min_n: int = 30) -> DataFrame:
    """The track record of all logged calls, each distinct view scored once over its own horizon."""
    return R.track_record(P.score_calls(D.dedupe_calls(calls), bars, bench, now, threshold, stocks), threshold=threshold, min_n=min_n)

"""De-duplication, story clusters and article links.

Copies are the skew here: one story can hold a third of all rows. So every step first folds rows of one title into one
keyed row per 48-hour bucket, compares *distinct* titles only, finds candidate titles through their rarest tokens
(exact prefix filters, no sampling and no caps), and settles followers against leaders, never rows against rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import text as X
from ..session import cut_lineage
from .articles import hours_before
from .keyed import first_per_key, latest_per_key
from .titles import similar_titles

_HOUR = 3_600_000_000
_log = logging.getLogger(__name__)


def dedupe_url_last(df: DataFrame, ordinal: str) -> DataFrame:
    return latest_per_key(df, ["url"], [ordinal])


def dedupe_url_merge(df: DataFrame, ordinal: str, tickers: str = "tickers_raw") -> DataFrame:
    """First row per url with the tickers of all its rows.

    Tickers are exploded apart from the rows, so texts are folded once per row, and a hot url merges as a set of distinct values.
    """
    rows = first_per_key(df.drop(tickers), ["url"], [ordinal])
    tags = df.select(F.col("url").alias("__url"), F.explode(tickers).alias("__tag")).groupBy("__url").agg(F.array_sort(F.collect_set("__tag")).alias("__tags"))
    none = F.array().cast(df.schema[tickers].dataType)
    return rows.join(tags, F.col("url").eqNullSafe(F.col("__url")), "left").select(*rows.columns, F.coalesce("__tags", none).alias(tickers))


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """One directional call per (symbol or theme, direction, day), the first kept; neutral calls are removed.

    Themes are resolved to their price symbols first, so two wordings of one theme are one view, and ``symbol`` of the result is the resolved one.
    """
    c = calls.where(F.col("call").isin("bullish", "bearish")).withColumn("symbol", X.resolve_symbol(F.col("ticker_or_theme"), F.col("symbol"))).withColumns({
        "view": F.coalesce("symbol", "ticker_or_theme"), "day": F.to_date("created_at")})
    return first_per_key(c, ["view", "call", "day"], ["created_at", "id"])


# ---------------------------------------------------------------- similar titles

def _rare_first(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """(key, tokens) with each key's tokens ordered from globally rarest to commonest."""
    freq = tokens.groupBy(token).agg(F.count("*").alias("__df"))
    return (tokens.join(freq, token).groupBy(key)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__df", token))), lambda x: x[token]).alias("tokens")))


def _set_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(tkey, n, prefix) of distinct token sets: two sets at or above the Jaccard threshold share a prefix token."""
    ordered = _rare_first(sets.select("tkey", F.explode(F.split("tkey", " ")).alias("tok")), "tkey", "tok")
    n = F.size("tokens")
    return ordered.select("tkey", n.alias("n"), F.slice("tokens", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")).alias("prefix"))


def _similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) of different token sets with Jaccard >= threshold; both sides hold (tkey, bucket, n, prefix).

    Sets meet only in equal or neighbouring time buckets.
    """
    l = left.select(F.col("tkey").alias("a"), F.col("n").alias("na"), F.col("bucket").alias("ba"), F.explode("prefix").alias("tok"))
    r = right.select(F.col("tkey").alias("b"), F.col("n").alias("nb"), F.col("bucket").alias("bb"), F.explode("prefix").alias("tok"))
    r = r.withColumn("ba", F.explode(F.array(F.col("bb") - 1, F.col("bb"), F.col("bb") + 1)))
    near = l.join(r, ["tok", "ba"]).where((F.col("a") != F.col("b")) & (F.col("na") >= F.col("nb") * threshold - 1e-9)
                                          & (F.col("nb") >= F.col("na") * threshold - 1e-9)).select("a", "b").distinct()
    return near.where(X.jaccard(F.split("a", " "), F.split("b", " ")) >= threshold)


def _titled(items: DataFrame, hours: int) -> DataFrame:
    """(id, t, tkey, bucket): time in microseconds and the title's token set as one string."""
    t = F.unix_micros(F.col("ts"))
    return items.select("id", t.alias("t"), F.array_join("ntitle", " ").alias("tkey"), F.floor(t / F.lit(hours * _HOUR)).alias("bucket"))


def near_duplicate_titles(items: DataFrame, threshold: float = 0.6, hours: int = 48) -> DataFrame:
    """Pairs of distinct title word sets that are similar and have articles within ``hours`` of each other.

    Copies of one title share one set, so a mass of copies adds no pairs; articles join back through ``title_set``.
    """
    width = hours * _HOUR
    it = _titled(items, hours).where("tkey <> ''")
    nodes = it.groupBy("tkey", "bucket").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    p = nodes.join(_set_prefixes(nodes.select("tkey").distinct(), threshold), "tkey")
    pairs = _similar_sets(p, p, threshold).where("a < b")
    na = nodes.select(F.col("tkey").alias("a"), F.col("bucket").alias("ka"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    nb = nodes.select(F.col("tkey").alias("b"), F.col("bucket").alias("kb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    nb = nb.withColumn("ka", F.explode(F.array(F.col("kb") - 1, F.col("kb"), F.col("kb") + 1)))
    gap = (F.when(F.col("ka") == F.col("kb"), 0).when(F.col("ka") < F.col("kb"), F.col("blo") - F.col("ahi"))
           .otherwise(F.col("alo") - F.col("bhi")))
    near = pairs.join(na, "a").join(nb, ["b", "ka"]).where(gap <= width).select("a", "b").distinct()
    return near.select(F.col("a").alias("title_set"), F.col("b").alias("similar_set"),
                       X.jaccard(F.split("a", " "), F.split("b", " ")).alias("jaccard"))


def _peel_round(todo: DataFrame, prefixes: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One linear pass that settles the biggest groups: (new leaders, followers' ids).

    A row that is the earliest undecided one in *every* block of its prefix tokens cannot have an earlier similar row,
    so it is a leader; rows similar to it within the window follow. Only block minima are compared, never pairs.
    """
    ex = todo.join(prefixes, "tkey").select("id", "t", "tkey", "bucket", "n", "prefix", F.explode("prefix").alias("tok"))
    blocks = ex.groupBy("tok", "bucket").agg(F.min(F.struct("t", "id", "tkey", "n")).alias("m"), F.max("t").alias("hi"))
    prev = blocks.select("tok", (F.col("bucket") + 1).alias("bucket"), F.col("hi").alias("prev_hi"))
    firsts = (blocks.join(prev, ["tok", "bucket"], "left")
              .where(F.col("prev_hi").isNull() | (F.col("prev_hi") < F.col("m.t") - width))
              .groupBy("m.id", "m.t", "m.tkey", "bucket").agg(F.count("*").alias("wins")))
    leaders = cut_lineage(firsts.join(prefixes, "tkey").where(F.col("wins") == F.size("prefix"))
                          .select("id", "t", "tkey", "bucket", "n", "prefix"))
    lead = leaders.select(F.col("id").alias("lid"), F.col("t").alias("lt"), F.col("tkey").alias("lkey"), F.explode("prefix").alias("tok"),
                          F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    near = ex.join(lead, ["tok", "bucket"]).where(
        (F.struct("t", "id") > F.struct("lt", "lid")) & (F.col("t") - F.col("lt") <= width))
    hit = near.where((F.col("tkey") == F.col("lkey")) | (X.jaccard(F.split("tkey", " "), F.split("lkey", " ")) >= threshold))
    return leaders.select("id", "t", "tkey", "bucket"), hit.select("id").distinct()


def greedy_leaders(todo: DataFrame, edges: DataFrame, width: int | None) -> DataFrame:
    """Leaders of the sequential rule "keep a row unless an earlier kept row is similar and near in time".

    ``todo``: (id, t, tkey, bucket), ``edges``: symmetric (a, b) between distinct keys; rows of one key are similar too.
    Each round elects every row with no undecided similar row before it in reach, then drops what those leaders cover.
    Work per round is one row per (key, bucket) plus the undecided rows. Every round settles at least the first row of
    each group of similar titles, so the loop ends; a family that returns for months adds one round per window.
    """
    reach = edges.select("a", "b").unionByName(todo.select(F.col("tkey").alias("a"), F.col("tkey").alias("b")).distinct())
    reach = cut_lineage(reach)
    todo, leaders, rounds = cut_lineage(todo.select("id", "t", "tkey", "bucket")), None, 0
    w = width if width is not None else 1 << 62
    while not todo.isEmpty():
        rounds += 1
        nodes = todo.groupBy("tkey", "bucket").agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("hi"))
        me = nodes.select(F.col("tkey").alias("a"), "bucket", "first").join(reach, "a")
        same = nodes.select(F.col("tkey").alias("b"), "bucket", F.col("first").alias("other"))
        prev = nodes.select(F.col("tkey").alias("b"), (F.col("bucket") + 1).alias("bucket"), F.col("hi").alias("prev_hi"))
        blocked = (F.coalesce(F.col("other") < F.col("first"), F.lit(False))
                   | F.coalesce(F.col("prev_hi") >= F.col("first.t") - w, F.lit(False)))
        free = (me.join(same, ["b", "bucket"], "left").join(prev, ["b", "bucket"], "left")
                .groupBy("a", "bucket").agg(F.bool_or(blocked).alias("blocked"), F.first("first").alias("first")).where(~F.col("blocked")))
        new = cut_lineage(free.select(F.col("first.id").alias("id"), F.col("first.t").alias("t"), F.col("a").alias("tkey"), "bucket"))
        leaders = new if leaders is None else leaders.unionByName(new)
        cover = (new.join(reach, new["tkey"] == reach["a"])
                 .select(F.col("b").alias("tkey"), F.col("t").alias("lt"), F.col("id").alias("lid"),
                         F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket")))
        u, c = todo.alias("u"), cover.alias("c")
        hit = ((F.col("u.tkey") == F.col("c.tkey")) & (F.col("u.bucket") == F.col("c.bucket"))
               & (F.struct("u.t", "u.id") >= F.struct("c.lt", "c.lid")) & (F.col("u.t") - F.col("c.lt") <= w))
        todo = cut_lineage(u.join(c, hit, "left_anti"))
    _log.info("leaders among partly similar titles: %d rounds", rounds)
    return leaders if leaders is not None else todo


def _first_beyond(rows: DataFrame, width: int, parts: int = 32) -> DataFrame:
    """(key, t, next): the key's first time after ``t + width``, null if there is none. ``rows`` holds distinct (key, t).

    Times meet within slices of ``width / parts`` only, so a hot key is many small groups; where a slice holds nothing later, the least time of
    the key's next slice follows, from a table of one row per (key, slice).
    """
    size = max(width // parts, 1)
    cut = lambda c: F.floor(c / F.lit(size)).cast("long")
    data = rows.select("key", cut(F.col("t")).alias("s"), F.col("t").alias("at"), F.col("t").alias("value"), F.lit(None).cast("long").alias("t"))
    asks = rows.select("key", cut(F.col("t") + width).alias("s"), (F.col("t") + width).alias("at"), F.lit(None).cast("long").alias("value"), "t")
    later = Window.partitionBy("key", "s").orderBy(F.desc("at"), F.col("t").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    inside = data.unionByName(asks).withColumn("found", F.last("value", ignorenulls=True).over(later)).where("t is not null").select("key", "s", "t", "found")
    least = data.groupBy("key", "s").agg(F.min("value").alias("low")).unionByName(
        inside.where("found is null").select("key", "s", F.lit(None).cast("long").alias("low"))).groupBy("key", "s").agg(F.min("low").alias("low"))
    after = Window.partitionBy("key").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = least.withColumn("beyond", F.last("low", ignorenulls=True).over(after)).select("key", "s", "beyond")
    return inside.join(beyond, ["key", "s"], "left").select("key", "t", F.coalesce("found", "beyond").alias("next"))


def chain_leaders(rows: DataFrame, width: int) -> DataFrame:
    """Leaders (id) of groups whose rows are all similar to each other: a group's first row, then always its first row after the last leader's reach.

    ``rows``: (id, t, key). Leaders are what "first row beyond" jumps reach from the first row. Jumps are doubled, so the number of rounds grows with
    the logarithm of a group's time span. Rows fold to one per (key, time) first.
    """
    at = cut_lineage(rows.groupBy("key", "t").agg(F.min("id").alias("id")))
    span = at.groupBy("key").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    reached = span.select("key", F.col("first").alias("t"))
    longer = at.join(span.where(F.col("last") > F.col("first") + width).select("key"), "key", "left_semi")
    jump = _first_beyond(longer.select("key", "t"), width).where("next is not null")
    jump = cut_lineage(jump.join(jump.select("key", F.col("next").alias("t")).distinct().unionByName(reached), ["key", "t"], "left_semi"))
    rounds = 0
    while not jump.isEmpty():
        reached = cut_lineage(reached.unionByName(reached.join(jump, ["key", "t"]).select("key", F.col("next").alias("t"))).distinct())
        jump = cut_lineage(jump.join(jump.select("key", F.col("t").alias("next"), F.col("next").alias("then")), ["key", "next"]).select("key", "t", F.col("then").alias("next")))
        rounds += 1
    _log.info("chains of leaders: %d rounds", rounds)
    return at.join(reached, ["key", "t"]).select("id")


def _alike_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tkey, key) of the sets that form groups of mutually similar sets with no similar set outside; a set without similar ones is a group of its own.

    Each set's closest group is named by the least of itself and its similar sets. It is such a group if all its members have as many similar sets as it has
    members, and every edge stays inside.
    """
    low = edges.groupBy(F.col("a").alias("tkey")).agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    named = cut_lineage(nodes.join(low, "tkey", "left").select("tkey", F.least("tkey", F.coalesce("low", "tkey")).alias("key"), (F.coalesce("degree", F.lit(0)) + 1).alias("near")))
    crossing = (edges.join(named.select(F.col("tkey").alias("a"), F.col("key").alias("ka")), "a").join(named.select(F.col("tkey").alias("b"), F.col("key").alias("kb")), "b")
                .where("ka <> kb").select(F.explode(F.array("ka", "kb")).alias("key")).distinct())
    whole = named.groupBy("key").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most")).where("n = least and n = most")
    return named.join(whole.select("key"), "key", "left_semi").join(crossing, "key", "left_anti").select("tkey", "key")


def story_clusters(items: DataFrame, threshold: float = 0.6, hours: int = 48, peel_rounds: int = 1) -> DataFrame:
    """Add ``novelty`` (1 leader, 0.25 follower), ``leader_id`` and ``confirm`` (followers of a leader).

    Same result as reading the articles in (ts, id) order and comparing each title with all earlier leaders. Groups of mutually similar titles, copies of one
    title included, are settled by doubled jumps (:func:`chain_leaders`), so a title that returns for years takes no more rounds than the logarithm of
    its span; titles that are similar to some but not all of a family go through :func:`greedy_leaders`.
    """
    width = hours * _HOUR
    titled = cut_lineage(_titled(items, hours))
    todo = titled.where("tkey <> ''")
    prefixes = cut_lineage(_set_prefixes(todo.select("tkey").distinct(), threshold))
    found = []
    for _ in range(peel_rounds):
        new, followers = _peel_round(todo, prefixes, width, threshold)
        found.append(new)
        todo = cut_lineage(todo.join(new.select("id"), "id", "left_anti").join(followers, "id", "left_anti"))
    nodes = todo.select("tkey", "bucket").distinct().join(prefixes, "tkey")
    edges = cut_lineage(_similar_sets(nodes, nodes, threshold))
    alike = cut_lineage(_alike_groups(nodes.select("tkey").distinct(), edges))
    chains = chain_leaders(todo.join(alike, "tkey").select("id", "t", "key"), width)
    found.append(todo.join(chains, "id", "left_semi"))
    leaders = greedy_leaders(todo.join(alike, "tkey", "left_anti"), edges.join(alike, F.col("a") == F.col("tkey"), "left_anti"), width)
    for part in found:
        leaders = leaders.unionByName(part)
    leaders = cut_lineage(leaders)

    rest = titled.where("tkey <> ''").join(leaders.select("id"), "id", "left_anti")
    rest_sets = rest.select("tkey", "bucket").distinct().join(prefixes, "tkey")
    lead_sets = leaders.select("tkey", "bucket").distinct().join(prefixes, "tkey")
    pairs = _similar_sets(rest_sets, lead_sets, threshold).unionByName(
        rest.select(F.col("tkey").alias("a"), F.col("tkey").alias("b")).distinct())
    lead = leaders.select(F.col("id").alias("lid"), F.col("t").alias("lt"), F.col("tkey").alias("b"),
                          F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    near = pairs.join(lead, "b").select("a", "bucket", "lid", "lt")
    follows = (rest.join(near, (rest["tkey"] == near["a"]) & (rest["bucket"] == near["bucket"])
                         & (F.struct(rest["t"], rest["id"]) > F.struct("lt", "lid")) & (rest["t"] - F.col("lt") <= width))
               .groupBy("id").agg(F.max_by("lid", F.struct("lt", "lid")).alias("leader_id")))
    follows = cut_lineage(follows)
    confirms = follows.groupBy(F.col("leader_id").alias("id")).agg(F.count("*").alias("confirm"))
    out = items.join(follows, "id", "left").join(confirms, "id", "left")
    return out.withColumns({"novelty": F.when(F.col("leader_id").isNull(), 1.0).otherwise(0.25),
                            "confirm": F.coalesce(F.col("confirm"), F.lit(0)).cast("int")})


# ---------------------------------------------------------------- fuzzy titles

def _kept_titles(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``nodes`` (key, first) kept by the rule "keep a title unless an earlier kept one is similar"; ``pairs`` (a, b) are similar titles, each once.

    Each round keeps all titles without an undecided similar one before them and drops what these cover; only pairs of undecided titles go on.
    """
    ends = pairs.join(nodes.select(F.col("key").alias("a"), F.col("first").alias("fa")), "a").join(nodes.select(F.col("key").alias("b"), F.col("first").alias("fb")), "b")
    before = F.col("fa") < F.col("fb")
    open_, dropped, rounds = cut_lineage(ends.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("v"))), None, 0
    while not open_.isEmpty():
        rounds += 1
        lead = open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = cut_lineage(open_.join(lead, "u", "left_semi").select(F.col("v").alias("key")).distinct())
        dropped = out if dropped is None else dropped.unionByName(out)
        open_ = cut_lineage(open_.join(out.select(F.col("key").alias("u")), "u", "left_anti").join(out.select(F.col("key").alias("v")), "v", "left_anti"))
    _log.info("kept titles: %d rounds", rounds)
    return nodes if dropped is None else nodes.join(dropped, "key", "left_anti")


def fuzzy_title_dedupe(batch: DataFrame, recent: DataFrame | None = None, ordinal: str = "ordinal", threshold: float = 85.0) -> DataFrame:
    """Rows of ``batch`` (id, title, ordinal) kept by the rule "drop a title too close to a stored or earlier kept one".

    ``recent`` holds the stored titles to compare with (the newest ones, as the caller selects them). Rows fold to distinct titles first: of one title at
    most the first row is kept.
    """
    first = F.min(F.struct(F.col(ordinal).cast("long").alias("t"), "id")).alias("first")
    titles = batch.where(F.col("title").isNotNull()).groupBy("title").agg(first, F.lit(False).alias("stored"))
    if recent is not None:
        known = recent.where(F.col("title").isNotNull()).select("title", F.lit(True).alias("stored"))
        titles = titles.unionByName(known, allowMissingColumns=True).groupBy("title").agg(F.max("first").alias("first"), F.bool_or("stored").alias("stored"))
    titles = cut_lineage(titles.withColumn("key", F.monotonically_increasing_id()))
    pairs = cut_lineage(similar_titles(titles, threshold))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    taken = both.join(titles.where("stored").select(F.col("key").alias("b")), "b", "left_semi").select(F.col("a").alias("key"))
    fresh = titles.where("not stored").join(taken, "key", "left_anti").select("key", "first")
    return batch.join(_kept_titles(fresh, pairs).select("first.id"), "id", "left_semi")


# ---------------------------------------------------------------- links between articles

def _link_tags(articles: DataFrame, now: Column, window_hours: int, limit: int | None) -> DataFrame:
    a = articles.where(F.col("published_at") >= hours_before(now, window_hours))
    if limit:
        a = a.orderBy(F.desc("published_at"), "id").limit(limit)
    tags = F.when(F.size("ai_affected_tickers") > 0, F.col("ai_affected_tickers")).otherwise(F.col("tickers_raw"))
    tag = F.upper(F.trim("tag"))
    return (a.select("id", "published_at", F.explode(tags).alias("tag")).select("id", "published_at", tag.alias("ticker"))
            .where((F.col("ticker") != "") & (F.length("ticker") <= 6) & ~F.col("ticker").isin(K.LINK_STOPWORDS)).distinct())


def correlated_articles(articles: DataFrame, now: Column, window_hours: int = 72, limit: int | None = None, links: int = 20) -> DataFrame:
    """(id, ai_correlated_article_ids): the newest ``links`` other articles that share a ticker.

    An article's newest partners lie among the newest ``links + 1`` of each of its tickers, so a ticker that tags a
    third of all rows contributes that short list (kept by a map-side top-k), never its pairs.
    """
    tags = _link_tags(articles, now, window_hours, limit)
    w = Window.partitionBy("ticker").orderBy(F.desc("published_at"), "id")
    top = tags.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= links + 1)
    heads = top.groupBy("ticker").agg(F.collect_list(F.struct(F.col("published_at").alias("ts"), "id")).alias("heads")).where(F.size("heads") > 1)
    pairs = tags.join(heads, "ticker").select("id", F.explode("heads").alias("o")).where(F.col("id") != F.col("o.id"))
    newest = F.array_sort(F.collect_set("o"), lambda x, y: F.when(x["ts"] > y["ts"], -1).when(x["ts"] < y["ts"], 1)
                          .when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0))
    return pairs.groupBy("id").agg(F.transform(F.slice(newest, 1, links), lambda x: x["id"]).alias("ai_correlated_article_ids"))


def top_clusters(articles: DataFrame, now: Column, window_hours: int = 72, limit: int | None = None, k: int = 10) -> DataFrame:
    return (_link_tags(articles, now, window_hours, limit).groupBy("ticker").agg(F.count("*").alias("n"))
            .where("n >= 2").orderBy(F.desc("n"), "ticker").limit(k))


def related_articles(articles: DataFrame, links: DataFrame, article_id) -> DataFrame:
    """The articles linked from one article."""
    ids = links.where(F.col("id") == article_id).select(F.explode("ai_correlated_article_ids").alias("id"))
    return articles.join(ids, "id", "left_semi")

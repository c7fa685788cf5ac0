"""Row-level article scoring: rule classifier, lexicon and model scores, and the cells the readers see."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import text as X
from ..session import cut_lineage
from .articles import days_before, fetch_unprocessed, hours_before, unscored
from .keyed import patch
from .phrases import first_matches, with_contained, with_known

_NO_TAGS = "array<string>"


def _tags(c) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NO_TAGS))


def rule_classify(df: DataFrame, holdings=None, lexicon: dict[str, float] | None = None) -> DataFrame:
    """Sentiment label, relevance and confidence by rules over title + best text."""
    holdings = list(holdings or K.HOLDINGS)
    body = X.text_or_empty(X.best_text(F.col("full_text"), F.col("summary_raw"))) if "full_text" in df.columns else X.text_or_empty(F.col("summary_raw"))
    d = df.withColumn("__t", F.concat_ws(" ", X.text_or_empty(F.col("title")), body))
    d = d.withColumns({"__v": X.valence(F.col("__t"), lexicon), "__num": X.numeric_impact(F.col("__t")), "__tags": _tags("tickers_raw")}).drop("__t")
    raw = F.col("__v.compound") + F.col("__num") * 0.2
    tagged = F.size("__tags") > 0
    d = d.withColumn("compound", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(tagged & (F.abs(raw) > 0.3), raw * 1.2).otherwise(raw))))
    c, cat = F.col("compound"), F.coalesce("category", F.lit(""))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    base = F.lit(30) + points(tagged, 20) + points(F.arrays_overlap("__tags", F.array(*map(F.lit, holdings))), 25)
    rel = F.when(cat == "sec-filing", 85).otherwise(base + points(cat.isin("macro", "energy"), 10))
    rel = rel + points(F.col("__num") != 0, 15) + points(F.lower("title").rlike("update|alert"), 10)
    label = (F.when(c >= 0.25, "bullish").when(c <= -0.25, "bearish")
             .when((F.col("__v.pos") > 0.1) & (F.col("__v.neg") > 0.1), "mixed").otherwise("neutral"))
    return d.withColumns({
        "ai_processed": F.lit(True), "ai_sentiment": label,
        "ai_relevance_score": F.greatest(F.lit(0), F.least(F.lit(100), rel)),
        "ai_confidence": F.when(cat == "sec-filing", 70).otherwise(40)}).drop("__v", "__num", "__tags")


def bulk_classify(articles: DataFrame, now: Column, limit: int | None = None, **kw) -> DataFrame:
    """Classify the unprocessed rows (all, or the newest ``limit``) and write the result back by id."""
    todo = articles.where(~F.col("ai_processed")) if limit is None else articles.join(fetch_unprocessed(articles, limit).select("id"), "id", "left_semi")
    edits = rule_classify(todo, **kw).select("id", "ai_processed", "ai_sentiment", "ai_relevance_score", "ai_confidence", now.alias("ai_processed_at"))
    return patch(articles, edits, ["id"])


def standardise_by_source(df: DataFrame, cols: dict[str, str], min_n: int = 8, source: str = "source") -> DataFrame:
    """Add out = (x - mean) / (2.5 sd) clamped to [-1, 1] for each {x: out}, by source when it has ``min_n`` values of x,
    else over all rows. Nulls stay null and a zero deviation counts as 0.25.

    One aggregation serves all columns: one row per source, whose moments combine into the overall ones, so the rows
    themselves are read once for statistics and once for the result.
    """
    sd = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.25))
    names = list(cols)
    per = df.groupBy(F.col(source).alias("__src")).agg(*[e for k, x in enumerate(names) for e in (
        F.count(x).alias(f"__n{k}"), F.avg(x).alias(f"__mu{k}"), F.stddev_pop(x).alias(f"__sd{k}"))])
    w = Window.partitionBy(F.lit(0))  # over one row per source
    for k in range(len(names)):
        n, mu, dev = F.col(f"__n{k}"), F.col(f"__mu{k}"), F.col(f"__sd{k}")
        total = F.sum(n).over(w)
        mean = F.sum(n * mu).over(w) / total
        spread = F.sqrt(F.greatest(F.sum(n * (dev * dev + mu * mu)).over(w) / total - mean * mean, F.lit(0.0)))
        own = n >= min_n
        per = per.withColumns({f"__m{k}": F.when(own, mu).otherwise(mean), f"__d{k}": F.when(own, sd(dev)).otherwise(sd(spread))})
    j = df.join(per.select("__src", *[f"__{c}{k}" for k in range(len(names)) for c in "md"]), F.col(source).eqNullSafe(F.col("__src")))
    z = lambda k, x: F.when(F.col(x).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(x) - F.col(f"__m{k}")) / (F.col(f"__d{k}") * 2.5))))
    return j.select(*df.columns, *[z(k, x).alias(cols[x]) for k, x in enumerate(names)])


def link_symbols(df: DataFrame, names: dict[str, str] | DataFrame | None = None, patterns: dict[str, str] | None = None,
                 universe: list[str] | DataFrame | None = None, summary: str = "summary_raw") -> DataFrame:
    """Add ``syms``: map symbol -> relevance.

    Short lists of names (name -> symbol) and symbols go into the plan. Tables (symbol, name), as :func:`company_dictionary` gives them, and (symbol) of
    any size are joined through an index; pass both as tables or leave one out.
    """
    if isinstance(names, DataFrame) or isinstance(universe, DataFrame):
        return _link_from_tables(df, names, patterns, universe, summary)
    cand = X.symbol_candidates(F.col("title"), F.col(summary), F.col("tickers_raw"), names, patterns, universe)
    return df.withColumn("__cand", cand).withColumn("syms", X.best_links(F.col("__cand"))).drop("__cand")


def _link_from_tables(df: DataFrame, names: DataFrame | None, patterns: dict[str, str] | None, universe: DataFrame | None, summary: str) -> DataFrame:
    patterns = K.SYMBOL_PATTERNS if patterns is None else patterns
    title, rest = X.text_or_empty(F.col("title")), X.text_or_empty(F.col(summary))
    d, parts = df, [X.symbol_candidates(F.col("title"), F.col(summary), F.col("tickers_raw"), None, patterns, None)]
    none = F.array().cast("array<string>")

    def links(words: Column, rel: float, symbol=lambda w: w) -> Column:
        return F.transform(words, lambda w: F.struct(symbol(w).alias("symbol"), F.lit(rel).alias("rel")))

    if names is not None:
        d = with_contained(d, F.concat_ws("\n", title, rest), names.select(F.col("name").alias("phrase"), F.col("symbol").alias("value")), "__names")
        symbol_of = F.map_from_arrays(F.col("__names.phrase"), F.col("__names.value"))
        parts += [links(first_matches(c, F.col("__names")), rel, lambda w: F.element_at(symbol_of, w)) for c, rel in ((title, 1.0), (rest, 0.5))]
        universe = names.select("symbol") if universe is None else universe.select("symbol").unionByName(names.select("symbol"))
    cash = F.regexp_extract_all(F.concat_ws(" ", title, rest), F.lit(K.CASHTAG_LOOSE), F.lit(1))
    tagged = F.coalesce("tickers_raw", none)
    d = with_known(d, F.concat(cash, tagged), universe, "__known")
    parts += [links(F.array_intersect(c, "__known"), rel) for c, rel in ((cash, 0.9), (tagged, 0.8))]
    return d.withColumn("__cand", F.concat(*parts)).withColumn("syms", X.best_links(F.col("__cand"))).drop("__cand", "__names", "__known")


def company_dictionary(universe: DataFrame) -> DataFrame:
    """Cleaned company names fit for exact-case matching, as (symbol, name)."""
    name = F.col("name")
    for _ in range(3):
        name = F.trim(F.regexp_replace(name, X.ANY_CASE + K.CORPORATE_SUFFIX, ""))
    d = universe.where(~F.col("symbol").isin(list(K.SYMBOL_PATTERNS))).select("symbol", name.alias("name"))
    return d.where(~F.col("name").isin(K.AMBIGUOUS_NAMES) & (F.length("name") >= 4) & (F.col("name").contains(" ") | (F.length("name") >= 5)))


def score_articles(articles: DataFrame, model_scores: DataFrame | None = None, names: dict[str, str] | None = None,
                   universe: list[str] | None = None, patterns: dict[str, str] | None = None, model: str = "finbert",
                   summary_chars: int | None = None, valence_lexicon: dict[str, float] | None = None,
                   positive=None, negative=None, negators=None) -> DataFrame:
    """Articles to scored items: lex, finbert, old and ens scores, event, source weight, symbols and title words.

    The texts are read once: what is kept of them (a few numbers, tags and the title) is written to the checkpoint
    folder before the per-source statistics, which need it twice.
    """
    summary = X.text_or_empty(F.col("summary_raw"))
    if summary_chars:
        summary = F.substring(summary, 1, summary_chars)
    a = articles.withColumn("__sum", summary).withColumn("__text", F.concat(X.text_or_empty(F.col("title")), F.lit(". "), F.col("__sum")))
    raw_lex = X.with_value(X.tokenize(F.col("__text")), lambda t: 0.6 * X.lexicon_score_of(t, positive, negative, negators)
                           + 0.4 * X.valence_of(t, valence_lexicon)["compound"])
    old = reduce(lambda acc, kv: acc.when(F.col("ai_sentiment") == kv[0], kv[1]), list(K.LABEL_SCORE.items())[1:],
                 F.when(F.col("ai_sentiment") == "bullish", 1.0))
    a = a.withColumns({"raw_lex": raw_lex, "__ev": X.event_of(F.col("__text")), "old": old,
                       "src_w": X.source_weight(F.col("source")), "ntitle": X.title_tokens(F.col("title"))})
    a = link_symbols(a, names, patterns, universe, summary="__sum").drop("__text", "__sum")
    if model_scores is not None:
        s = model_scores.where(F.col("model") == model).select(F.col("article_id").alias("id"), F.col("score").alias("raw_fb"))
        a = a.join(s, "id", "left")
    else:
        a = a.withColumn("raw_fb", F.lit(None).cast("double"))
    items = a.select("id", F.col("published_at").alias("ts"), "source", "title", "raw_lex", "raw_fb", "old", "__ev.event", "__ev.event_w",
                     "src_w", "syms", "ntitle")
    items = standardise_by_source(cut_lineage(items), {"raw_lex": "lex", "raw_fb": "finbert"})
    both = F.array_compact(F.array("lex", "finbert"))
    return items.withColumn("ens", F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both)))


def scoring_queue(articles: DataFrame, scores: DataFrame, now: Column, days: int = 30, model: str = "finbert") -> DataFrame:
    """Recent non-Greek rows the model has not scored yet."""
    fresh = articles.where((F.col("published_at") > days_before(now, days)) & ~F.col("title").rlike(K.GREEK))
    return unscored(fresh, scores, model)


def score_with_model(articles: DataFrame, scores: DataFrame, now: Column, scorer: Callable[[list[str]], list[tuple[float, float]]],
                     model: str = "finbert", days: int = 30, batch: int = 256, summary_chars: int | None = None) -> DataFrame:
    """Run an injected scorer, texts -> (p_pos, p_neg), over the queue in Arrow batches ordered by text length."""
    summary = X.text_or_empty(F.col("summary_raw"))
    if summary_chars:
        summary = F.substring(summary, 1, summary_chars)
    q = scoring_queue(articles, scores, now, days, model).select(
        F.col("id").alias("article_id"), F.concat(F.trim("title"), F.lit(". "), F.trim(summary)).alias("text"))
    id_type = q.schema["article_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.assign(_n=pdf["text"].str.len()).sort_values("_n", kind="stable")
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                p = scorer(part["text"].tolist())
                yield pd.DataFrame({"article_id": part["article_id"].to_numpy(), "score": [x - y for x, y in p],
                                    "p_pos": [x for x, _ in p], "p_neg": [y for _, y in p]})

    out = q.mapInPandas(run, f"article_id {id_type}, score double, p_pos double, p_neg double")
    return out.select("article_id", F.lit(model).alias("model"), "score", "p_pos", "p_neg", now.alias("scored_at"))


def scoring_backlog(articles: DataFrame, scores: DataFrame, now: Column, days: int = 30, model: str = "finbert") -> DataFrame:
    """One row: rows still unscored, and scored/total over the last 24 h."""
    s = scores.where(F.col("model") == model).select(F.col("article_id").alias("id"), F.lit(True).alias("__has"))
    has = F.col("__has").isNotNull()
    day = F.col("published_at") > hours_before(now, 24)
    return (articles.where(F.col("published_at") > days_before(now, days)).select("id", "published_at", "title").join(s, "id", "left")
            .agg(F.count_if(~has & ~F.col("title").rlike(K.GREEK)).alias("remaining"), F.count_if(has & day).alias("scored_24h"), F.count_if(day).alias("n_24h")))


def populate_cells(items: DataFrame, holdings=None, macro=None) -> DataFrame:
    """Reader-facing cells from scored, clustered items (needs ``novelty``)."""
    holdings, macro = list(holdings or K.HOLDINGS), list(macro or K.MACRO)
    entries = F.map_entries("syms")
    d = items.withColumns({
        "__named": F.transform(F.filter(entries, lambda e: e["value"] >= 0.9), lambda e: e["key"]),
        "__tagged": F.size(F.filter(entries, lambda e: (e["value"] >= 0.7) & (e["value"] < 0.9))),
        "__greek": F.col("title").rlike(K.GREEK), "__basis": F.coalesce("raw_fb", "raw_lex")})
    named, basis = F.col("__named"), F.col("__basis")
    overlap = lambda xs: F.arrays_overlap(named, F.array(*map(F.lit, xs)))
    holding = overlap(holdings)
    rel = F.when(holding, 45).when(F.size(named) > 0, 25).when(F.col("__tagged") > 0, 10).when(F.size("syms") > 0, 6).otherwise(0)
    (e0, p0), *rest = K.EVENT_POINTS.items()
    rel = rel + reduce(lambda acc, kv: acc.when(F.col("event") == kv[0], kv[1]), rest, F.when(F.col("event") == e0, p0)).otherwise(0)
    w = F.col("src_w")
    rel = rel + F.when(w >= 1.2, 8).when(w >= 1.0, 4).when(w <= 0.7, -4).otherwise(0) + F.bround(F.abs(basis) * 15, 0).cast("int")
    rel = rel + F.when(F.col("novelty") < 1, -25).otherwise(0) + F.when(overlap(macro) & ~holding, 8).otherwise(0)
    rel = F.when(F.col("__greek"), F.least(rel, F.lit(30))).otherwise(rel)
    label = F.when(F.col("__greek"), "neutral").when(basis > 0.25, "bullish").when(basis < -0.25, "bearish").otherwise("neutral")
    ranked = F.array_sort(F.transform(F.filter(entries, lambda e: ~e["key"].isin(macro)),
                                      lambda e: F.struct((-e["value"]).alias("r"), e["key"].alias("s"))))
    return d.select(
        "id", label.alias("ai_sentiment"), F.greatest(F.lit(0), F.least(F.lit(100), rel)).alias("ai_relevance_score"),
        F.transform(F.slice(ranked, 1, 5), lambda x: x["s"]).alias("ai_affected_tickers"),
        F.least(F.lit(100.0), F.abs(basis) * 100).cast("int").alias("ai_confidence"), F.round("raw_fb", 4).alias("fb_score"), "event",
        F.when(F.col("__greek"), "el").otherwise("en").alias("lang"))


_CELLS = ("ai_sentiment", "ai_relevance_score", "ai_affected_tickers", "ai_confidence", "fb_score", "event", "lang")


def cells_delta(current: DataFrame, new: DataFrame) -> DataFrame:
    """New cells that differ from the stored ones. Analysed rows change only fb_score, event and lang."""
    n = new.select("id", *[F.col(c).alias(f"__n_{c}") for c in _CELLS])
    j = current.select("id", F.col("ai_summary").isNotNull().alias("analysed"), *_CELLS).join(n, "id")
    sortable = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast(_NO_TAGS)))
    side = lambda p, cols: F.struct(*[(sortable(p + c) if c == "ai_affected_tickers" else F.col(p + c)).alias(c) for c in cols])
    late = ("fb_score", "event", "lang")
    changed = F.when(F.col("analysed"), ~side("", late).eqNullSafe(side("__n_", late))).otherwise(~side("", _CELLS).eqNullSafe(side("__n_", _CELLS)))
    keep = lambda c: F.when(F.col("analysed") & F.lit(c not in late), F.col(c)).otherwise(F.col("__n_" + c)).alias(c)
    return j.where(changed).select("id", "analysed", *[keep(c) for c in _CELLS])


def populate_summary(cells: DataFrame) -> DataFrame:
    """Label mix and how many rows are highly relevant, per label."""
    return cells.groupBy("ai_sentiment").agg(F.count("*").alias("n"), F.count_if(F.col("ai_relevance_score") >= 60).alias("n_high"))

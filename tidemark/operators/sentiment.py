"""Time-decayed sentiment indices, attention, z-scores, alerts and their read-side views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as K
from ..session import cut_lineage
from .keyed import latest_per_key

_HOUR = 3_600_000_000


def hour_index(ts: Column) -> Column:
    """Whole hours since the epoch; exact for on-the-hour grid points."""
    return F.floor(F.unix_micros(ts) / F.lit(_HOUR))


def _ceil_hour(ts: Column) -> Column:
    return F.ceil(F.unix_micros(ts) / F.lit(_HOUR))


def _on_the_hour(ts: Column) -> Column:
    return F.unix_micros(ts) % F.lit(_HOUR) == 0


def hour_ts(h: Column) -> Column:
    return F.timestamp_seconds(h * 3600)


def by_symbol(items: DataFrame) -> DataFrame:
    """One row per (item, symbol) with its relevance ``rel``.

    Items without symbols are dropped behind the outer explode: a plain one would filter on the map's size first, and that filter, pushed down to the
    texts, repeats all work that made the map for each of its keys.
    """
    return items.select(*[c for c in items.columns if c != "syms"], F.explode_outer("syms").alias("symbol", "rel")).where("symbol is not null")


def _weight() -> Column:
    return (F.col("src_w") * F.col("event_w") * F.col("rel") * F.col("novelty")
            * (1.0 + F.least(F.col("confirm"), F.lit(4)) * 0.1))


def sentiment_index(items: DataFrame, start: Column, end: Column, models=("lex", "finbert", "ens", "old"), half_life_h: float = 12.0,
                    window_h: int = 48, lead_h: int = 24) -> DataFrame:
    """Hourly snapshots (ts, symbol, model, idx, n_lead, wsum) for grid points in [start, end].

    ``items`` is long by symbol: ts, symbol, rel, src_w, event_w, novelty, confirm and one column per model.

    Exponential decay factors: an item's weight at t is its weight at its own next full hour times 0.5^(hours/half life).
    So items first fold into one row per (symbol, hour), with map-side combining, and only those few rows are spread
    over the hours they reach. An item exactly on the hour still counts at age ``window_h``, later ones do not, so both
    sums are kept.
    """
    ts = F.col("ts")
    h = _ceil_hour(ts)
    to_hour = F.pow(F.lit(0.5), (h - F.unix_micros(ts) / F.lit(_HOUR)) / half_life_h)
    exact = _on_the_hour(ts)
    w = _weight() * to_hour
    aggs = []
    for m in models:
        has, lead = F.col(m).isNotNull(), F.col(m).isNotNull() & (F.col("novelty") == 1.0)
        aggs += [F.struct(
            F.sum(F.when(has, w * F.col(m))).alias("num"), F.sum(F.when(has, w)).alias("den"), F.count_if(lead).alias("lead"),
            F.sum(F.when(has & exact, w * F.col(m))).alias("num_x"), F.sum(F.when(has & exact, w)).alias("den_x"),
            F.count_if(lead & exact).alias("lead_x")).alias(m)]
    lo, hi = hour_index(start - F.expr("INTERVAL 1 MICROSECOND")) + 1, hour_index(end)
    live = items.where((F.unix_micros(ts) >= (lo - window_h) * _HOUR) & (ts <= end))
    hourly = live.groupBy("symbol", h.alias("h")).agg(*aggs)
    per_model = hourly.select("symbol", "h", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in models])).alias("x"))
    spread = per_model.where(F.col("x.s.den").isNotNull()).select("symbol", "x.model", "h", "x.s", F.explode(F.sequence(F.greatest(F.col("h"), lo), F.least(F.col("h") + window_h, hi))).alias("t")).where(
        (F.col("h") + window_h >= lo) & (F.col("h") <= hi) & (F.col("t") >= F.col("h")) & (F.col("t") <= F.col("h") + window_h))
    age = F.col("t") - F.col("h")
    decay = F.pow(F.lit(0.5), age / half_life_h)
    edge = lambda at, whole, part: F.when(age < at, F.col(whole)).when(age == at, F.col(part))
    out = spread.groupBy("symbol", "model", "t").agg(
        F.sum(edge(window_h, "s.num", "s.num_x") * decay).alias("num"), F.sum(edge(window_h, "s.den", "s.den_x") * decay).alias("wsum"),
        F.coalesce(F.sum(edge(lead_h, "s.lead", "s.lead_x")), F.lit(0)).alias("n_lead"))
    return out.where(F.col("wsum") > 0).select(hour_ts(F.col("t")).alias("ts"), "symbol", "model", (F.col("num") / F.col("wsum")).alias("idx"),
                                               F.col("n_lead").cast("int").alias("n_lead"), "wsum")


def sentiment_index_at(items: DataFrame, now: Column, models=("lex", "finbert", "ens", "old"), half_life_h: float = 12.0,
                       window_h: int = 48, lead_h: int = 24) -> DataFrame:
    """The same index at one arbitrary moment."""
    age = (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(_HOUR)
    live = items.where((F.unix_micros("ts") >= F.unix_micros(now) - window_h * _HOUR) & (F.col("ts") <= now))
    live = live.withColumns({"__w": _weight() * F.pow(F.lit(0.5), age / half_life_h), "__lead": (F.col("novelty") == 1.0) & (age <= lead_h)})
    long = live.select("symbol", "__w", "__lead", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("x"))
    out = long.where(F.col("x.score").isNotNull()).groupBy("symbol", "x.model").agg(
        F.sum(F.col("__w") * F.col("x.score")).alias("num"), F.sum("__w").alias("wsum"), F.count_if("__lead").cast("int").alias("n_lead"))
    return out.where("wsum > 0").select(now.alias("ts"), "symbol", "model", (F.col("num") / F.col("wsum")).alias("idx"), "n_lead", "wsum")


def attention(items: DataFrame, grid: DataFrame, recent_h: int = 6, base_days: int = 14) -> DataFrame:
    """Story volume against its own base rate at each (symbol, ts) of ``grid``: att_n and att_z.

    Leaders fold into hourly counts first. A count enters and leaves the two windows at known hours, so both are running sums of these steps, in one
    pass over at most a few rows per symbol and hour and without a moving frame. Leaders on the full hour (``x``) stay an hour longer: windows are closed.
    """
    lead = items.where(F.col("novelty") == 1.0)
    counts = lead.groupBy("symbol", _ceil_hour(F.col("ts")).alias("h")).agg(
        F.count("*").alias("c"), F.count_if(_on_the_hour(F.col("ts"))).alias("x"))
    base_h = base_days * 24
    step = lambda after, n, prior: F.struct((F.col("h") + after).alias("h"), n.alias("n"), prior.alias("prior"))
    c, x, none = F.col("c"), F.col("x"), F.lit(0).cast("long")
    steps = F.array(step(0, c, none), step(recent_h, x - c, c - x), step(recent_h + 1, -x, x), step(base_h, none, x - c), step(base_h + 1, none, -x))
    points = grid.select("symbol", hour_index(F.col("ts")).alias("h"), none.alias("n"), none.alias("prior"), F.lit(1).alias("point")).distinct()
    rows = (counts.select("symbol", F.explode(steps).alias("s")).select("symbol", "s.h", "s.n", "s.prior", F.lit(0).alias("point")).unionByName(points)
            .groupBy("symbol", "h").agg(F.sum("n").alias("n"), F.sum("prior").alias("prior"), F.max("point").alias("point")))
    running = Window.partitionBy("symbol").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    n, prior = F.sum("n").over(running), F.sum("prior").over(running)
    lam = F.col("prior") / float(base_h - recent_h) * float(recent_h)
    return (rows.select("symbol", "h", "point", n.alias("att_n"), prior.alias("prior")).where("point = 1")
            .select(hour_ts(F.col("h")).alias("ts"), "symbol", F.col("att_n").cast("int").alias("att_n"),
                    ((F.col("att_n") - lam) / F.sqrt(lam + 1.0)).alias("att_z")))


def rolling_zscore(snaps: DataFrame, days: int = 14, min_n: int = 20, min_sd: float = 1e-6) -> DataFrame:
    """z of idx against the same symbol's and model's values in [t - days, t).

    A value enters the window right after its time and leaves it right after the window's length, so count, sum and sum of squares are running sums of
    these steps: one pass, no moving frame. Sums are decimals, so what leaves is exactly what came in and nothing drifts over a long series (values up to
    a billion; an index lies between -1 and 1).
    """
    keys, exact = ["symbol", "model"], "decimal(38,18)"
    t, x = F.unix_micros("ts"), F.col("idx")
    step = lambda at, sign: F.struct(at.alias("__t"), F.lit(1).alias("__step"), F.lit(sign).alias("__k"), (x * sign).cast(exact).alias("__x"),
                                     (x * x * sign).cast(exact).alias("__xx"))
    moves = snaps.where(x.isNotNull() & ~F.isnan(x)).select(*keys, F.explode(F.array(step(t, 1), step(t + days * 24 * _HOUR, -1))).alias("m")).select(*keys, "m.*")
    moves = moves.groupBy(*keys, "__t", "__step").agg(*[F.sum(c).alias(c) for c in ("__k", "__x", "__xx")])
    rows = snaps.withColumns({"__t": t, "__step": F.lit(0)}).unionByName(moves, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__step").rowsBetween(Window.unboundedPreceding, 0)  # a row comes before the steps of its own time
    s = rows.withColumns({"__n": F.sum("__k").over(w), "__s": F.sum("__x").over(w).cast("double"), "__ss": F.sum("__xx").over(w).cast("double")}).where("__step = 0")
    mean = F.col("__s") / F.col("__n")
    sd = F.sqrt(F.greatest(F.col("__ss") / F.col("__n") - mean * mean, F.lit(0.0)))
    z = F.when((F.col("__n") >= min_n) & (sd > min_sd), (x - mean) / sd)
    return s.withColumn("z", z).select(*snaps.columns, *([] if "z" in snaps.columns else ["z"]))


def backfill_index(items: DataFrame, start: Column, end: Column, models=("lex", "finbert", "ens", "old")) -> DataFrame:
    """Complete hourly snapshots over a period: index, z-score and attention.

    The index is written once (a row per symbol, model and hour) because both the z-scores and the grid of the
    attention counts read it.
    """
    snaps = cut_lineage(sentiment_index(items, start, end, models))
    att = attention(items.where(F.col("ts") <= end), snaps.select("symbol", "ts").distinct())
    return rolling_zscore(snaps).join(att, ["symbol", "ts"], "left").select("ts", "symbol", "model", "idx", "z", "n_lead", "wsum", "att_n", "att_z")


def zscore_alerts(snaps: DataFrame, z: float = 2.0, min_stories: int = 4, cooldown_h: int = 6, allowed=None, model: str = "ens") -> DataFrame:
    """Snapshots that fire: an allowed symbol with a large z and enough stories, not within the cooldown of its last alert.

    Suppression depends on the last *fired* alert, so each symbol's triggers are folded in time order. A symbol has at
    most one trigger per grid hour, which bounds the array whatever the number of articles.
    """
    allowed = K.ALERT_SYMBOLS if allowed is None else allowed
    hot = snaps.where((F.col("model") == model) & (F.abs("z") >= z) & (F.col("n_lead") >= min_stories))
    if allowed:
        hot = hot.where(F.col("symbol").isin(list(allowed)))
    cool = cooldown_h * _HOUR
    trig = hot.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), "z", "idx", "n_lead"))).alias("ts"))
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.slice("ts", 1, 0).alias("fired"))
    fold = F.aggregate("ts", empty, lambda a, x: F.when(
        a["last"].isNull() | (x["t"] - a["last"] >= cool),
        F.struct(x["t"].alias("last"), F.concat(a["fired"], F.array(x)).alias("fired"))).otherwise(a), lambda a: a["fired"])
    return trig.select("symbol", F.explode(fold).alias("f")).select(
        F.timestamp_micros("f.t").alias("ts"), "symbol", F.lit("sentiment").alias("kind"), F.col("f.z").alias("z"), F.col("f.idx").alias("idx"),
        F.col("f.n_lead").alias("n_lead"))


def alert_evidence(items: DataFrame, now: Column, k: int = 2) -> DataFrame:
    """Per symbol, the ``k`` strongest leader stories of the last 24 h."""
    strength = F.abs("ens") * F.col("event_w")
    live = items.where((F.col("novelty") == 1.0) & F.col("ens").isNotNull() & (F.col("ts") <= now)
                       & (F.unix_micros(now) - F.unix_micros("ts") < 24 * _HOUR)).withColumn("strength", strength)
    w = Window.partitionBy("symbol").orderBy(F.desc("strength"), "id")
    return live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_ts(snaps: DataFrame, model: str = "ens") -> Column:
    """The newest snapshot time as a scalar subquery."""
    return snaps.where(F.col("model") == model).agg(F.max("ts")).scalar()


def top_signals(snaps: DataFrame, min_stories: int = 4, k: int = 12, model: str = "ens") -> DataFrame:
    last = snaps.where((F.col("model") == model) & (F.col("ts") == latest_ts(snaps, model)) & (F.col("n_lead") >= min_stories))
    return last.orderBy(F.desc(F.abs(F.coalesce("z", F.lit(0.0)))), "symbol").limit(k)


def signal_leaderboard(sig: DataFrame, filter: str = "all", sort: str = "ens_z", desc: bool = True, query: str = "", holdings=None, macro=None) -> DataFrame:
    """The ordered signal table of the dashboard with its rank."""
    holdings, macro = list(holdings or K.HOLDINGS), list(macro or K.MACRO)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    keep = {"all": F.lit(True), "holdings": F.col("symbol").isin(holdings), "macro": F.col("symbol").isin(macro),
            "movers": (F.abs(zero("ens_z")) >= 1.5) & (zero("stories_24h") >= 4), "positive": zero("ens") > 0.15, "negative": zero("ens") < -0.15}[filter]
    text = query.strip().lower()
    if text:
        keep = keep & reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text)) for c in ("symbol", "name", "sector")])
    if sort == "symbol":
        val = F.col("symbol")
    elif sort == "ens_z":
        val = F.when(zero("stories_24h") >= 3, F.abs(zero("ens_z"))).otherwise(-1.0)
    elif sort == "d1":
        val = F.coalesce(F.col("perf.d1"), F.lit(-999.0))
    else:
        val = F.coalesce(F.col(sort).cast("double"), F.lit(-999.0))
    return sig.where(keep).withColumn("sort_value", val).orderBy(F.desc("sort_value") if desc else F.asc("sort_value"), "symbol")


def holdings_then_movers(sig: DataFrame, k: int = 5, holdings=None) -> DataFrame:
    """Holdings in their fixed order, then the ``k`` strongest movers with at least four stories."""
    holdings = list(holdings or K.HOLDINGS)
    held = sig.where(F.col("symbol").isin(holdings)).withColumns({"part": F.lit(0), "key": F.array_position(F.array(*map(F.lit, holdings)), F.col("symbol")).cast("double")})
    movers = sig.where(~F.col("symbol").isin(holdings) & (F.coalesce("stories_24h", F.lit(0)) >= 4) & F.col("ens_z").isNotNull())
    movers = movers.withColumns({"part": F.lit(1), "key": -F.abs("ens_z")}).orderBy("key", "symbol").limit(k)
    return held.unionByName(movers).orderBy("part", "key", "symbol")


def downsample_series(snaps: DataFrame, since: Column, model: str = "ens", every: int = 6, last: int = 60) -> DataFrame:
    """Per symbol every 6th index value since a moment, the last 60 of them, as an array of (ts, idx)."""
    w = Window.partitionBy("symbol").orderBy("ts")
    s = snaps.where((F.col("model") == model) & (F.col("ts") >= since) & F.col("idx").isNotNull())
    s = s.withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") % every == 0)
    arr = F.array_sort(F.collect_list(F.struct("ts", F.round("idx", 3).alias("idx"))))
    return s.groupBy("symbol").agg(arr.alias("series")).withColumn(
        "series", F.slice("series", F.greatest(F.size("series") - last + 1, F.lit(1)), last))


def ticker_series(snaps: DataFrame, symbol: str, since: Column) -> DataFrame:
    """Per model the series of one symbol."""
    s = snaps.where((F.col("symbol") == symbol) & (F.col("ts") >= since) & F.col("idx").isNotNull())
    return s.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("ts", "idx"))).alias("series"))


def price_change(bars: DataFrame, offsets=(1, 5), min_bars: int = 7, symbols=None) -> DataFrame:
    """Per symbol the last close and its percent change over earlier own bars; short histories are skipped."""
    b = bars.where(F.col("close").isNotNull())
    if symbols:
        b = b.where(F.col("symbol").isin(list(symbols)))
    w = Window.partitionBy("symbol").orderBy("date")
    cols = {f"d{n}": (F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1) * 100 for n in offsets}
    b = b.withColumns({**cols, "bars": F.count("*").over(w)})
    out = latest_per_key(b.select("symbol", "date", F.col("close").alias("last"), *cols, "bars"), ["symbol"], ["date"])
    return out.where(F.col("bars") >= min_bars).withColumnRenamed("date", "asof").drop("bars")


def market_snapshot(bars: DataFrame, symbols=None, min_bars: int = 6) -> DataFrame:
    """Last close and 1, 5 and 20 bar changes at two decimals."""
    p = price_change(bars, (1, 5, 20), min_bars, symbols)
    return p.select("symbol", F.round("last", 2).alias("last"), *[F.round(f"d{n}", 2).alias(f"pct_{n}") for n in (1, 5, 20)], "asof")


def sparkline(bars: DataFrame) -> DataFrame:
    """Per symbol closes oldest first, and the change of the last against the one before."""
    b = bars.where(F.col("close").isNotNull())
    arr = b.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("spark"))
    last, prev = F.element_at("spark", -1), F.try_element_at("spark", F.lit(-2))
    return arr.select("symbol", "spark", last.alias("price"), (last - prev).alias("change"), (F.try_divide(last - prev, prev) * 100).alias("change_percent"))


def ticker_signals(snaps: DataFrame, bars: DataFrame, universe: DataFrame, since: Column) -> DataFrame:
    """One row per symbol of the newest snapshot: model values, z, stories, attention, series and performance."""
    from .articles import symbol_enrich
    cur = snaps.where(F.col("ts") == latest_ts(snaps))
    pick = lambda m, c, t="double": F.max(F.when(F.col("model") == m, F.col(c))).cast(t)
    wide = cur.groupBy("symbol", F.col("ts").alias("updated_at")).agg(
        pick("ens", "idx").alias("ens"), pick("ens", "z").alias("ens_z"), pick("ens", "n_lead", "int").alias("stories_24h"),
        pick("ens", "att_z").alias("attention_z"), pick("finbert", "idx").alias("finbert"), pick("lex", "idx").alias("lex"), pick("old", "idx").alias("old"))
    wide = wide.where(F.col("stories_24h") > 0)
    perf = price_change(bars, (1, 5), 7).select("symbol", F.struct("last", "d1", "d5").alias("perf"))
    return symbol_enrich(wide.join(downsample_series(snaps, since), "symbol", "left").join(perf, "symbol", "left"), universe)

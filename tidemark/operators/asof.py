"""Prices at a date and fixed-horizon call scoring.

As-of lookups are equi-joins: each close is valid on every day until the symbol's next bar, so bars unfold into one row
per (symbol, day). That table is bounded by symbols times calendar days, while calls may be any number and may all
name one symbol; an equi-join lets adaptive execution split such a key, a per-symbol window over calls would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import stats as S
from ..functions import text as X
from .keyed import latest_per_key, patch


def close_by_day(bars: DataFrame, tail_days: Column | int = 6) -> DataFrame:
    """(symbol, day, bar_date, close): the last close on or before each day, up to ``tail_days`` past the final bar."""
    b = bars.where(F.col("close").isNotNull()).select("symbol", "date", "close")
    nxt = F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))
    tail = F.date_add("date", tail_days if isinstance(tail_days, Column) else F.lit(tail_days))
    return (b.withColumn("__to", F.coalesce(F.date_sub(nxt, 1), tail))
            .select("symbol", F.explode(F.sequence("date", "__to", F.expr("INTERVAL 1 DAY"))).alias("day"), F.col("date").alias("bar_date"), "close"))


def asof_close(points: DataFrame, bars: DataFrame, day: str = "day", lookback_days: int = 6, out: str = "close") -> DataFrame:
    """Add the last close on or before ``day``, at most ``lookback_days`` old (null when there is none)."""
    grid = close_by_day(bars, lookback_days).where(F.datediff("day", "bar_date") <= lookback_days).select(
        "symbol", F.col("day").alias(day), F.col("close").alias(out), F.col("bar_date").alias(f"{out}_date"))
    return points.join(grid, ["symbol", day], "left")


def window_return(calls: DataFrame, bars: DataFrame, now: Column, lookback_days: int = 6, default_horizon: int = 5) -> DataFrame:
    """Add entry_px, exit_px, return_pct and exit_date over each call's own horizon; null while open or without prices.

    Entry is the last close before the call could act, exit the last close on or before entry day + horizon.
    """
    h = F.coalesce(F.nullif(F.col("horizon_days"), F.lit(0)), F.lit(default_horizon)).cast("int")
    c = calls.withColumns({"entry_day": S.entry_day(F.col("symbol"), F.col("created_at")), "__h": h})
    c = c.withColumn("end_day", F.date_add("entry_day", F.col("__h")))
    longest = calls.agg(F.max(h)).scalar()
    days = close_by_day(bars, F.coalesce(longest, F.lit(default_horizon)) + lookback_days)
    entry = days.select("symbol", F.col("day").alias("entry_day"), F.col("close").alias("__p0"), F.col("bar_date").alias("__d0"))
    exit_ = days.select("symbol", F.col("day").alias("end_day"), F.col("close").alias("__p1"), F.col("bar_date").alias("exit_date"))
    j = c.join(entry, ["symbol", "entry_day"], "left").join(exit_, ["symbol", "end_day"], "left")
    given = F.nullif(F.col("entry_price").cast("double"), F.lit(0.0)) if "entry_price" in calls.columns else F.lit(None).cast("double")
    p0 = F.coalesce(given, F.col("__p0"))
    ok = ((F.col("end_day") < F.to_date(now)) & F.col("__p1").isNotNull() & (F.datediff("entry_day", "__d0") <= lookback_days) & (p0 != 0))
    ret = (F.col("__p1") - p0) / p0 * 100.0
    return j.select(*calls.columns, "entry_day", "end_day", F.when(ok, p0).alias("entry_px"), F.when(ok, F.col("__p1")).alias("exit_px"),
                    F.when(ok, ret).alias("return_pct"), F.when(ok, F.col("exit_date")).alias("exit_date"))


def benchmark_return(calls: DataFrame, bench: DataFrame, now: Column, stocks=None, symbol: str = K.BENCHMARK, **kw) -> DataFrame:
    """Add the benchmark's return over each stock call's window. Stocks are the holdings unless ``stocks`` names others.

    The distinct (entry day, horizon) pairs are scored once: late in an entry day, a call made then acts on that very day.
    """
    b = bench.select("date", F.lit(symbol).alias("symbol"), "close")
    dated = calls.withColumn("__day", S.entry_day(F.lit(symbol), F.col("created_at")))
    spans = dated.select("__day", "horizon_days").distinct().select("__day", F.timestamp_add("HOUR", F.lit(22), F.col("__day").cast("timestamp")).alias("created_at"), "horizon_days", F.lit(symbol).alias("symbol"))
    r = window_return(spans, b, now, **kw).select(F.col("__day").alias("__d"), F.col("horizon_days").alias("__h"), F.col("return_pct").alias("__b"))
    j = dated.join(r, (F.col("__day") == F.col("__d")) & F.col("horizon_days").eqNullSafe(F.col("__h")), "left")
    return j.select(*calls.columns, F.when(F.col("symbol").isin(list(stocks or K.HOLDINGS)), F.col("__b")).alias("benchmark_pct"))


def score_calls(calls: DataFrame, bars: DataFrame, bench: DataFrame, now: Column, threshold: float = 0.5, stocks=None) -> DataFrame:
    """Calls with window return, verdict and excess over the benchmark."""
    c = benchmark_return(window_return(calls, bars, now), bench, now, stocks)
    return c.withColumns({"verdict": F.when(F.col("return_pct").isNotNull(), S.verdict(F.col("call"), F.col("return_pct"), threshold)),
                          "excess_pct": F.col("return_pct") - F.col("benchmark_pct")})


def check_outcomes(calls: DataFrame, bars: DataFrame, bench: DataFrame, now: Column, threshold: float = 0.5, stocks=None) -> DataFrame:
    """The edits for calls without an outcome whose window has closed."""
    todo = calls.where(F.col("outcome").isNull()) if "outcome" in calls.columns else calls
    if "ticker_or_theme" in calls.columns:
        todo = todo.withColumn("symbol", X.resolve_symbol(F.col("ticker_or_theme"), F.col("symbol")))
    s = score_calls(todo.where(F.col("symbol").isNotNull()), bars, bench, now, threshold, stocks)
    return s.where(F.col("verdict").isNotNull()).select(
        "id", F.col("verdict").alias("outcome"), now.alias("outcome_checked_at"), F.col("exit_px").alias("exit_price"),
        F.round("return_pct", 3).alias("asset_return_pct"), F.round("benchmark_pct", 3).alias("benchmark_return_pct"),
        F.round("excess_pct", 3).alias("excess_return_pct"), now.alias("resolved_at"))


def apply_outcomes(calls: DataFrame, edits: DataFrame) -> DataFrame:
    return patch(calls, edits, ["id"])


def unscored_calls_report(calls: DataFrame, bars: DataFrame, now: Column) -> DataFrame:
    """One row over the calls without an outcome: how many can be checked now, are skipped (open or no price), and have no symbol."""
    calls = calls.where(F.col("outcome").isNull()) if "outcome" in calls.columns else calls
    c = calls.withColumn("symbol", X.resolve_symbol(F.col("ticker_or_theme"), F.col("symbol"))) if "ticker_or_theme" in calls.columns else calls
    w = window_return(c, bars, now)
    done = F.col("return_pct").isNotNull()
    return w.agg(F.count_if(done).alias("checked"), F.count_if(~done & F.col("symbol").isNotNull()).alias("skipped"),
                 F.count_if(F.col("symbol").isNull()).alias("unmapped"))


def log_calls(log: DataFrame, new_calls: DataFrame, bars: DataFrame, now: Column) -> DataFrame:
    """Append calls with resolved symbol and the latest close as entry price; columns the log lacks are dropped."""
    c = new_calls.withColumn("symbol", X.resolve_symbol(F.col("ticker_or_theme"), F.col("symbol")))
    last = bars.where(F.col("close").isNotNull() & (F.col("date") >= F.date_sub(F.to_date(now), 7))).groupBy("symbol").agg(F.max_by("close", "date").alias("entry_price"))
    c = c.drop("entry_price").join(last, "symbol", "left").withColumn("entry_at", F.when(F.col("entry_price").isNotNull(), now))
    return log.unionByName(c.select(*[x for x in c.columns if x in log.columns]), allowMissingColumns=True)


def forward_returns(bars: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """(symbol, date, r1, r3, r5): percent return to the close h of the symbol's own bars later."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars.where(F.col("close").isNotNull())
    return b.select("symbol", "date", *[((F.lead("close", h).over(w) / F.col("close") - 1) * 100).alias(f"r{h}") for h in horizons])


def calendar_prices(points: DataFrame, bars: DataFrame, calendar: DataFrame, horizon: Column | int = 5, day: str = "signal_date") -> DataFrame:
    """Add entry (next market day) and exit (h market days after entry) dates and closes to (symbol, day) points.

    The market calendar gets a running number once; it holds one row per trading day.
    """
    h = horizon if isinstance(horizon, Column) else F.lit(horizon)
    w = Window.orderBy("date")  # one row per trading day
    cal = calendar.select("date").distinct().withColumns({"i": F.row_number().over(w), "__next": F.lead("date").over(w)})
    until = F.coalesce(F.date_sub("__next", 1), F.col("date"))
    span = cal.select("i", F.explode(F.sequence("date", until, F.expr("INTERVAL 1 DAY"))).alias(day))
    first = calendar.agg(F.min("date")).scalar()
    p = points.withColumn("__h", h).join(span, day, "left").withColumn("i", F.coalesce("i", F.when(F.col(day) < first, 0)))
    entry = cal.select(F.col("date").alias("entry_date"), (F.col("i") - 1).alias("i"))
    exit_ = cal.select(F.col("date").alias("exit_date"), F.col("i").alias("__x"))
    p = p.join(entry, "i", "left").withColumn("__x", F.col("i") + 1 + F.col("__h")).join(exit_, "__x", "left")
    px = bars.select("symbol", "date", "close")
    p = p.join(px.select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry_px")), ["symbol", "entry_date"], "left")
    p = p.join(px.select("symbol", F.col("date").alias("exit_date"), F.col("close").alias("exit_px")), ["symbol", "exit_date"], "left")
    return p.select(*points.columns, "entry_date", "entry_px", "exit_date", "exit_px")


def latest_close(bars: DataFrame) -> DataFrame:
    return latest_per_key(bars.where(F.col("close").isNotNull()).select("symbol", "date", "close"), ["symbol"], ["date"])

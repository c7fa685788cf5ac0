"""Cross-sectional factor panel over daily (or any regular) bars.

Features at date t use closes up to t; labels enter at the next close. A symbol's rows are bounded by the calendar and
a date's rows by the universe, so every window partition is bounded whatever the history of other symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

FEATURES = ["r1", "r5", "r20", "r60", "mom_12_1", "vol20", "vol60", "dd_high", "dvol_ratio", "rel5", "rel20", "sec_rel20"]
HORIZONS = (1, 5, 20)
_BENCH = "__bench__"


def trading_days(bars: DataFrame, universe: DataFrame, min_symbols: int = 400) -> DataFrame:
    """Dates on which at least ``min_symbols`` universe members have a close."""
    b = bars.where(F.col("close").isNotNull()).join(universe.select("symbol"), "symbol", "left_semi")
    return b.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= min_symbols).select("date")


def densify(bars: DataFrame, calendar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every symbol on every calendar date, absent closes as null, so that row offsets are market-day offsets.

    The calendar is one array of dates (bounded by trading days) read as a scalar subquery. ``keys`` are the symbol and columns that it determines.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date"))).scalar()
    grid = bars.select(*(keys or ["symbol"])).distinct().withColumn("date", F.explode(days))
    return grid.join(bars.select("symbol", "date", "close", "volume"), ["symbol", "date"], "left")


def _over(symbol_rows: int | None = None):
    w = Window.partitionBy("symbol").orderBy("date")
    return w if symbol_rows is None else w.rowsBetween(-symbol_rows + 1, 0)


def pct_change(n: int, c: str = "close") -> Column:
    return F.try_divide(F.col(c), F.lag(c, n).over(_over())) - 1


def mom_12_1(c: str = "close") -> Column:
    return F.try_divide(F.lag(c, 21).over(_over()), F.lag(c, 252).over(_over())) - 1


def rolling_vol(n: int, ret: str = "f_r1") -> Column:
    w = _over(n)
    return F.when(F.count(ret).over(w) == n, F.stddev_samp(ret).over(w))


def drawdown_from_high(c: str = "close", n: int = 252, min_n: int = 120) -> Column:
    w = _over(n)
    return F.when(F.count(c).over(w) >= min_n, F.try_divide(F.col(c), F.max(c).over(w)) - 1)


def dollar_volume_ratio(dv: str = "dv", n: int = 60) -> Column:
    w = _over(n)
    return F.when(F.count(dv).over(w) == n, F.try_divide(F.col(dv), F.avg(dv).over(w)))


def forward_return(h: int, c: str = "close") -> Column:
    """Enter at the next close, leave h closes later."""
    return F.try_divide(F.lead(c, 1 + h).over(_over()), F.lead(c, 1).over(_over())) - 1


def of_benchmark(col: str, date: str = "date") -> Column:
    """The benchmark's value on the row's date."""
    return F.max(F.when(F.col("symbol") == _BENCH, F.col(col))).over(Window.partitionBy(date))


def sector_mean(col: str, date: str = "date", sector: str = "sector") -> Column:
    return F.avg(col).over(Window.partitionBy(date, sector))


def build_panel(bars: DataFrame, bench: DataFrame, universe: DataFrame, horizons=HORIZONS, min_symbols: int = 400) -> DataFrame:
    """(date, symbol, f_* features, y* forward excess returns) on the trading calendar, one row per date and symbol.

    Closes of members and benchmark are written once; calendar, grid and closes read that table. The benchmark is a column of its date (a window), not a
    second pass over the features. The result is partitioned by date, which per-date ranks then reuse.
    """
    members = bars.select("symbol", "date", "close", "volume").join(universe.select("symbol", F.coalesce("sector", F.lit("?")).alias("sector")), "symbol")
    index = bench.select(F.lit(_BENCH).alias("symbol"), "date", "close", F.lit(None).cast("double").alias("volume"), F.lit(None).cast("string").alias("sector"))
    both = written(members.unionByName(index), "panel-closes")
    calendar = both.where((F.col("symbol") != _BENCH) & F.col("close").isNotNull()).groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= min_symbols)
    g = densify(both, calendar, ["symbol", "sector"]).withColumns({
        **{f"f_r{n}": pct_change(n) for n in (1, 5, 20, 60)}, "f_mom_12_1": mom_12_1(), "f_dd_high": drawdown_from_high(),
        "dv": F.col("close") * F.col("volume"), **{f"fwd{h}": forward_return(h) for h in horizons}})
    g = g.withColumns({"f_vol20": rolling_vol(20), "f_vol60": rolling_vol(60), "f_dvol_ratio": dollar_volume_ratio()})
    # one shuffle by date serves the sector means, the benchmark columns and later ranks; the sort by (date, sector) serves both windows
    g = g.repartition("date").withColumn("f_sec_rel20", F.col("f_r20") - sector_mean("f_r20"))
    g = g.withColumns({f"__{c}": of_benchmark(c) for c in ("f_r5", "f_r20", *[f"fwd{h}" for h in horizons])}).where(F.col("symbol") != _BENCH)
    return g.withColumns({"f_rel5": F.col("f_r5") - F.col("__f_r5"), "f_rel20": F.col("f_r20") - F.col("__f_r20"),
                          **{f"y{h}": F.col(f"fwd{h}") - F.col(f"__fwd{h}") for h in horizons}}).select(
        "date", "symbol", *[f"f_{f}" for f in FEATURES], *[f"y{h}" for h in horizons])


def average_pct_rank(col: str, by: list[str]) -> Column:
    """Percentile rank with ties averaged and nulls left out, inside ``by``. One sort gives both tie bounds."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(col))
    low = F.rank().over(w)
    high = F.count(col).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(col).over(Window.partitionBy(*by))
    return F.when(F.col(col).isNotNull(), (low + high) / 2.0 / n)


def cs_rank(panel: DataFrame, cols: list[str], by: str = "date") -> DataFrame:
    """Replace f_x by its percentile rank r_x within ``by``; other columns stay.

    All features are ranked in one sort: a row unfolds into (feature, value), ranks are taken inside (``by``, feature), and the row folds again. A panel that is
    partitioned by ``by`` is not shuffled. Rows that agree in all other columns count as one, so those columns have to name a row (date and symbol do).
    """
    rest = [c for c in panel.columns if c not in cols]
    long = panel.select(*rest, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("__x"))
    long = long.select(*rest, F.col("__x.feature").alias("__feature"), F.col("__x.value").alias("__value"))
    ranked = long.withColumn("__rank", average_pct_rank("__value", [by, "__feature"]))
    return ranked.groupBy(*rest).agg(*[F.max(F.when(F.col("__feature") == c, F.col("__rank"))).alias(c.replace("f_", "r_", 1)) for c in cols])


def news_features(snaps: DataFrame, models=("ens", "finbert", "lex", "old"), last_hour: int = 20) -> DataFrame:
    """(date, symbol, n_idx_*, n_z_*, n_att_z_*): the last snapshot of each day not after ``last_hour``:59 UTC."""
    s = snaps.where(F.hour("ts") <= last_hour).withColumn("date", F.to_date("ts"))
    pick = lambda m, c: F.max_by(F.when(F.col("model") == m, F.col(c)), F.when(F.col("model") == m, F.col("ts"))).alias(f"n_{c}_{m}")
    return s.groupBy("date", "symbol").agg(*[pick(m, c) for c in ("idx", "z", "att_z") for m in models])

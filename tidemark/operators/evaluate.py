"""Does a signal predict returns? Rank correlations with honest p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as K
from ..functions import stats as S
from ..session import cut_lineage
from .asof import forward_returns
from .keyed import latest_per_key


def _placed_values(df: DataFrame, by: list[str], col: str, splits: int) -> DataFrame:
    """(by, col, __c, __first): distinct values of each group with their number and how many rows have lesser ones, without sorting a whole group in one task.

    Equal values fold first; approximate quantiles only choose bucket borders (any border gives exact places), each bucket is counted on its own and
    shifted by the sizes of the buckets before it.
    """
    vals = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__c"))
    borders = df.groupBy(*by).agg(F.percentile_approx(col, F.array(*[F.lit(i / splits) for i in range(1, splits)])).alias("__q"))
    v = vals.join(borders, by).withColumn("__b", F.size(F.filter("__q", lambda q: q < F.col(col)))).drop("__q")
    sizes = v.groupBy(*by, "__b").agg(F.sum("__c").alias("__n"))
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__off"))
    wv = Window.partitionBy(*by, "__b").orderBy(col)
    return v.join(offsets, [*by, "__b"]).select(*by, col, "__c", (F.col("__off") + F.sum("__c").over(wv) - F.col("__c")).alias("__first"))


def average_ranks(df: DataFrame, by: list[str], col: str, out: str, splits: int = 64) -> DataFrame:
    """Add the tie-averaged rank of ``col`` within ``by``, from the places of its distinct values (:func:`_placed_values`)."""
    r = _placed_values(df, by, col, splits).select(*by, col, (F.col("__first") + (F.col("__c") + 1) / 2.0).alias(out))
    return df.join(r, [*by, col], "left")


def exact_quantiles(df: DataFrame, by: list[str], col: str, shares: list[float], out: str, splits: int = 64) -> DataFrame:
    """(by, out): exact quantiles of a group at the given shares, linear between neighbours, without a group's values in one buffer."""
    v = _placed_values(df, by, col, splits)
    g = v.join(v.groupBy(*by).agg(F.sum("__c").alias("__n")), by)
    held = lambda at: F.max(F.when((F.col("__first") <= at) & (at < F.col("__first") + F.col("__c")), F.col(col)))
    places = [F.lit(p) * (F.col("__n") - 1) for p in shares]
    q = g.groupBy(*by).agg(F.first("__n").alias("__n"), *[held(f(p)).alias(f"__{side}{k}") for k, p in enumerate(places) for side, f in (("lo", F.floor), ("hi", F.ceil))])
    at = lambda k, p: F.when(F.floor(p) == F.ceil(p), F.col(f"__lo{k}")).otherwise((F.ceil(p) - p) * F.col(f"__lo{k}") + (p - F.floor(p)) * F.col(f"__hi{k}"))
    return q.select(*by, F.array(*[at(k, p) for k, p in enumerate(places)]).alias(out))


def spearman_test(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 8) -> DataFrame:
    """(by, n, rho, p): rank correlation of complete pairs with a normal-approximation two-sided p."""
    d = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y))
    d = average_ranks(average_ranks(d, by, x, "__rx"), by, y, "__ry")
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias("rho")).where((F.col("n") >= min_n) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    return g.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(S.two_sided_p(t)))


def signal_observations(snaps: DataFrame, bars: DataFrame, bench: DataFrame, since, horizons=(1, 3, 5), min_stories: int = 3, last_hour: int = 20) -> DataFrame:
    """Long (model, metric, horizon, kind, x, y): each day's last snapshot against later raw and benchmark-relative returns.

    Macro symbols are priced by their future, index or rate."""
    s = snaps.where(F.col("idx").isNotNull() & (F.col("ts") >= since) & (F.hour("ts") <= last_hour) & (F.col("n_lead") >= min_stories))
    s = latest_per_key(s.select("symbol", "model", F.to_date("ts").alias("date"), "ts", "idx", "z"), ["symbol", "date", "model"], ["ts"])
    own = forward_returns(bars, horizons).withColumnRenamed("symbol", "__px")
    s = s.withColumn("__px", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in K.MACRO_PRICE_SYMBOL.items() for x in kv]), F.col("symbol")), F.col("symbol")))
    mkt = forward_returns(bench.select("date", F.lit("__m").alias("symbol"), "close"), horizons).select("date", *[F.col(f"r{h}").alias(f"m{h}") for h in horizons])
    j = s.join(own, ["__px", "date"]).join(mkt, "date", "left")
    metric = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("x")) for n, c in (("index", "idx"), ("z", "z"))]))
    out = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("kind"), y.alias("y")) for h in horizons
                              for k, y in (("raw", F.col(f"r{h}")), ("vs market", F.col(f"r{h}") - F.col(f"m{h}")))]))
    return (j.select("model", metric.alias("a"), *[f"r{h}" for h in horizons], *[f"m{h}" for h in horizons])
            .select("model", "a.metric", "a.x", out.alias("b")).select("model", "metric", "x", "b.horizon", "b.kind", "b.y")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


_TEST = ["model", "metric", "horizon", "kind"]


def signal_eval(obs: DataFrame) -> DataFrame:
    """One row per test: n, rho, p and top-third minus bottom-third mean return."""
    obs = cut_lineage(obs)
    q = exact_quantiles(obs, _TEST, "x", [1 / 3, 2 / 3], "q")
    j = obs.join(q, _TEST)
    spread = j.groupBy(*_TEST).agg((F.avg(F.when(F.col("x") >= F.col("q")[1], F.col("y"))) - F.avg(F.when(F.col("x") <= F.col("q")[0], F.col("y")))).alias("spread"))
    return spearman_test(obs, _TEST, "x", "y").join(spread, _TEST)


def signal_verdict(tests: DataFrame) -> DataFrame:
    """One row: tests, significant ones, how many chance alone would give, and the plain verdict."""
    sig = (F.col("p") < 0.05) & (F.col("n") >= 30)
    g = tests.agg(F.count("*").alias("tests"), F.count_if(sig).alias("significant"))
    return g.select("tests", "significant", (F.col("tests") * 0.05).alias("expected_by_chance"),
                    F.when(F.col("significant") <= F.col("tests") * 0.05 + 1, "Nothing beyond chance yet.")
                    .otherwise("Possible signal: a hypothesis for the forward paper ledger, not proof.").alias("verdict"))

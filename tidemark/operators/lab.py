"""Strategy scores, walk-forward evaluation and the paper ledger."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .asof import calendar_prices
from .keyed import patch, upsert
from .panel import FEATURES, average_pct_rank

RANKED = [f"r_{f}" for f in FEATURES]
COST_BPS = 10.0
ROUND_TRIP_PCT = 0.2


def strategy_scores(ranked: DataFrame) -> DataFrame:
    """Long (date, symbol, book, score) of the rule books."""
    books = {"mom": F.col("r_mom_12_1"), "rev": -F.col("r_r5"), "lowvol": -F.col("r_vol60")}
    arr = F.array(*[F.struct(F.lit(b).alias("book"), s.alias("score")) for b, s in books.items()])
    return ranked.select("date", "symbol", F.explode(arr).alias("x")).select("date", "symbol", "x.book", "x.score").where(F.col("score").isNotNull())


def news_scores(news: DataFrame, models=("ens", "finbert", "lex", "old"), min_names: int = 50) -> DataFrame:
    """Books news_<model>: the z-score, or the index on dates that have no z at all, where enough names exist."""
    arr = F.array(*[F.struct(F.lit(f"news_{m}").alias("book"), F.col(f"n_z_{m}").alias("z"), F.col(f"n_idx_{m}").alias("idx")) for m in models])
    long = news.select("date", "symbol", F.explode(arr).alias("x")).select("date", "symbol", "x.*")
    w = Window.partitionBy("date", "book")
    s = long.withColumn("score", F.when(F.count("z").over(w) > 0, F.col("z")).otherwise(F.col("idx"))).where(F.col("score").isNotNull())
    return s.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= min_names).select("date", "symbol", "book", "score")


def latest_complete_date(ranked: DataFrame, cols=None) -> Column:
    """The last date with a row where every ranked feature is present, as a scalar subquery."""
    return ranked.na.drop(subset=list(cols or RANKED)).agg(F.max("date")).scalar()


def rank_book(scores: DataFrame, k: int = 25, min_names: int = 50) -> DataFrame:
    """Per (date, book) the ``k`` best and worst names with rank and book size."""
    w = Window.partitionBy("date", "book")
    r = scores.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "n": F.count("*").over(w)})
    return r.where((F.col("n") >= min_names) & ((F.col("rank") <= k) | (F.col("rank") > F.col("n") - k)))


def record_predictions(existing: DataFrame, ranked_book: DataFrame, horizon: int = 5) -> DataFrame:
    new = ranked_book.select(F.col("date").alias("pred_date"), "book", F.lit(horizon).alias("horizon"), "symbol", "score", "rank")
    return upsert(existing, new, ["pred_date", "book", "horizon", "symbol"], "ignore")


def new_positions(ranked_book: DataFrame, top: int = 10, horizon: int = 5) -> DataFrame:
    """Pending paper positions: the ``top`` best as long and the ``top`` worst as avoid."""
    long, avoid = F.col("rank") <= top, F.col("rank") > F.col("n") - top
    sides = F.array_compact(F.array(F.when(long, F.lit("long")), F.when(avoid, F.lit("avoid"))))
    return ranked_book.select("book", F.explode(sides).alias("side"), "symbol", F.col("date").alias("signal_date"), F.lit(horizon).alias("horizon"), F.lit("pending").alias("status"))


def open_positions(ledger: DataFrame, ranked_book: DataFrame, top: int = 10, horizon: int = 5) -> DataFrame:
    return upsert(ledger, new_positions(ranked_book, top, horizon), ["book", "side", "symbol", "signal_date"], "ignore")


def settled(pending: DataFrame, bars: DataFrame, bench: DataFrame, calendar: DataFrame, cost_pct: float = ROUND_TRIP_PCT) -> DataFrame:
    """Closed rows for pending positions whose window has passed with usable prices; the rest are left out."""
    p = pending.select("book", "side", "symbol", "signal_date", "horizon")
    p = calendar_prices(p, bars, calendar, F.col("horizon"))
    b = bench.select("date", "close")
    p = (p.join(b.select(F.col("date").alias("entry_date"), F.col("close").alias("__s0")), "entry_date")
         .join(b.select(F.col("date").alias("exit_date"), F.col("close").alias("__s1")), "exit_date"))
    p = p.where((F.col("entry_px") > 0) & (F.col("__s0") > 0) & F.col("exit_px").isNotNull() & F.col("__s1").isNotNull())
    ret, spy = (F.col("exit_px") / F.col("entry_px") - 1) * 100, (F.col("__s1") / F.col("__s0") - 1) * 100
    p = p.withColumns({"ret_pct": ret, "spy_ret_pct": spy})
    p = p.withColumn("excess_pct", F.when(F.col("side") == "long", F.col("ret_pct") - F.col("spy_ret_pct")).otherwise(F.col("spy_ret_pct") - F.col("ret_pct")))
    return p.select("book", "side", "symbol", "signal_date", "horizon", "entry_date", "entry_px", "exit_date", "exit_px", "ret_pct", "spy_ret_pct",
                    "excess_pct", (F.col("excess_pct") - cost_pct).alias("net_excess_pct"), F.lit("closed").alias("status"))


def settle_positions(ledger: DataFrame, bars: DataFrame, bench: DataFrame, calendar: DataFrame, cost_pct: float = ROUND_TRIP_PCT) -> DataFrame:
    done = settled(ledger.where(F.col("status") == "pending"), bars, bench, calendar, cost_pct).drop("horizon")
    return patch(ledger, done, ["book", "side", "symbol", "signal_date"])


def ledger_report(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("status") == "closed").groupBy("book", "side").agg(
        F.count("*").alias("closed_positions"), F.avg("excess_pct").alias("mean_excess_pct"), F.avg("net_excess_pct").alias("mean_net_excess_pct"),
        F.avg((F.col("excess_pct") > 0).cast("int")).alias("hit_rate"), F.min("signal_date").alias("first"), F.max("signal_date").alias("last"))


def ledger_with_open(positions: DataFrame) -> DataFrame:
    closed = F.col("status") == "closed"
    return positions.groupBy("book", "side").agg(
        F.count_if(closed).alias("n"), F.avg(F.when(closed, F.col("net_excess_pct"))).alias("net"),
        F.avg(F.when(closed, (F.col("excess_pct") > 0).cast("int"))).alias("hit"), F.count_if(F.col("status") == "pending").alias("open"))


def top_predictions(predictions: DataFrame, k: int = 10) -> DataFrame:
    last = predictions.agg(F.max("pred_date")).scalar()
    return predictions.where((F.col("pred_date") == last) & (F.col("rank") <= k)).select("book", "symbol", "rank", "score")


def avoid_predictions(predictions: DataFrame, k: int = 10) -> DataFrame:
    last = predictions.agg(F.max("pred_date")).scalar()
    p = predictions.where(F.col("pred_date") == last).withColumn("__max", F.max("rank").over(Window.partitionBy("book")))
    return p.where(F.col("rank") > F.col("__max") - k).select("book", "symbol", "rank", "score")


def top5_per_book(scores: DataFrame, k: int = 5) -> DataFrame:
    """(date, book, top) with the best names in order."""
    w = Window.partitionBy("date", "book").orderBy(F.desc("score"), "symbol")
    best = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.groupBy("date", "book").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("top"))


def lab_report(scores: DataFrame, positions: DataFrame, as_of: Column) -> DataFrame:
    """One JSON document: books, top five, open count and ledger."""
    top = top5_per_book(scores.where(F.col("date") == as_of)).agg(F.array_sort(F.collect_list(F.struct("book", "top")))).scalar()
    ledger = ledger_report(positions).agg(F.array_sort(F.collect_list(F.struct(
        "book", "side", "closed_positions", "mean_excess_pct", "mean_net_excess_pct", "hit_rate", "first", "last")))).scalar()
    pending = positions.where(F.col("status") == "pending").agg(F.count("*")).scalar()
    one = scores.sparkSession.range(1)
    return one.select(as_of.alias("as_of"), F.to_json(F.struct(as_of.alias("as_of"), top.alias("top5"), pending.alias("open_paper_positions"),
                                                               ledger.alias("ledger"))).alias("report"))


# ---------------------------------------------------------------- evaluation

def daily_ic(scores: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y", min_n: int = 50) -> DataFrame:
    """Spearman correlation per date (and ``by``)."""
    keys = [*(by or []), "date"]
    d = scores.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    d = d.select(*keys, average_pct_rank(score, keys).alias("__a"), average_pct_rank(y, keys).alias("__b"))
    ic = d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("ic"))
    return ic.where((F.col("n") >= min_n) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def decile_spread(scores: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y", min_n: int = 100, tail: float = 0.1) -> DataFrame:
    """Mean y of the top tail minus the bottom tail per date (and ``by``)."""
    keys = [*(by or []), "date"]
    d = scores.where(F.col(score).isNotNull() & F.col(y).isNotNull()).withColumn("__q", average_pct_rank(score, keys))
    top, low = F.avg(F.when(F.col("__q") >= 1 - tail, F.col(y))), F.avg(F.when(F.col("__q") <= tail, F.col(y)))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (top - low).alias("spread")).where((F.col("n") >= min_n) & F.col("spread").isNotNull())


def summarise_strategy(ic: DataFrame, spread: DataFrame, h: int, by: str = "book", min_days: int = 30, cost_bps: float = COST_BPS) -> DataFrame:
    """Per strategy: days, mean IC, its overlap-shrunk t, gross and net spread, share of good days, skill flag."""
    cost = 2 * cost_bps / 1e4 * 2
    a = ic.groupBy(by).agg(F.count("*").alias("n_days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("__sd"))
    b = spread.groupBy(by).agg(F.avg("spread").alias("__g"), F.avg((F.col("spread") > 0).cast("int")).alias("hit_days"))
    t = F.col("ic_mean") / (F.col("__sd") / F.sqrt("n_days")) / (float(h) ** 0.5)
    enough = F.col("n_days") >= min_days
    only = lambda c: F.when(enough, c)
    return a.join(b, by, "left").select(
        by, "n_days", only(F.col("ic_mean")).alias("ic_mean"), only(t).alias("ic_t"), only(F.col("__g") * 100).alias("spread_gross_pct"),
        only((F.col("__g") - cost) * 100).alias("spread_net_pct"), only(F.col("hit_days")).alias("hit_days"),
        F.coalesce(enough & (t > 2) & (F.col("__g") - cost > 0), F.lit(False)).alias("skill"), F.when(~enough, "too few days").alias("note"))


def evaluate_books(scores: DataFrame, panel: DataFrame, h: int, min_ic: int = 50, min_tail: int = 100, min_days: int = 30) -> DataFrame:
    s = cut_lineage(scores.join(panel.select("date", "symbol", F.col(f"y{h}").alias("y")), ["date", "symbol"]))
    return summarise_strategy(daily_ic(s, ["book"], min_n=min_ic), decile_spread(s, ["book"], min_n=min_tail), h, min_days=min_days)


def _complete(ranked: DataFrame, h: int) -> DataFrame:
    return ranked.na.drop(subset=RANKED).withColumn("y", F.col(f"y{h}"))


def _quarter(d: Column) -> Column:
    return F.to_date(F.date_trunc("quarter", d))


def walk_forward_folds(ranked: DataFrame, start: str, h: int, min_train: int = 50_000) -> DataFrame:
    """Quarterly folds (fold_start, cutoff, n_train, n_test) with enough purged training rows.

    Training dates end int(1.6 h) + 4 days before the fold. Counts come from one pass per date: a date trains every fold
    from the first quarter that starts late enough, so a running sum over quarters replaces a range join.
    """
    gap = int(h * 1.6) + 4
    d = _complete(ranked, h)
    test = d.where(F.col("date") >= F.lit(start).cast("date")).groupBy(_quarter(F.col("date")).alias("fold_start")).agg(F.count("*").alias("n_test"))
    ready = F.date_add("date", gap)
    first = F.when(_quarter(ready) == ready, ready).otherwise(F.add_months(_quarter(ready), 3))
    train = d.where(F.col("y").isNotNull()).groupBy(first.alias("fold_start")).agg(F.count("*").alias("__c"))
    w = Window.orderBy("fold_start")  # one row per quarter
    f = test.join(train, "fold_start", "full").withColumn("n_train", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    f = f.where((F.col("n_test") > 0) & (F.col("fold_start") >= F.lit(start).cast("date")) & (F.col("n_train") >= min_train))
    return f.select("fold_start", F.date_sub("fold_start", gap).alias("cutoff"), "n_train", "n_test")


def every_nth(train: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... in (date, symbol) order, numbered per date plus the rows of earlier dates."""
    if n == 1:
        return train
    per_day = train.groupBy("date").agg(F.count("*").alias("__c"))
    before = per_day.select("date", (F.sum("__c").over(Window.orderBy("date")) - F.col("__c")).alias("__off"))
    i = F.col("__off") + F.row_number().over(Window.partitionBy("date").orderBy("symbol")) - 1
    return train.join(before, "date").withColumn("__i", i).where(F.col("__i") % n == 0).drop("__i", "__off")


def fit_gbt(train: DataFrame, rounds: int = 150, depth: int = 3, rate: float = 0.05, min_leaf: int = 400, seed: int = 7):
    """Boosted trees on ranked features; the label is y's percentile rank per date (column ``y_rank``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    x = VectorAssembler(inputCols=RANKED, outputCol="features").transform(train)
    gbt = GBTRegressor(featuresCol="features", labelCol="y_rank", maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, seed=seed)
    return gbt.fit(x)


def predict_gbt(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=RANKED, outputCol="features").transform(rows.na.drop(subset=RANKED))
    return model.transform(x).select("date", "symbol", F.lit("gbt").alias("book"), F.col("prediction").alias("score"))


def walk_forward_rules(ranked: DataFrame, start: str, h: int, min_train: int = 50_000) -> DataFrame:
    """Out-of-sample scores of the rule books on all usable folds. Pass a materialised ``ranked``: it is read twice."""
    folds = walk_forward_folds(ranked, start, h, min_train).select("fold_start")
    d = _complete(ranked, h).withColumn("fold_start", _quarter(F.col("date"))).join(folds, "fold_start", "left_semi")
    return strategy_scores(d)


def walk_forward(ranked: DataFrame, start: str, h: int, min_train: int = 50_000, train_every: int = 3, at_once: int = 8, part_rows: int = 100_000, **gbt) -> DataFrame:
    """Rule books plus boosted trees refit before every fold. Folds are quarters and do not depend on each other: ``at_once`` of them are fitted side by side,
    each fit being Spark jobs, so that the cores are busy while one fit's next round is prepared.

    ``train_every``: trees are fitted on every so many-th training row in (date, symbol) order, 1 for all; neighbouring days say much the same.
    ``part_rows``: training rows of a fold are dealt into parts of about that many, as its counted rows demand.
    """
    ranked = cut_lineage(ranked)
    d = cut_lineage(_complete(ranked, h).withColumn("y_rank", average_pct_rank("y", ["date"])))

    def fold_scores(f) -> DataFrame:
        train = d.where((F.col("date") <= F.lit(f.cutoff)) & F.col("y").isNotNull())
        test = d.where((F.col("date") >= F.lit(f.fold_start)) & (F.col("date") < F.add_months(F.lit(f.fold_start), 3)))
        rows = every_nth(train, train_every).repartition(1 + f.n_train // (train_every * part_rows), "date", "symbol")
        return predict_gbt(fit_gbt(cut_lineage(rows), **gbt), test)

    folds = walk_forward_folds(ranked, start, h, min_train).orderBy("fold_start").collect()
    with ThreadPoolExecutor(at_once) as pool:
        books = list(pool.map(inheritable_thread_target(ranked.sparkSession)(fold_scores), folds))
    return reduce(lambda a, b: a.unionByName(b), [walk_forward_rules(ranked, start, h, min_train), *books])

"""Rules that must hold whatever the data: no look-ahead, enough history, idempotent writes, notify once."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import lab as L
from tidemark.operators import panel as W
from tidemark.operators import scoring as N
from tidemark.operators import sentiment as S
from tidemark.operators.keyed import upsert
from tidemark.sources import tables as T
from tidemark.streaming import jobs as J

T0 = datetime(2024, 1, 1)


def test_z_needs_twenty_points_and_spread(spark):
    rows = [(T0 + timedelta(hours=h), s, "ens", 0.5 if s == "flat" else (h % 5) / 5) for s in ("flat", "wavy") for h in range(40)]
    z = S.rolling_zscore(spark.createDataFrame(rows, "ts timestamp, symbol string, model string, idx double")).collect()
    assert all(r.z is None for r in z if r.symbol == "flat")
    assert {(r.ts - T0).total_seconds() / 3600 for r in z if r.symbol == "wavy" and r.z is not None} == set(range(20, 40))


def _bars(spark, shift=None, n=140):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        for s in ["A", "B", "C", "BM"]:
            px = 100 + rng.random() * 10 + k * 0.1
            if shift and k >= shift:
                px *= 3
            if not (s == "B" and k % 17 == 0):
                rows.append((date(2020, 1, 1) + timedelta(days=k), s, px, 1000.0 + k))
    df = spark.createDataFrame(rows, "date date, symbol string, close double, volume double")
    u = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "symbol string, sector string")
    return df.where("symbol <> 'BM'"), df.where("symbol = 'BM'").select("date", "close"), u


def test_features_do_not_see_the_future(spark):
    cut = 100
    feats = ["date", "symbol"] + [f"f_{f}" for f in W.FEATURES]
    base = W.build_panel(*_bars(spark), min_symbols=2).select(feats)
    moved = W.build_panel(*_bars(spark, shift=cut), min_symbols=2).select(feats)
    before = F.col("date") < F.lit(date(2020, 1, 1) + timedelta(days=cut))
    assert base.where(before).exceptAll(moved.where(before)).count() == 0
    assert base.where(~before).exceptAll(moved.where(~before)).count() > 0


def test_label_enters_at_the_next_close(spark):
    bars, bench, u = _bars(spark)
    p = {(r.date, r.symbol): r.y1 for r in W.build_panel(bars, bench, u, min_symbols=2).collect()}
    c = {(r.date, r.symbol): r.close for r in bars.collect()}
    m = {r.date: r.close for r in bench.collect()}
    d = [date(2020, 1, 1) + timedelta(days=k) for k in (50, 51, 52)]
    assert abs(p[(d[0], "A")] - (c[(d[2], "A")] / c[(d[1], "A")] - m[d[2]] / m[d[1]])) < 1e-12


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "c")], "k int, v string")
    for mode, want in (("ignore", {(1, "a"), (2, "b"), (3, "c")}), ("overwrite", {(1, "a"), (2, "new"), (3, "c")})):
        once = upsert(t, b, ["k"], mode)
        twice = upsert(once, b, ["k"], mode)
        assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want


def test_positions_settle_once_and_wait_for_prices(spark):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(8)]
    bars = spark.createDataFrame([(d, "A", 100.0 + k) for k, d in enumerate(days)], "date date, symbol string, close double")
    bench = spark.createDataFrame([(d, 50.0) for d in days], "date date, close double")
    led = spark.createDataFrame([("m", "long", "A", days[0], 5, "pending"), ("m", "avoid", "A", days[0], 5, "pending"), ("m", "long", "A", days[5], 5, "pending"), ("m", "long", "GONE", days[0], 5, "pending")],
                                "book string, side string, symbol string, signal_date date, horizon int, status string")
    once = L.settle_positions(led, bars, bench, bench)
    got = {(r.side, r.symbol, r.signal_date): (r.status, None if r.net_excess_pct is None else round(r.net_excess_pct, 6)) for r in once.collect()}
    gain = (106 / 101 - 1) * 100
    assert got == {("long", "A", days[0]): ("closed", round(gain - 0.2, 6)), ("avoid", "A", days[0]): ("closed", round(-gain - 0.2, 6)),
                   ("long", "A", days[5]): ("pending", None), ("long", "GONE", days[0]): ("pending", None)}
    again = L.settle_positions(once, bars, bench, bench)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in once.collect()}


def test_scores_stay_in_range(spark, inputs):
    from tidemark.catalog.text_queries import LINK_UNIVERSE, NAMES, PATTERNS
    s = N.score_articles(inputs["fx_articles"], inputs["fx_scores"], NAMES, LINK_UNIVERSE, PATTERNS)
    lo, hi = s.agg(F.min(F.least("lex", "ens", F.coalesce("finbert", "lex"))), F.max(F.greatest("lex", "ens", F.coalesce("finbert", "lex")))).collect()[0]
    assert -1.0 <= lo <= hi <= 1.0


def test_prices_round_trip(spark, inputs, tmp_path):
    T.write_prices(inputs["fx_bars"], str(tmp_path / "px"))
    back = T.read_prices(spark, str(tmp_path / "px"))
    assert back.count() == inputs["fx_bars"].count()
    assert back.exceptAll(inputs["fx_bars"].select("date", "symbol", "close", "volume")).count() == 0


def _land(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_drops_repeated_urls_across_batches(spark, tmp_path):
    schema = "id long, url string, published_at timestamp"
    path = str(tmp_path / "in")
    _land(spark, [(1, "u1", T0), (2, "u1", T0), (3, "u2", T0)], path, schema)
    _land(spark, [(4, "u2", T0 + timedelta(hours=1)), (5, "u3", T0 + timedelta(hours=1))], path, schema)
    s = J.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    assert sorted(r.url for r in J.drain(J.stream_articles(s)).collect()) == ["u1", "u2", "u3"]


def test_stream_index_drops_only_rows_behind_the_watermark(spark, tmp_path):
    schema = "symbol string, ts timestamp, src_w double, event_w double, rel double, novelty double, confirm int, lex double"
    row = lambda h, v: ("A", T0 + timedelta(hours=h, minutes=30), 1.0, 1.0, 1.0, 1.0, 0, v)
    path = str(tmp_path / "in")
    for batch in ([row(0, 1.0), row(10, 1.0)], [row(11, 1.0), row(30, 1.0)], [row(1, -1.0), row(29, 0.0), row(200, 0.0)]):
        _land(spark, batch, path, schema)
    s = J.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    got = {r.ts: r.idx for r in J.drain(J.stream_sentiment_index(s, ["lex"])).collect()}
    assert got[T0 + timedelta(hours=12)] == 1.0  # the row of hour 1 came a day too late
    assert 0 < got[T0 + timedelta(hours=31)] < 1.0  # the row of hour 29 was late but inside the watermark


def test_stream_alert_cooldown_survives_batches(spark, tmp_path):
    schema = "ts timestamp, symbol string, model string, z double, n_lead int"
    path = str(tmp_path / "in")
    for hours in ([0, 3], [5, 6], [11, 12]):
        _land(spark, [(T0 + timedelta(hours=h), "NVDA", "ens", 3.0, 5) for h in hours], path, schema)
    s = J.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    assert sorted(r.ts for r in J.drain(J.stream_zscore_alerts(s)).collect()) == [T0, T0 + timedelta(hours=6), T0 + timedelta(hours=12)]

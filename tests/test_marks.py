"""Marks that jobs keep themselves, alert state that empties, and the address of a feed entry."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.core import moment
from tidemark.sources.feeds import feed_entries
from tidemark.streaming import jobs as J
from tidemark.streaming import marks as M

T0 = datetime(2024, 1, 1)
CALL = "id long, created_at timestamp, outcome_checked_at timestamp"


def calls(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=h), None if c is None else T0 + timedelta(hours=c)) for i, h, c in rows], CALL)


def push(spark, rows, base, **kw):
    none = spark.createDataFrame([], "id long, created_at timestamp")
    return M.push_digests_calls(none, calls(spark, rows), base, moment("2024-01-01 00:00:00"), **kw)[1]


def test_three_runs_without_a_callers_mark(spark, tmp_path):
    base, seen = str(tmp_path / "m"), []
    keep = dict(publish=lambda df: seen.append(sorted(r.id for r in df.collect())))
    assert push(spark, [(1, 1, None), (2, 2, None), (9, 0, None)], base, **keep) == 2  # 9 lies at the first mark, not after it
    assert push(spark, [(1, 1, None), (2, 2, None), (3, 2, None), (4, 5, None)], base, **keep) == 2  # 3 shares the mark's time
    assert push(spark, [(1, 1, 8), (2, 2, None), (3, 2, None), (4, 5, None)], base, **keep) == 1  # checked later
    assert push(spark, [(1, 1, 8), (4, 5, None)], base, **keep) == 0
    assert seen == [[1, 2], [3, 4], [1]] and M.committed(spark, f"{base}/calls") == [0, 1, 2]


def test_a_failed_publication_is_repeated(spark, tmp_path):
    base, seen = str(tmp_path / "m"), []

    def fail(df):
        raise OSError("unreachable")

    with pytest.raises(OSError):
        push(spark, [(1, 1, None)], base, publish=fail)
    assert M.committed(spark, f"{base}/calls") == []
    assert push(spark, [(1, 1, None), (2, 3, None)], base, publish=lambda df: seen.extend(r.id for r in df.collect())) == 2
    assert sorted(seen) == [1, 2] and M.pushed(spark, f"{base}/calls").count() == 2


def test_pages_with_ties(spark, tmp_path):
    rows = [(i, 1 + i // 5, None) for i in range(17)]
    assert push(spark, rows, str(tmp_path / "m"), limit=4) == 17
    got = M.pushed(spark, str(tmp_path / "m" / "calls"))
    assert sorted(r.id for r in got.collect()) == list(range(17)) and got.select("page").distinct().count() == 5


def test_the_mark_reaches_the_scan(spark, tmp_path):
    calls(spark, [(1, 1, None)]).write.parquet(str(tmp_path / "t"))
    plan = M.changed_after(spark.read.parquet(str(tmp_path / "t")), ["created_at", "outcome_checked_at"], F.timestamp_micros(F.lit(10**15)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(created_at" in plan


def test_alert_state_empties_after_the_cooldown(spark, tmp_path):
    """One symbol fires and falls silent; another goes on. Only the state of the second is left."""
    schema, src = "ts timestamp, symbol string, model string, z double, n_lead int", str(tmp_path / "in")
    hot = [("A", 0), ("A", 3), ("A", 6), *[("B", h) for h in range(0, 200, 2)]]
    for k, (lo, hi) in enumerate([(0, 8), (8, 60), (60, 120), (120, 200)]):
        spark.createDataFrame([(T0 + timedelta(hours=h), s, "ens", 3.0, 9) for s, h in hot if lo <= h < hi], schema).coalesce(1).write.parquet(f"{src}/k={k}")
    s = J.read_stream(spark, f"{src}/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    q = J.stream_zscore_alerts(s, allowed=[], late="6 hours").writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) == 2 and held[-1] <= 1
    got = sorted((r.symbol, int((r.ts - T0).total_seconds() // 3600)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("A", 0), ("A", 6), *[("B", h) for h in range(0, 200, 6)]]


def test_alternate_link_of_an_atom_entry(spark):
    links = {"<link rel='self' href='s'/><link rel='alternate' href='a'/>": "a", "<link rel='enclosure' href='e'/><link href='p'/>": "p",
             "<link rel='related' href='r'/>": "r", "": None}
    raw = spark.createDataFrame([(x, f"<feed><entry><title>t</title>{x}</entry></feed>") for x in links], "name string, raw_xml string")
    assert {r.name: r.link for r in feed_entries(raw).collect()} == links

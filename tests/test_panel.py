"""Panel and ranks: few scans, shuffles and sorts, and the same values as plain loops."""

import random
import re
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import panel as W

DAYS = [date(2020, 1, 1) + timedelta(days=7 * k) for k in range(90)]


@pytest.fixture(scope="module")
def closes():
    rng = random.Random(3)
    return {(s, d): 50 + 10 * k + rng.uniform(-5, 5) for k, s in enumerate("ABCD") for d in DAYS if s != "D" or rng.random() < 0.8}


@pytest.fixture(scope="module")
def panel(spark, closes):
    bars = spark.createDataFrame([(s, d, c, 10.0 * c) for (s, d), c in closes.items()] + [("OUT", d, 1.0, 1.0) for d in DAYS],
                                 "symbol string, date date, close double, volume double")
    bench = spark.createDataFrame([(d, 100.0 + k % 7) for k, d in enumerate(DAYS)], "date date, close double")
    universe = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", None), ("D", None)], "symbol string, sector string")
    return W.build_panel(bars, bench, universe, min_symbols=4)


def count(df, word):
    return len(re.findall(rf"\b{word}\b", df._jdf.queryExecution().executedPlan().toString()))


def test_one_table_few_sorts(panel):
    assert count(panel, "FileScan") <= 3 and count(panel, "Sort") <= 4


def test_ranks_shuffle_no_more_than_the_panel(panel):
    ranked = W.cs_rank(panel, [f"f_{f}" for f in W.FEATURES])
    assert count(ranked, "Exchange") == count(panel, "Exchange") and count(ranked, "Sort") <= 4


def test_values_of_the_panel(panel, closes):
    days = [d for d in DAYS if ("D", d) in closes]  # all four have a close
    level = {d: 100.0 + k % 7 for k, d in enumerate(DAYS)}
    sector = {"A": "x", "B": "x", "C": "?", "D": "?"}
    rows = {(r["symbol"], r["date"]): r for r in panel.collect()}
    assert set(rows) == {(s, d) for s in "ABCD" for d in days}

    def ret(f, k, n):
        return f(days[k]) / f(days[k - n]) - 1 if k >= n else None

    for s in "ABCD":
        for k, d in enumerate(days):
            own = lambda q, s=s: closes[s, q]
            r = rows[s, d]
            for n in (1, 5, 20):
                want = ret(own, k, n)
                assert (r[f"f_r{n}"] is None) == (want is None) and (want is None or abs(r[f"f_r{n}"] - want) < 1e-9)
            if k >= 20:
                peers = [ret(lambda q, p=p: closes[p, q], k, 20) for p in "ABCD" if sector[p] == sector[s]]
                assert abs(r["f_sec_rel20"] - (ret(own, k, 20) - np.mean(peers))) < 1e-9
                assert abs(r["f_rel20"] - (ret(own, k, 20) - ret(level.get, k, 20))) < 1e-9
            if k + 6 < len(days):
                own_y = closes[s, days[k + 6]] / closes[s, days[k + 1]]
                assert abs(r["y5"] - (own_y - level[days[k + 6]] / level[days[k + 1]])) < 1e-9
            else:
                assert r["y5"] is None


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(d, s, rng.choice([None, 1.0, 2.0, 2.5, -1.0]), None if d == 2 else rng.choice([0.0, 1.0]), rng.choice([None, 7.0])) for d in range(4) for s in range(9)]
    got = {(r.d, r.s): r for r in W.cs_rank(spark.createDataFrame(rows, "d int, s int, f_a double, f_b double, y double"), ["f_a", "f_b"], "d").collect()}
    assert len(got) == len(rows)
    for d, s, a, b, y in rows:
        for x, col in ((a, 2), (b, 3)):
            v = [r[col] for r in rows if r[0] == d and r[col] is not None]
            want = None if x is None else (sum(q < x for q in v) + (sum(q == x for q in v) + 1) / 2) / len(v)
            have = got[d, s]["r_a" if col == 2 else "r_b"]
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-12)
        assert got[d, s].y == y


def test_empty_panel(spark):
    assert W.cs_rank(spark.createDataFrame([], "date int, symbol int, f_a double"), ["f_a"]).count() == 0

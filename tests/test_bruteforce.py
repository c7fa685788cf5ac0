"""Operators that SQL cannot express, against plain loops on small random inputs."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import dedupe as D
from tidemark.operators import sentiment as S

VOCAB = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golf", "hotel", "india", "juliet"]
T0 = datetime(2024, 1, 1)


def clusters_by_loop(rows, hours=48):
    leaders, out = [], {}
    for i, ts, words in sorted(rows, key=lambda r: (r[1], r[0])):
        near = [l for l in leaders if (ts - l[1]).total_seconds() <= hours * 3600 and words and l[2]
                and len(set(words) & set(l[2])) / len(set(words) | set(l[2])) >= 0.6]
        if near:
            out[i] = [0.25, near[-1][0], 0]
            out[near[-1][0]][2] += 1
        else:
            leaders.append((i, ts, words))
            out[i] = [1.0, None, 0]
    return {k: tuple(v) for k, v in out.items()}


def run_clusters(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, ts timestamp, ntitle array<string>")
    return {r.id: (r.novelty, r.leader_id, r.confirm) for r in D.story_clusters(df, **kw).collect()}


@pytest.mark.parametrize("seed,peel", [(1, 2), (2, 0)])
def test_story_clusters(spark, seed, peel):
    rng = random.Random(seed)
    rows = [(i, T0 + timedelta(minutes=rng.randint(0, 15000)), sorted(rng.sample(VOCAB, rng.randint(0, 7)))) for i in range(200)]
    assert run_clusters(spark, rows, peel_rounds=peel) == clusters_by_loop(rows)


def test_story_clusters_when_a_third_are_near_copies(spark):
    """A template with one changed word each, exact copies, and hour-exact 48 h gaps."""
    rng = random.Random(3)
    rows = [(i, T0 + timedelta(minutes=7 * i), sorted(VOCAB[:8] + [f"word{i}"])) for i in range(120)]
    rows += [(1000 + i, T0 + timedelta(hours=24 * i), sorted(VOCAB[:5])) for i in range(12)]
    rows += [(2000 + i, T0 + timedelta(minutes=rng.randint(0, 5000)), sorted(rng.sample(VOCAB, 5))) for i in range(60)]
    assert run_clusters(spark, rows) == clusters_by_loop(rows)


def test_chains_of_leaders(spark):
    """One hot group with many rows at one time, sparse and dense groups, gaps of exactly the reach."""
    rng, width = random.Random(8), 1000
    rows = [(i, rng.choice([0, 5000, rng.randint(0, 60_000)]), "hot") for i in range(600)] + [(1000 + i, width * i, "exact") for i in range(40)]
    rows += [(2000 + i, rng.randint(0, 30_000), f"k{rng.randint(0, 30)}") for i in range(300)]
    want = set()
    for key in {r[2] for r in rows}:
        last = None
        for t, i in sorted((t, i) for i, t, k in rows if k == key):
            if last is None or t > last + width:
                want.add(i)
                last = t
    df = spark.createDataFrame(rows, "id long, t long, key string")
    assert {r.id for r in D.chain_leaders(df, width).collect()} == want


@pytest.mark.parametrize("days", [30, 300])
def test_rounds_grow_with_the_logarithm_of_the_span(spark, caplog, days):
    """A title that returns every day, with and without one changed word, and never leaves the index."""
    rows = [(i, T0 + timedelta(hours=24 * i, minutes=i % 7), VOCAB[:6] if i % 3 else VOCAB[:7]) for i in range(days)]
    with caplog.at_level("INFO", logger="tidemark.operators.dedupe"):
        assert run_clusters(spark, rows) == clusters_by_loop(rows)
    chains, partly = (int(re.search(r"(\d+) rounds", r.getMessage())[1]) for r in caplog.records[-2:])
    assert partly == 0 and chains <= math.ceil(math.log2(days / 2)) + 1


def test_fuzzy_title_dedupe(spark):
    rng = random.Random(5)
    base = ["Oil prices rise on supply fears", "Fed holds rates steady again", "Chip maker beats forecasts", "Bank sues regulator over fine", "x", "ab"]
    rows = []
    for i in range(150):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(b)) if b else 0
            if b and rng.random() < 0.5:
                b[k] = rng.choice("abcdefghij")
            elif len(b) > 1:
                del b[k]
        rows.append((i, "".join(b), i))
    recent = ["Oil prices rise on supply fears!", "Chip makers beats forecast"]
    got = {r.id for r in D.fuzzy_title_dedupe(spark.createDataFrame(rows, "id long, title string, ordinal long"),
                                              spark.createDataFrame([(t,) for t in recent], "title string")).collect()}
    kept, want = list(recent), set()
    for i, t, _ in rows:
        if not any(X._ratio(t, k) > 85 for k in kept):
            kept.append(t)
            want.add(i)
    assert got == want


def test_title_ratio_matches_dynamic_programming():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert X._lcs_length(a, b) == lcs(a, b)


def test_correlated_articles_with_a_hot_ticker(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        tags = (["HOT"] if i % 3 == 0 else []) + rng.sample(["AA", "BB", "CC", "DD", " aa ", "CEO"], rng.randint(0, 3))
        rows.append((i, T0 + timedelta(minutes=rng.randint(0, 5000)), tags, None if i % 5 else ["EE", "AA"]))
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, "id long, published_at timestamp, tickers_raw array<string>, ai_affected_tickers array<string>")
    got = {r.id: r.ai_correlated_article_ids for r in D.correlated_articles(df, now).collect()}
    since = datetime(2024, 1, 3, 12) - timedelta(hours=72)
    by, ts = {}, {r[0]: r[1] for r in rows}
    for i, t, raw, ai in rows:
        if t >= since:
            for tag in {x.strip().upper() for x in (ai or raw)} - {"CEO"}:
                by.setdefault(tag, set()).add(i)
    want = {}
    for ids in by.values():
        if len(ids) > 1:
            for i in ids:
                want.setdefault(i, set()).update(ids - {i})
    assert got == {i: sorted(o, key=lambda x: (-ts[x].timestamp(), x))[:20] for i, o in want.items()}


def test_index_and_attention_on_exact_hours(spark):
    """Items on and around the hour: both window ends are closed."""
    rng = random.Random(6)
    rows = []
    for i in range(250):
        ts = T0 + timedelta(hours=rng.randint(0, 120)) + rng.choice([timedelta(0), timedelta(0), timedelta(microseconds=1), timedelta(minutes=rng.randint(1, 59))])
        rows.append((i, ts, rng.choice("AB"), rng.choice([0.5, 1.0]), 1.0, 1.2, rng.choice([0.25, 1.0]), rng.randint(0, 6), rng.choice([None, rng.uniform(-1, 1)])))
    df = spark.createDataFrame(rows, "id long, ts timestamp, symbol string, rel double, src_w double, event_w double, novelty double, confirm int, lex double")
    start, end = T0 + timedelta(hours=30), T0 + timedelta(hours=130)
    at = lambda t: F.lit(str(t)).cast("timestamp")
    idx = S.sentiment_index(df, at(start), at(end), ["lex"])
    got = {(r.symbol, r.ts): (r.idx, r.n_lead, r.wsum) for r in idx.collect()}
    want, t = {}, start
    while t <= end:
        for sym in "AB":
            num = den = lead = 0
            for _, ts, s, rel, sw, ew, nov, conf, sc in rows:
                if s == sym and sc is not None and t - timedelta(hours=48) <= ts <= t:
                    age = (t - ts).total_seconds() / 3600
                    w = sw * ew * rel * nov * (1 + min(conf, 4) * 0.1) * 0.5 ** (age / 12)
                    num, den = num + w * sc, den + w
                    lead += nov == 1.0 and age <= 24
            if den:
                want[(sym, t)] = (num / den, lead, den)
        t += timedelta(hours=1)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][1] == v[1] and got[k][0] == pytest.approx(v[0]) and got[k][2] == pytest.approx(v[2])
    att = {(r.symbol, r.ts): (r.att_n, r.att_z) for r in S.attention(df, idx.select("symbol", "ts").distinct()).collect()}
    for sym, t in want:
        lead = [ts for _, ts, s, *rest in rows if s == sym and rest[3] == 1.0]
        n = sum(t - timedelta(hours=6) <= x <= t for x in lead)
        lam = sum(t - timedelta(days=14) <= x < t - timedelta(hours=6) for x in lead) / 330 * 6
        assert att[(sym, t)][0] == n and att[(sym, t)][1] == pytest.approx((n - lam) / math.sqrt(lam + 1))
    one = {r.symbol: (r.idx, r.n_lead) for r in S.sentiment_index_at(df, at(start), ["lex"]).collect()}
    assert one == {s: (pytest.approx(want[(s, start)][0]), want[(s, start)][1]) for s in "AB" if (s, start) in want}


def test_alert_cooldown(spark):
    rng = random.Random(8)
    rows = [(T0 + timedelta(hours=h), s, "ens", rng.uniform(-1, 1), rng.choice([None, 2.0, -2.5, 1.0]), rng.choice([3, 4, 9])) for s in ("NVDA", "OIL", "ZZZ") for h in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, model string, idx double, z double, n_lead int")
    got = {(r.symbol, r.ts) for r in S.zscore_alerts(df).collect()}
    want, last = set(), {}
    for ts, s, _, _, z, n in rows:
        if s != "ZZZ" and z is not None and abs(z) >= 2 and n >= 4 and (s not in last or ts - last[s] >= timedelta(hours=6)):
            last[s] = ts
            want.add((s, ts))
    assert got == want


def test_average_ranks(spark):
    from tidemark.operators.evaluate import average_ranks
    rng = random.Random(7)
    rows = [(g, float(rng.choice(range(9 if g == "a" else 400)))) for g in "ab" for _ in range(300)]
    got = average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "r", splits=8).collect()
    for r in got:
        vs = [v for g, v in rows if g == r.g]
        assert r.r == sum(v < r.v for v in vs) + (sum(v == r.v for v in vs) + 1) / 2

"""Running sums instead of moving frames, and exact quantiles from buckets, against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from tidemark.operators import evaluate as E
from tidemark.operators import sentiment as S

T0 = datetime(2024, 1, 1)


def test_rolling_zscore_against_a_loop(spark):
    """Gaps, nulls, equal times, a constant stretch behind a wild one, and a value exactly at the window's edge."""
    rng = random.Random(4)
    rows = [(T0 + timedelta(hours=h), "A", "m", rng.uniform(-1, 1) if h < 600 else 0.25) for h in range(1200) if rng.random() < 0.9]
    rows += [(T0 + timedelta(minutes=rng.randint(0, 60_000)), "B", "m", rng.choice([None, rng.gauss(0, 1)])) for _ in range(400)]
    rows += [(T0 + timedelta(hours=h), "B", "n", 100.0 + h % 3) for h in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, model string, idx double")
    got = S.rolling_zscore(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "specifiedwindowframe(RangeFrame" not in plan and got.columns == ["ts", "symbol", "model", "idx", "z"]
    out = {}
    for r in got.collect():
        out.setdefault((r.ts, r.symbol, r.model, r.idx), []).append(r.z)
    assert sum(map(len, out.values())) == len(rows)
    for ts, s, m, x in rows:
        v = [q for t, s2, m2, q in rows if (s2, m2) == (s, m) and q is not None and ts - timedelta(days=14) <= t < ts]
        want = (x - np.mean(v)) / np.std(v) if x is not None and len(v) >= 20 and np.std(v) > 1e-6 else None
        for z in out[ts, s, m, x]:
            assert (z is None) == (want is None) and (z is None or abs(z - want) < 1e-6 * max(1, abs(want))), (ts, s, m, z, want)


def test_attention_has_no_moving_frame(spark, inputs):
    items = inputs["fx_items"]
    att = S.attention(items, items.select("symbol", "ts").distinct())
    assert "RangeFrame, -" not in att._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("splits", [3, 64])
def test_exact_quantiles(spark, splits):
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.5])) for _ in range(5000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("ties", 4.0), ("ties", 4.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = E.exact_quantiles(df, ["g"], "x", [1 / 3, 2 / 3, 1.0], "q", splits)
    assert "percentile(" not in q._jdf.queryExecution().toString()
    for g, got in ((r.g, r.q) for r in q.collect()):
        assert np.allclose(got, np.quantile([x for k, x in rows if k == g], [1 / 3, 2 / 3, 1.0]), atol=1e-12)
    assert {r.g for r in q.collect()} == {"hot", "one", "two", "ties"}

"""Boosted trees against an independent small boosting in numpy."""

import datetime as dt

import numpy as np

from tidemark.operators import lab


def best_split(x, y, rows, leaf):
    """(loss fall, feature, border) of the best cut of ``rows``, or None."""
    found = None
    for j in range(x.shape[1]):
        order = rows[np.argsort(x[rows, j], kind="stable")]
        v, total = x[order, j], np.cumsum(y[order])
        n, k = len(order), np.arange(1, len(order))
        fall = total[:-1] ** 2 / k + (total[-1] - total[:-1]) ** 2 / (n - k) - total[-1] ** 2 / n
        fall[(v[1:] == v[:-1]) | (k < leaf) | (n - k < leaf)] = -1
        if len(fall) and fall.max() > 1e-12 and (found is None or fall.max() > found[0]):
            at = int(fall.argmax())
            found = fall[at], j, (v[at] + v[at + 1]) / 2
    return found


def tree(x, y, at, depth, leaf):
    """Predictions at ``at`` of one regression tree on (x, y)."""
    out = np.zeros(len(at))

    def grow(rows, asked, depth):
        cut = best_split(x, y, rows, leaf) if depth else None
        if cut is None:
            out[asked] = y[rows].mean()
            return
        _, j, border = cut
        grow(rows[x[rows, j] <= border], asked[at[asked, j] <= border], depth - 1)
        grow(rows[x[rows, j] > border], asked[at[asked, j] > border], depth - 1)

    grow(np.arange(len(x)), np.arange(len(at)), depth)
    return out


def boosting(x, y, at, rounds, depth, rate, leaf):
    """A first whole tree, then trees on twice the residual, scaled by the rate."""
    both = np.concatenate([x, at])
    f = tree(x, y, both, depth, leaf)
    for _ in range(rounds - 1):
        f = f + rate * tree(x, 2 * (y - f[:len(x)]), both, depth, leaf)
    return f[len(x):]


def ranks(v):
    return np.argsort(np.argsort(v, kind="stable"), kind="stable")


def test_trees_rank_as_an_independent_boosting(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((900, len(lab.RANKED))), 1)
    y = np.where(x[:, 0] > 0.5, x[:, 1], 1 - x[:, 2]) + 0.3 * x[:, 3] + rng.normal(0, 0.1, len(x))
    day = dt.date(2024, 1, 2)
    rows = [(day, f"S{i:03d}", float(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "date date, symbol string, y_rank double, " + ", ".join(f"{c} double" for c in lab.RANKED)).coalesce(2)
    model = lab.fit_gbt(df.where("symbol < 'S600'"), rounds=25, min_leaf=20)
    assert model.getNumTrees == 25
    got = {r["symbol"]: r["score"] for r in lab.predict_gbt(model, df.where("symbol >= 'S600'")).collect()}
    want = boosting(x[:600], y[:600], x[600:], 25, 3, 0.05, 20)
    assert len(got) == 300
    assert np.corrcoef(ranks([got[f"S{i:03d}"] for i in range(600, 900)]), ranks(want))[0, 1] > 0.95

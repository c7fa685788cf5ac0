"""Every registered query: values against its SQL, and the shape of its plan."""

import contextlib
import io

import pytest
from compare import compare

from tidemark.catalog import load
from tidemark.catalog.core import RUN, SQL

load()
EAGER = {"walk_forward"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, inputs, duck):
    assert compare(name, RUN[name](inputs), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL) - EAGER))
def test_runs(name, inputs):
    assert RUN[name](inputs).count() > 0


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["symbols_of", "unusual_symbols", "window_return", "correlated_articles", "near_duplicate_titles", "cs_rank", "settle_positions", "match_keywords",
                                  "dedupe_url_merge", "ticker_page", "signal_leaderboard"])
def test_plan_has_no_slow_operator(name, inputs):
    plan = plan_of(RUN[name](inputs))
    for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(inputs):
    plan = plan_of(RUN["read_table"](inputs))
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_time_filters_reach_the_scan(spark, inputs):
    from tidemark.catalog.core import moment
    from pyspark.sql import functions as F
    plan = plan_of(inputs["events"].where(F.col("ts") >= moment("2024-01-20 00:00:00")).select("event_id"))
    assert "GreaterThanOrEqual(ts" in plan


def test_hot_key_folds_before_the_shuffle(inputs):
    plan = plan_of(RUN["dedupe_url_merge"](inputs))
    assert plan.index("min_by") < plan.index("Exchange") or "partial_min_by" in plan


def test_walk_forward_ranks_the_trees(spark):
    """Rule books agree with the checked rule query; the trees' row is there with as many days."""
    from tidemark.catalog.core import Inputs
    larger = Inputs(spark, "/root/testdata/sf0.01")
    rows = {r["book"]: r for r in RUN["walk_forward"](larger).collect()}
    rules = {r["book"]: r for r in RUN["walk_forward_rules"](larger).collect()}
    assert set(rows) == set(rules) | {"gbt"} and all(rows[b] == rules[b] for b in rules)


def test_walk_forward_fits_all_rounds(spark, monkeypatch):
    """The registered query asks for the operator's own rounds, depth and rate; the fits themselves are cut short here."""
    import inspect

    from tidemark.catalog.core import Inputs
    from tidemark.operators import lab
    fit, asked = lab.fit_gbt, []

    def short(train, **options):
        bound = inspect.signature(fit).bind(train, **options)
        bound.apply_defaults()
        asked.append(tuple(bound.arguments[k] for k in ("rounds", "depth", "rate")))
        return fit(train, **options | {"rounds": 1})

    monkeypatch.setattr(lab, "fit_gbt", short)
    RUN["walk_forward"](Inputs(spark, "/root/testdata/sf0.01")).collect()
    assert asked and set(asked) == {(150, 3, 0.05)}

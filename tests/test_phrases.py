"""Dictionaries as tables: the index against plain search, odd phrases, copies, clashing columns, fifty thousand names."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import articles as A
from tidemark.operators import phrases as P
from tidemark.operators.scoring import company_dictionary, link_symbols
from tidemark.catalog.text_queries import LINK_UNIVERSE, NAMES, PATTERNS

TEXTS = [None, "", "a", "abc", "ab|c (d) \\E x", "Über-Straße 中文 \U0001f600\U0001f600 x", "aaaaaa", "line\nbreak here", "abcabc" * 40, "Theand thble And", "x", "copy of one", "copy of one", "copy of one"]
PHRASES = ["", None, "a", "ab", "abc", "|c (", "\\E", "aaaa", "\U0001f600", "中文", "break", "e\nb", "missing phrase", "copy of one", "copy of one and more", "Straße 中", "abcab", "x"]


def test_contained_against_plain_search(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, t string, run string")
    ph = spark.createDataFrame([(p, f"v{k % 3}") for k, p in enumerate(PHRASES)], "phrase string, value string")
    got = {r.id: [x.phrase for x in r.out] for r in P.with_contained(df, F.col("t"), ph, "out").collect()}
    assert got == {k: sorted((p for p in PHRASES if p and t and p in t), key=lambda p: (-len(p), p)) for k, t, _ in rows}


def test_no_phrases_and_no_texts(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    none = spark.createDataFrame([], "phrase string, value string")
    assert P.with_contained(df, F.col("t"), none, "out").first().out == []
    assert P.with_contained(df.where("false"), F.col("t"), spark.createDataFrame([("a", "b")], "phrase string, value string"), "out").count() == 0


def test_first_matches_are_leftmost_and_longest(spark):
    found = F.transform(F.array(*map(F.lit, ["a.b+c", "a.b", "b+cd", "(x)"])), lambda p: F.struct(p.alias("phrase"), F.lit("").alias("value")))
    df = spark.range(1).select(P.first_matches(F.lit("zz a.b+cd (x) aXb a.b"), found).alias("m"), P.first_matches(F.lit("x"), F.slice(found, 1, 0)).alias("n"))
    assert df.first().m == ["a.b+c", "(x)", "a.b"] and df.first().n == []


def test_tables_link_as_literals_do(spark, inputs):
    a = inputs["fx_articles"].select("id", "title", "summary_raw", "tickers_raw")
    names = spark.createDataFrame([(s, n) for n, s in NAMES.items()], "symbol string, name string")
    universe = spark.createDataFrame([(s,) for s in LINK_UNIVERSE], "symbol string")
    plain = {r.id: r.syms for r in link_symbols(a, NAMES, PATTERNS, LINK_UNIVERSE).select("id", "syms").collect()}
    assert {r.id: r.syms for r in link_symbols(a, names, PATTERNS, universe).select("id", "syms").collect()} == plain
    assert {r.id: set(r.syms) for r in link_symbols(a, None, {}, universe).collect()} == {r.id: set(r.syms) for r in link_symbols(a, None, {}, LINK_UNIVERSE).collect()}


def test_fifty_thousand_names_and_keywords(spark, inputs):
    """A dictionary far beyond a plan's literals, straight from the cleaning step."""
    rng = random.Random(2)
    texts = {r.id: (r.title or "", r.summary_raw or "") for r in inputs["fx_articles"].select("id", "title", "summary_raw").collect()}
    words = [w for t in texts.values() for w in t[1].split()[:40]]
    real = {f"{rng.choice(words)} {rng.choice(words)}" for _ in range(300)} | {" ".join(t[1].split()[k:k + 2]) for t in texts.values() for k in (3, 9)}
    rows = [(f"N{k}", n + " Inc.") for k, n in enumerate(sorted(real))] + [(f"X{k}", f"Firm {k:05d} Holdings") for k in range(50_000)]
    names = company_dictionary(spark.createDataFrame(rows, "symbol string, name string"))
    kept = {r.name for r in names.collect()}
    got = {r.id: r.names for r in P.with_contained(inputs["fx_articles"], F.concat_ws("\n", "title", "summary_raw"), names.selectExpr("name AS phrase", "symbol AS value"), "f")
           .select("id", F.col("f.phrase").alias("names")).collect()}
    assert {i: set(n) for i, n in got.items()} == {i: {n for n in kept if n in "\n".join(t)} for i, t in texts.items()} and any(got.values())
    watch = spark.createDataFrame([(f"W{k % 900}", n.lower()) for k, n in enumerate(sorted(kept))] + [("TAG", "nvda"), ("W1", None)], "symbol string, keyword string")
    hits = A.match_keywords(inputs["fx_articles"], watch)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r.id for r in hits.where("symbol = 'TAG'").collect()} == {r.id for r in A.match_keywords(inputs["fx_articles"], {"TAG": ["nvda"]}).collect()}

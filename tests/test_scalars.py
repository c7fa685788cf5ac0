"""Hand-computed values of the scalar expressions."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions import text as X

L = F.lit
NULL = lambda: L(None).cast("string")


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).collect()[0].v


@pytest.mark.parametrize("text,expected", [("profit beats", math.tanh(1)), ("not a strong quarter", math.tanh(-1 / math.sqrt(3))), ("", 0.0), ("no one two three strong", math.tanh(1 / math.sqrt(3))),
                                           ("never one two strong", math.tanh(-1 / math.sqrt(3))), ("without loss", math.tanh(1 / math.sqrt(3)))])
def test_lexicon_score(value, text, expected):
    assert value(X.lexicon_score(L(text))) == pytest.approx(expected)


@pytest.mark.parametrize("text,event", [("raises full-year guidance after earnings", ("guidance", 1.6)), ("Acme to buy Beta Corp for $3bn", ("m&a", 1.4)), ("NVDA filed 10-Q", ("filing", 1.3)),
                                        ("FTC probes merger", ("m&a", 1.4)), ("SEC charges broker", ("legal_reg", 1.2)), ("quiet day", ("other", 0.8)), ("Fine", ("legal_reg", 1.2))])
def test_event_of(value, text, event):
    assert tuple(value(X.event_of(L(text)))) == event


def test_source_weight(value):
    assert value(X.source_weight(L("SEC EDGAR"))) == 1.3
    assert value(X.source_weight(NULL())) == 0.8
    assert value(X.source_weight(L("Seeking Alpha"))) == 0.7


def test_numeric_impact(value):
    assert value(X.numeric_impact(L("up +34% and -$500M"))) == 0.0
    assert value(X.numeric_impact(L("up +34% then 5%"))) == 0.5
    assert value(X.numeric_impact(NULL())) == 0.0


def test_decode_items(value):
    assert value(X.decode_items(L("items 7.01 and 9.01"))) == "Regulation FD Disclosure, Financial Statements/Exhibits"
    assert value(X.decode_items(L("item 6.66, 6.66"))) == "6.66"
    assert value(X.decode_items(L("none"))) == "none"


def test_tickers(value):
    assert value(X.extract_tickers(L("Nvidia and the FED"))) == ["NVDA"]
    assert value(X.extract_tickers(L("TAIWAN SEMICONDUCTOR beats ABC, metal"))) == ["ABC", "TSM"]  # longer capitals are not tickers
    assert value(X.extract_tickers(NULL())) == []
    assert value(X.tickers_in(L("$NVDA (NYSE: BRK.B) $ZZ"), ["NVDA", "BRK-B"])) == ["BRK-B", "NVDA"]


def test_symbol_links(spark):
    c = X.symbol_candidates(L("Apple and Arm Holdings lead, $TSLA"), L("nvidia wins; Acme Corp too; apple pie"), F.array(L("NVDA"), L("ZZ")), names={"Acme Corp": "ACM", "Acme": "ACX"})
    got = spark.range(1).select(c.alias("c")).select(X.best_links(F.col("c")).alias("m")).collect()[0].m
    assert got == {"AAPL": 1.0, "ARM": 1.0, "TSLA": 1.0, "NVDA": 0.8, "ACM": 0.5}


def test_resolve_symbol(value):
    assert value(X.resolve_symbol(L("US 10-year yield"), NULL())) == "^TNX"
    assert value(X.resolve_symbol(L("oil"), L(" X "))) == "X"
    assert value(X.resolve_symbol(L("nothing"), L(""))) is None


def test_jaccard_and_title_tokens(value):
    a, b = F.array(L("x"), L("y")), F.array(L("y"), L("z"))
    assert value(X.jaccard(a, b)) == pytest.approx(1 / 3)
    assert value(X.jaccard(F.array().cast("array<string>"), a)) == 0.0
    assert value(X.title_tokens(L("The Banks' banks' rally, rally a lot"))) == ["banks'", "rally"]


def test_title_ratio(value):
    assert value(X.title_ratio(L("kitten"), L("sitting"))) == pytest.approx(200 * 4 / 13)
    assert value(X.title_ratio(L("same"), L("same"))) == 100.0


def test_spam_and_language(value):
    assert value(X.is_spam(L("Last chance: 20 percent"), NULL())) is True
    assert value(X.is_spam(L("now 20% off"), L(""))) is True
    assert value(X.is_spam(L("hurrying"), L(""))) is False
    assert value(X.lang_tag(L("Αγορά"))) == "el"


def test_main_text(value):
    body = "word " * 60
    html = f"<html><head><title>t</title></head><body><nav>menu</nav><script>x()</script><p>{body}</p><p>a &amp; b</p></body></html>"
    assert value(X.main_text(L(html))) == body.strip() + "\na & b"
    assert value(X.main_text(L("<p>short</p>"))) is None


def test_dates(value):
    for text in ("Tue, 02 Jan 2024 10:11:12 GMT", "2024-01-02T10:11:12Z", "2024-01-02T12:11:12+02:00"):
        assert value(X.parse_feed_date(L(text))) == datetime(2024, 1, 2, 10, 11, 12)
    assert value(X.parse_published(L("junk"), NULL(), now=L("2024-05-05 00:00:00").cast("timestamp"))) == datetime(2024, 5, 5)


@pytest.mark.parametrize("conf,bucket", [(None, "Unknown"), (39, "Low (0-39)"), (40, "Medium (40-69)"), (69, "Medium (40-69)"), (70, "High (70-100)")])
def test_confidence_bucket(value, conf, bucket):
    assert value(S.confidence_bucket(L(conf).cast("int"))) == bucket


@pytest.mark.parametrize("call,ret,expected", [("bullish", 0.49, "unclear"), ("bearish", -0.5, "correct"), ("neutral", 9.0, "unclear"), ("bullish", -2.0, "incorrect")])
def test_verdict(value, call, ret, expected):
    assert value(S.verdict(L(call), L(ret))) == expected


def test_wilson(value):
    assert tuple(value(S.wilson(L(0), L(0)))) == (0.0, 0.0)
    lo, hi = value(S.wilson(L(3), L(4)))
    assert (round(lo, 3), round(hi, 3)) == (0.301, 0.954)


@pytest.mark.parametrize("symbol,at,day", [("NVDA", "2024-01-05 20:59:00", date(2024, 1, 4)), ("NVDA", "2024-01-05 21:00:00", date(2024, 1, 5)), ("X.DE", "2024-01-05 16:00:00", date(2024, 1, 5))])
def test_entry_day(value, symbol, at, day):
    assert value(S.entry_day(L(symbol), L(at).cast("timestamp"))) == day


def test_p_value(value):
    for t in (0.0, 0.5, 1.96, 4.0):
        assert value(S.two_sided_p(L(t))) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=5e-7)


def test_required_words():
    assert X.required_words(r"\bfed\b|rate (hike|cut)|expects? x") == ["fed", "rate ", "expect"]
    assert X.required_words(r"(a|b)") is None
    assert X.lower_pattern(r"10-[KQ]\W\bA") == r"10-[kq]\W\ba"


def test_prefilter_changes_nothing(spark):
    from tidemark import lookups as K
    import re
    texts = ["Fed holds", "RATE CUT soon", "rates cut", "Meta", "meta", "META PLATFORMS", "S&P 500 up", "goog", "googling", "10-Year Yield", "Intel", "intel", "strait of hormuz", "Barr speaks", "barrel"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [X.any_case(F.col("t"), F.lower("t"), p).alias(s) for s, p in K.SYMBOL_PATTERNS.items()]
    for row in df.select("t", *cols).collect():
        for s, p in K.SYMBOL_PATTERNS.items():
            assert row[s] == bool(re.search(p, row.t, re.I)), (row.t, s)


def test_required_words_of_groups_that_may_be_absent(value):
    for pattern in ("(?-i:US )?dollar", "(?-i:US )*dollar", "(?-i:US ){0,1}dollar", "(?-i:US |UK )dollar", r"oil|(?-i:US \(x\) )?dollar"):
        assert X.required_words(pattern) is None
    assert X.required_words("(?-i:US )dollar") == ["us "] and X.required_words("(?-i:US dollar)") == ["us dollar"]
    assert value(X.any_case(L("the dollar"), L("the dollar"), "(?-i:US )?dollar"))

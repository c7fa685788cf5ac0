"""Text expressions: Column in, Column out, all built-in functions except :func:`title_ratio` and the word filter of :func:`event_of`."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lookups as K

ANY_CASE = "(?iu)"


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _first_hit(cases, default) -> Column:
    """CASE chain over ordered (condition, value) pairs."""
    (c0, v0), *rest = cases
    return reduce(lambda acc, cv: acc.when(cv[0], cv[1]), rest, F.when(c0, v0)).otherwise(default)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def with_value(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(c), lambda x: body(x)), 1)


def lower_pattern(pattern: str) -> str:
    """The pattern in lower case, escapes such as \\W left alone."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def _group_may_be_absent(alt: str) -> bool:
    """Whether the group that opens an alternative can match without its first literal: it is quantified or holds alternatives itself."""
    depth = 0
    for m in re.finditer(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()|]", alt):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[0] == "|" and depth == 1:
            return True
        if depth == 0:
            return alt[m.end():m.end() + 1] in ("?", "*", "{")
    return False


def required_words(pattern: str) -> list[str] | None:
    """One lower-case literal per top-level alternative without which it cannot match; None if some has no such literal."""
    out, depth, start, alts = [], 0, 0, []
    for k, ch in enumerate(pattern + "|"):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            alts.append(pattern[start:k])
            start = k + 1
    for alt in alts:
        head = re.match(r"(?:\(\?-i:)?(?:\\b)?([A-Za-z0-9&' -]+)([?*{])?", alt)  # the last character may be absent under any of these quantifiers
        word = (head[1][:-1] if head[2] else head[1]) if head else ""
        if len(word) < 2 or (alt[0] == "(" and _group_may_be_absent(alt)):
            return None
        out.append(word.lower())
    return out


def any_case(text: Column, lowered: Column, pattern: str) -> Column:
    """Case-insensitive search. Plain patterns run on the lowered text, and only where a needed literal occurs at all:
    a substring scan rejects most texts many times faster than an alternation tried at every character."""
    hit = text.rlike(ANY_CASE + pattern) if "(?-i:" in pattern else lowered.rlike(lower_pattern(pattern))
    words = required_words(pattern)
    return reduce(lambda x, y: x | y, [lowered.contains(w) for w in words]) & hit if words else hit


def needed_words_in(lowered: Column, patterns: list[str]) -> Column:
    """For each pattern, whether any of its :func:`required_words` occurs (true if it has none), as an array; null for a text where no pattern can match.

    The words of all patterns are one automaton, so a text is scanned once however many they are; only texts with some word are scanned by pattern.
    """
    words = [required_words(p) for p in patterns]
    each = ["|".join(map(re.escape, w)) if w else None for w in words]

    @F.arrow_udf("array<boolean>")
    def scan(texts: pa.Array) -> pa.Array:
        if None in each:
            some = np.ones(len(texts), bool)
        else:
            some = pc.match_substring_regex(texts, "|".join(each)).to_numpy(zero_copy_only=False).astype(bool)
        held = texts.filter(pa.array(some))
        cols = [[True] * len(held) if rx is None else pc.match_substring_regex(held, rx).to_pylist() for rx in each]
        rows = iter(zip(*cols))
        return pa.array([list(next(rows)) if x else None for x in some], pa.list_(pa.bool_()))

    return scan(lowered)


def is_spam(title: Column, summary: Column) -> Column:
    return F.concat_ws(" ", text_or_empty(title), text_or_empty(summary)).rlike(ANY_CASE + K.SPAM)


def best_text(full_text: Column, summary: Column, max_chars: int | None = None) -> Column:
    """Full text unless it is null or empty, else the summary."""
    t = F.coalesce(F.nullif(full_text, F.lit("")), F.nullif(summary, F.lit("")))
    return F.substring(t, 1, max_chars) if max_chars else t


def lang_tag(title: Column) -> Column:
    return F.when(title.rlike(K.GREEK), "el").otherwise("en")


def about_holding(title: Column, tickers: Column, aliases: dict[str, str] | None = None) -> Column:
    """True if the headline itself names one of the tagged holdings."""
    aliases = aliases or K.HOLDING_ALIASES
    hits = [F.coalesce(F.array_contains(tickers, s), F.lit(False)) & text_or_empty(title).rlike(ANY_CASE + p)
            for s, p in aliases.items()]
    return reduce(lambda a, b: a | b, hits)


def alternation(names) -> str:
    """One regex group over literal names, longest first so that the longest name wins; a lookahead for the possible
    first characters spares most positions the walk through all names."""
    special = set(r"\.^$|?*+()[]{}&-")
    quoted = ["".join("\\" + ch if ch in special else ch for ch in n) for n in sorted(names, key=lambda n: (-len(n), n))]
    first = "".join(sorted({n[0] if n[0] not in special else "\\" + n[0] for n in names}))
    return f"(?=[{first}])(" + "|".join(quoted) + ")"


def _map_lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def extract_tickers(text: Column) -> Column:
    """Bare upper-case words minus stop words, plus company aliases in any case; sorted and distinct."""
    text = text_or_empty(text)
    bare = F.array_except(F.regexp_extract_all(text, F.lit(K.UPPER_TICKER), F.lit(1)), _lit_array(K.TICKER_STOPWORDS))
    rx = r"(?iu)\b" + alternation(K.COMPANY_ALIASES) + r"\b"
    aliases = _map_lookup(K.COMPANY_ALIASES)
    named = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda m: F.element_at(aliases, F.lower(m)))
    return F.array_sort(F.array_union(bare, named))


def tickers_in(text: Column, universe: list[str]) -> Column:
    """Cashtags and exchange tags that are in the universe."""
    text = text_or_empty(text)
    cash = F.regexp_extract_all(text, F.lit(K.CASHTAG), F.lit(1))
    tags = F.transform(F.regexp_extract_all(text, F.lit(K.EXCHANGE_TAG), F.lit(1)), lambda t: F.replace(t, F.lit("."), F.lit("-")))
    return F.array_sort(F.array_intersect(F.array_union(cash, tags), _lit_array(universe)))


def symbol_candidates(title: Column, summary: Column, tickers: Column, names: dict[str, str] | None = None,
                      patterns: dict[str, str] | None = None, universe: list[str] | None = None) -> Column:
    """All (symbol, rel) links of an article, before taking the best per symbol.

    rel is 1.0 for a title hit, 0.5 for a summary hit, 0.9 for a cashtag and 0.8 for a feed tag.
    """
    patterns = K.SYMBOL_PATTERNS if patterns is None else patterns
    names = names or {}
    universe = sorted(set(universe or []) | set(patterns) | set(names.values()))
    title, summary = text_or_empty(title), text_or_empty(summary)
    link = lambda s, r: F.struct(s.alias("symbol"), r.alias("rel"))
    hits = lambda t, rel: F.array_compact(with_value(F.struct(t.alias("t"), F.lower(t).alias("l")), lambda x: F.array(*[
        F.when(any_case(x["t"], x["l"], p), link(F.lit(s), F.lit(rel))) for s, p in patterns.items()])))
    parts = [hits(title, 1.0), hits(summary, 0.5)] if patterns else []
    if names:
        rx, to_symbol = alternation(names), _map_lookup(names)
        named = lambda rel: (lambda m: link(F.element_at(to_symbol, m), F.lit(rel)))
        for col, rel in ((title, 1.0), (summary, 0.5)):
            parts.append(F.transform(F.array_distinct(F.regexp_extract_all(col, F.lit(rx), F.lit(1))), named(rel)))
    known = _lit_array(universe)
    cash = F.regexp_extract_all(F.concat_ws(" ", title, summary), F.lit(K.CASHTAG_LOOSE), F.lit(1))
    parts.append(F.transform(F.array_intersect(cash, known), lambda s: link(s, F.lit(0.9))))
    tagged = F.coalesce(tickers, F.array().cast("array<string>"))
    parts.append(F.transform(F.array_intersect(tagged, known), lambda s: link(s, F.lit(0.8))))
    return F.concat(*parts)


def best_links(candidates: Column) -> Column:
    """Map symbol -> highest rel. Pass a materialised column: the expression reads it twice."""
    keys = F.array_sort(F.array_distinct(F.transform(candidates, lambda x: x["symbol"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(
        F.transform(F.filter(candidates, lambda x: x["symbol"] == k), lambda x: x["rel"]))))


def event_of(text: Column) -> Column:
    """First matching event class as struct(event, event_w)."""
    text = text_or_empty(text)
    pair = lambda n, w: F.struct(F.lit(n).alias("event"), F.lit(w).alias("event_w"))
    held = needed_words_in(F.lower(text), [p for _, _, p in K.EVENTS])
    first = with_value(F.struct(F.lower(text).alias("t"), held.alias("held")), lambda x: _first_hit(
        [(x["held"][k] & x["t"].rlike(lower_pattern(p)), pair(n, w)) for k, (n, w, p) in enumerate(K.EVENTS)], pair(*K.OTHER_EVENT)))
    return F.when(held.isNotNull(), first).otherwise(pair(*K.OTHER_EVENT))


def source_weight(source: Column) -> Column:
    s = F.lower(text_or_empty(source))
    return _first_hit([(s.contains(k), F.lit(w)) for k, w in K.SOURCE_WEIGHTS], F.lit(K.DEFAULT_SOURCE_WEIGHT))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(K.WORD), F.lit(1))


def lexicon_score(text: Column, positive=None, negative=None, negators=None) -> Column:
    """:func:`lexicon_score_of` over a text."""
    return lexicon_score_of(tokenize(text), positive, negative, negators)


def lexicon_score_of(tokens: Column, positive=None, negative=None, negators=None) -> Column:
    """tanh((p-n)/sqrt(p+n+2)) where a negator in the three words before flips a sentiment word.

    Words that matter are picked out with their positions first; one fold over these few remembers the last negator.
    """
    positive, negative = list(positive or K.POSITIVE), list(negative or K.NEGATIVE)
    negators = list(negators or K.NEGATORS)
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(-9).alias("last"))
    cue = F.array_compact(F.transform(tokens, lambda t, i: F.when(
        t.isin(positive + negative + negators), F.struct(t.alias("t"), i.alias("i")))))

    def step(a, x):
        t, near = x["t"], x["i"] - a["last"] <= 3
        good, bad = t.isin(positive), ~t.isin(positive) & t.isin(negative)
        up = (good & ~near) | (bad & near)
        return F.struct((a["p"] + up.cast("int")).alias("p"), (a["n"] + ((good | bad) & ~up).cast("int")).alias("n"),
                        F.when(t.isin(negators), x["i"]).otherwise(a["last"]).alias("last"))

    return F.aggregate(cue, start, step, lambda a: F.tanh((a["p"] - a["n"]) / F.sqrt(a["p"] + a["n"] + 2.0)))


def valence(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """:func:`valence_of` over a text."""
    return valence_of(tokenize(text), lexicon)


def valence_of(tokens: Column, lexicon: dict[str, float] | None = None) -> Column:
    """struct(compound, pos, neg) of summed word valences, compound = s / sqrt(s^2 + 15)."""
    lexicon = {**K.GENERAL_VALENCE, **K.FINANCE_VALENCE} if lexicon is None else lexicon
    by_value: dict[float, list[str]] = {}
    for w, v in lexicon.items():
        by_value.setdefault(float(v), []).append(w)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))

    def step(a, t):
        v = _first_hit([(t.isin(ws), F.lit(val)) for val, ws in by_value.items()], F.lit(0.0))
        return F.struct((a["s"] + v).alias("s"), (a["p"] + F.when(v > 0, v + 1.0).otherwise(0.0)).alias("p"),
                        (a["n"] + F.when(v < 0, 1.0 - v).otherwise(0.0)).alias("n"))

    def finish(a, plain):
        total = F.greatest(a["p"] + a["n"] + plain, F.lit(1.0))
        return F.struct((a["s"] / F.sqrt(a["s"] * a["s"] + 15.0)).alias("compound"),
                        (a["p"] / total).alias("pos"), (a["n"] / total).alias("neg"))

    words = [w for w, v in lexicon.items() if v]
    scored = lambda toks: F.struct(F.filter(toks, lambda t: t.isin(words)).alias("hits"), F.size(toks).alias("n"))
    return with_value(with_value(tokens, scored), lambda x: F.aggregate(
        x["hits"], start, step, lambda a: finish(a, (x["n"] - F.size(x["hits"])).cast("double"))))


def numeric_impact(text: Column) -> Column:
    """+0.5 for each signed rise and -0.5 for each signed fall among money and percent figures."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(K.NUMERIC), F.lit(1))
    return F.aggregate(found, F.lit(0.0), lambda a, m: a + F.when(m.startswith("+"), 0.5).when(m.startswith("-"), -0.5).otherwise(0.0))


def title_tokens(title: Column) -> Column:
    """Sorted distinct words longer than three letters."""
    return F.array_sort(F.array_distinct(F.filter(tokenize(title), lambda w: F.length(w) > 3)))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b|, 0 if either is empty; both must hold distinct values."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one machine-word-parallel row per character of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * _lcs_length(a, b) / n


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised insert/delete similarity, 0 to 100."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def decode_items(desc: Column) -> Column:
    """Filing item numbers to plain words, distinct in order; the text itself when it has none."""
    desc = text_or_empty(desc)
    words = _map_lookup(K.FILING_ITEMS)
    codes = F.regexp_extract_all(desc, F.lit(r"(\d\.\d\d)"), F.lit(1))
    named = F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(words, c), c)))
    return F.when(F.size(codes) > 0, F.array_join(named, ", ")).otherwise(desc)


def filing_items(summary: Column) -> Column:
    """'Item d.dd' mentions as an array of 'd.dd description'."""
    words = _map_lookup(K.FILING_ITEMS)
    codes = F.regexp_extract_all(text_or_empty(summary), F.lit(r"Item (\d\.\d\d)"), F.lit(1))
    return F.transform(codes, lambda c: F.trim(F.concat_ws(" ", c, F.coalesce(F.try_element_at(words, c), F.lit("")))))


def resolve_symbol(theme: Column, explicit: Column) -> Column:
    """Explicit symbol, else the first theme key contained in the text, else null."""
    t = F.lower(text_or_empty(theme))
    by_theme = _first_hit([(t.contains(k), F.lit(s)) for k, s in K.THEME_SYMBOLS], F.lit(None).cast("string"))
    return F.when(F.length(explicit) > 0, F.trim(explicit)).otherwise(by_theme)


def norm_title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty(title)), r"(?U)\W+", " "))


def main_text(html: Column, min_chars: int = 200) -> Column:
    """Readable text of a stored page: drop non-content blocks and tags; null when too short to be an article."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "head", "nav", "header", "footer", "aside", "form", "svg", "iframe"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.regexp_replace(t, r"[ \t\x0B\f\r]+", " ")
    t = F.btrim(F.regexp_replace(t, r"\s*\n\s*", "\n"), F.lit(" \n"))
    return F.when(F.length(t) >= min_chars, t)


def is_blocked(url: Column, domains=None) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(url, F.lit(d)), F.lit(False)) for d in domains or K.BLOCKED_DOMAINS])


def merge_tickers(existing: Column, found: Column) -> Column:
    """struct(tickers, changed): sorted union and whether it adds anything."""
    empty = F.array().cast("array<string>")
    old = F.array_sort(F.array_distinct(F.coalesce(existing, empty)))
    new = F.array_sort(F.array_union(old, F.coalesce(found, empty)))
    return F.struct(new.alias("tickers"), (~new.eqNullSafe(old)).alias("changed"))


def parse_ts(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def parse_feed_date(text: Column) -> Column:
    """ISO or RFC-822 date text."""
    text = F.trim(text)
    rfc = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(parse_ts(text), *[F.try_to_timestamp(rfc, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])


def parse_published(*candidates: Column, now: Column) -> Column:
    """First of the candidate texts that parses, else ``now``."""
    return F.coalesce(*[parse_feed_date(c) for c in candidates], now)


def split_themes(text: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(text), ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)

"""License scans: exact short phrases, and fuzzy search for short notices.

A notice that may hold ``k`` edits is cut into ``k + 1`` pieces; an occurrence leaves at least one of them whole (pigeonhole). An automaton finds all
pieces of all notices in one pass over a text's words; around each hit the ``regex`` library matches the whole notice with at most ``k`` errors.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_as_long, id_as_text, text_words

#: Phrases and labels of the base search.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices and labels of the fuzzy search, as published by the licenses' authors, lower-cased and without punctuation.
NOTICES = [
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("proprietary", "all rights reserved"),
]
#: Characters per allowed edit, one edit at least.
PER_EDIT = 12
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
RAW_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normal_words(text: str | None) -> tuple[bytes, int]:
    """(words with A-Z lower-cased, each between single blanks; their number)."""
    raw, parts, n = (text or "").encode().lower(), [], 0
    for ws in text_words(raw, WORD, GAP):
        n += len(ws)
        if ws:
            parts.append(b" ".join(ws))
    return b" " + b" ".join(parts) + b" " if n else b" ", n


def phrase_places(words: bytes, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, seen, index = words.find(needle), 0, 0
        while at >= 0:
            index += words.count(b" ", seen, at)
            out.append((index, label))
            seen, at = at, words.find(needle, at + 1)
    return sorted(out)


@dataclass(frozen=True)
class Match:
    label: str
    edits: int
    length: int  # of the notice
    start: int
    end: int


@dataclass
class NoticeSearch:
    notices: list[tuple[str, str]] = field(default_factory=lambda: list(NOTICES))

    def __post_init__(self):
        self.limits = [max(1, len(t) // PER_EDIT) for _, t in self.notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}") for (_, t), k in zip(self.notices, self.limits)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((_, t), k) in enumerate(zip(self.notices, self.limits)):
            cuts = [j * len(t) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(t[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, words: str) -> list[Match]:
        """Matches in blank-separated words; of overlapping ones the one with the fewest edits, then the longest notice, then the first."""
        hits = [(i, end + 1 - size, end + 1, offset) for end, (size, places) in self.automaton.iter(words) for i, offset in places]
        whole = {(-len(t), a - o, a - o + len(t), label) for i, a, _, o in hits for label, t in [self.notices[i]] if a >= o and words.startswith(t, a - o)}
        kept, starts = [], []  # kept spans are apart, so only those next to a new one can overlap it

        def free(start: int, end: int) -> bool:
            k = bisect.bisect_right(starts, start)
            return (not k or kept[k - 1].end <= start) and (k == len(kept) or end <= starts[k])

        def keep(edits: int, size: int, start: int, end: int, label: str) -> None:
            if free(start, end):
                k = bisect.bisect_right(starts, start)
                starts.insert(k, start)
                kept.insert(k, Match(label, edits, size, start, end))

        for size, start, end, label in sorted(whole):
            keep(0, -size, start, end, label)
        # a match that holds a piece inside an unedited one overlaps it and loses, so such pieces need no fuzzy search
        windows: dict[int, list[list[int]]] = {}
        for i, start, end, offset in hits:
            if free(start, end):
                k, n, mine = self.limits[i], len(self.notices[i][1]), windows.setdefault(i, [])
                lo = start - offset - k
                if mine and mine[-1][0] <= lo <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], lo + n + 2 * k)
                else:
                    mine.append([lo, lo + n + 2 * k])
        fuzzy = {(sum(m.fuzzy_counts), -len(self.notices[i][1]), m.start(), m.end(), self.notices[i][0]) for i, mine in windows.items() for lo, hi in mine
                 for m in self.patterns[i].finditer(words, max(lo, 0), min(hi, len(words)))}
        for edits, size, start, end, label in sorted(fuzzy):
            keep(edits, -size, start, end, label)
        return kept


SCHEMA = ("doc_id string, n_words long, places array<struct<word:long,label:string>>, "
          "notices array<struct<label:string,edits:int,start:long,end:long,score:double>>")


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places (word index and label of every base phrase), notices (label, edits, start, end, score of
    every fuzzy match; code points of the text, end exclusive; score is 1 less edits per character of the notice).

    Whole texts are searched. Null counts as empty: no words, no matches. Overlapping notices: the one with the fewest edits stays, then the
    longest. Rows that repeat a doc_id are searched each; other columns are ignored; an empty table gives an empty table.
    """
    listed = list(notices or NOTICES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = NoticeSearch(listed)
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                words, n = normal_words(t)
                places = [{"word": w, "label": label} for w, label in phrase_places(words)]
                joined, spans = words.decode(), []
                matches = search.find(joined)
                if matches:
                    at = [m.span() for m in RAW_WORD.finditer(t)]
                    blanks = [k for k, c in enumerate(joined) if c == " "]
                    for m in matches:
                        first = bisect.bisect_left(blanks, m.start + (joined[m.start] == " ")) - 1
                        last = bisect.bisect_left(blanks, m.end - (joined[m.end - 1] == " ")) - 1
                        spans.append({"label": m.label, "edits": m.edits, "start": at[max(first, 0)][0], "end": at[min(last, n - 1)][1], "score": max(0.0, 1 - m.edits / m.length)})
                out.append((i, n, places, spans))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "places", "notices"])
    return id_as_long(docs.select(id_as_text("doc_id"), F.col("text").cast("string")).mapInPandas(run, SCHEMA), "doc_id")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base place, label lists and the best score from ``license_scan``'s rows."""
    at, base = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("notices", lambda n: n["label"]))
    best = F.array_max(F.concat(F.transform("places", lambda p: F.lit(1.0)), F.transform("notices", lambda n: n["score"])))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                          text(base).alias("base_labels"), text(every).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))

"""Dictionaries as tables: which of very many phrases a text contains, and which of its tags a universe knows.

A phrase is found through a number made from its first letters (its anchor). Bit filters of a fixed size, filled by a grouped sum, say in the scanning task at
which places of a text an anchor may begin; only these few (text, anchor) rows are shuffled to meet the phrases, and an exact check follows, so a full
filter costs time but no result. Neither table reaches the driver or the plan's literals. Texts meet through a hash of their content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Letters of an anchor, and of its head that is asked for first; a shorter phrase is its own anchor.
ANCHOR, HEAD = 64, 8
#: Bits of a filter (as a power of two) and letters of texts that are hashed together.
_BITS, _PIECE = 25, 1 << 16
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so both have inverses


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and the mixing factor times those of its inverse, modulo 2^64."""
    n = _PIECE + ANCHOR + 1
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0], down[0] = 1, _MIX
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Windows:
    """Numbers of all windows of a text of at most ``_PIECE + ANCHOR`` letters: equal windows have equal numbers wherever they stand."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, (up, self.down) = len(codes), _powers()
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:self.n], dtype=np.uint64)))

    def all(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.down[:self.n + 1 - size] if size <= self.n else np.empty(0, np.uint64)

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[places + size] - self.sums[places]) * self.down[places]


def _slots(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter."""
    return numbers >> np.uint64(64 - _BITS), ((numbers ^ (numbers >> np.uint64(31))) * np.uint64(_MIX)) >> np.uint64(64 - _BITS)


def _held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


@F.pandas_udf(T.StructType([T.StructField("anchor", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType()))]))
def _anchor(phrases: pd.Series) -> pd.DataFrame:
    """A phrase's anchor as a number, and its places in the filters of heads (first) and of anchors (other two, behind all heads)."""
    heads, anchors = (np.concatenate([np.empty(0, np.uint64), *(_Windows(p[:n]).all(min(n, len(p))) for p in phrases)]) for n in (HEAD, ANCHOR))
    first, second = _slots(anchors)
    slots = np.stack((_slots(heads)[0], first + np.uint64(1 << _BITS), second + np.uint64(1 << _BITS)), 1).astype(np.int64)
    return pd.DataFrame({"anchor": anchors.view(np.int64), "slots": list(slots)})


def anchors_in(texts: list[str | None], heads: np.ndarray, anchors: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each text the distinct numbers of its windows of ``sizes`` letters that the filters hold."""
    found = [[] for _ in texts]
    pieces = [(k, t[x:x + _PIECE // 2 + ANCHOR - 1]) for k, t in enumerate(texts) if t for x in range(0, len(t), _PIECE // 2)]
    at = 0
    while at < len(pieces):
        to, n = at, 0
        while to < len(pieces) and (to == at or n + len(pieces[to][1]) <= _PIECE):
            n += len(pieces[to][1])
            to += 1
        ends = np.cumsum([len(p) for _, p in pieces[at:to]])
        windows, places, numbers = _Windows("".join(p for _, p in pieces[at:to])), [], []
        for head in sorted({min(s, HEAD) for s in sizes}):
            may = np.flatnonzero(_held(heads, _slots(windows.all(head))[0]))
            for size in [s for s in sizes if min(s, HEAD) == head]:
                where = may[may + size <= windows.n]
                number = windows.at(where, size)
                first, second = _slots(number)
                hit = _held(anchors, first) & _held(anchors, second)
                places.append(where[hit]), numbers.append(number[hit])
        places, numbers = np.concatenate(places), np.concatenate(numbers).view(np.int64)
        owner = np.searchsorted(ends, places, "right")  # a window over two texts is refused by the exact check
        order = np.argsort(owner, kind="stable")
        owner, numbers = owner[order], numbers[order]
        for k, part in zip(*(np.unique(owner), np.split(numbers, np.flatnonzero(np.diff(owner)) + 1))):
            found[pieces[at + k][0]].append(part)
        at = to
    return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]


def _with_anchors(phrases: DataFrame) -> DataFrame:
    """(phrase, value, size, anchor, slots), written once; of several values of a phrase the greatest counts."""
    p = phrases.where(F.length("phrase") > 0).groupBy("phrase").agg(F.max("value").alias("value")).withColumn("__a", _anchor("phrase"))
    return cut_lineage(p.select("phrase", "value", F.least(F.length("phrase"), F.lit(ANCHOR)).alias("size"), "__a.anchor", "__a.slots"))


def _finder(p: DataFrame):
    """A function of a text column that gives the anchors of ``p`` a text may hold, or None if there is no phrase."""
    sizes = [r["size"] for r in p.select("size").distinct().orderBy("size").collect()]  # at most ANCHOR numbers
    if not sizes:
        return None
    slot = p.select(F.explode("slots").alias("slot")).distinct()
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()  # at most two filters
    bits = np.zeros(2 << (_BITS - 6), np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    filters = p.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("array<long>")
    def anchors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        heads, whole = np.split(filters.value, 2)
        for t in texts:
            yield pd.Series(anchors_in(t.tolist(), heads, whole, sizes), dtype=object)

    return anchors


def with_contained(df: DataFrame, text: Column, phrases: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the (phrase, value) rows of ``phrases`` whose phrase is a part of ``text``, longest phrase first, then by phrase.

    Exact case, no word borders. Null texts contain nothing; null and empty phrases are in no text; of several values of a phrase the greatest counts.
    """
    p, kind = _with_anchors(phrases), "array<struct<phrase:string,value:string>>"
    anchors = _finder(p)
    if anchors is None:
        return df.withColumn(out, F.array().cast(kind))
    t = df.withColumns({"__text": text, "__key": F.xxhash64(text)})
    offered = df.select(text.alias("__text")).where("__text is not null").select(F.xxhash64("__text").alias("__key"), F.explode(anchors("__text")).alias("anchor")).distinct()
    found = offered.join(p.select("phrase", "value", "anchor"), "anchor").groupBy("__key").agg(F.collect_set(F.struct("phrase", "value")).alias("__found"))
    longest = lambda x, y: F.when(F.length(x["phrase"]) != F.length(y["phrase"]), F.length(y["phrase"]) - F.length(x["phrase"])).when(
        x["phrase"] < y["phrase"], -1).when(x["phrase"] > y["phrase"], 1).otherwise(0)
    held = F.filter("__found", lambda x: F.contains(F.col("__text"), x["phrase"]))
    return (t.join(found, "__key", "left").withColumn(out, F.coalesce(F.array_sort(held, longest), F.array().cast(kind)))
            .drop("__text", "__key", "__found"))


def short_phrases(phrases: DataFrame, longest: int = 8, most: int = 100_000) -> DataFrame:
    """The (phrase, value) rows of the shortest phrases, as many lengths up to ``longest`` as hold at most ``most`` rows: what nearly every text contains."""
    sized = phrases.where(F.length("phrase").between(1, longest)).select("phrase", "value")
    total, up = 0, 0
    for r in sized.groupBy(F.length("phrase").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect():  # at most ``longest`` rows
        total += r["rows"]
        if total > most:
            break
        up = r["n"]
    return sized.where(F.length("phrase") <= up)


def values_of_contained(short: DataFrame):
    """A function of a text column that gives the distinct values of those phrases of ``short`` (see :func:`short_phrases`) that are a part of the text.

    The bounded table is looked up where the text is, so a text's many short phrases and their values are never shuffled.
    """
    rows = short.toPandas()
    values, of = np.unique(rows["value"].to_numpy(object).astype(str), return_inverse=True)
    known = {str(p): of[i] for p, i in rows.groupby("phrase").indices.items()}
    table = short.sparkSession.sparkContext.broadcast((values.astype(object), known, sorted({len(p) for p in known})))

    @F.pandas_udf("array<string>")
    def held(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, of_phrase, sizes = table.value
        for batch in texts:
            out = []
            for t in batch:
                seen = np.zeros(len(names), bool)
                for n in sizes if t else ():
                    for p in of_phrase.keys() & {t[k:k + n] for k in range(len(t) - n + 1)}:
                        seen[of_phrase[p]] = True
                out.append(names[seen])
            yield pd.Series(out, dtype=object)

    return held


def first_matches(text: Column, found: Column) -> Column:
    """Phrases of ``found`` (see :func:`with_contained`) met in ``text`` from left to right, the longest at each place and none overlapping, distinct."""
    quoted = F.transform(found, lambda x: F.regexp_replace(x["phrase"], F.lit(r"([\\.^$|?*+()\[\]{}&-])"), F.lit(r"\\$1")))
    some = F.regexp_extract_all(text, F.concat(F.lit("("), F.array_join(quoted, "|"), F.lit(")")), F.lit(1))
    return F.when(F.size(found) > 0, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def with_known(df: DataFrame, tags: Column, universe: DataFrame, out: str) -> DataFrame:
    """Add ``out``: those of ``tags`` that are a symbol of ``universe``, sorted. Rows with the same tags are looked up once."""
    t = df.withColumn("__tags", F.array_sort(F.array_distinct(F.array_compact(F.coalesce(tags, F.array().cast("array<string>")))))).withColumn("__key", F.xxhash64("__tags"))
    each = t.select("__key", F.explode_outer("__tags").alias("symbol")).distinct().join(universe.select("symbol").distinct(), "symbol", "left_semi")
    known = each.groupBy("__key").agg(F.collect_set("symbol").alias("__sure"))
    none = F.array().cast("array<string>")
    return t.join(known, "__key", "left").withColumn(out, F.array_intersect("__tags", F.coalesce("__sure", none))).drop("__tags", "__key", "__sure")

"""Pairs of similar titles: every title against every other one of a similar length, in groups of bounded size.

The ratio of two titles is twice their longest common subsequence over their length sum, so only titles of one or of neighbouring length classes can be
similar. Classes are dealt into parts, and each two parts meet in one group. There a pair goes through ever dearer bounds of its common subsequence, none of
which loses a similar pair: sums of letter counts for whole leaves of alike titles at once, the letters it shares, and the common subsequences of the titles cut
down to a few kinds of letters. Only what is left is compared in full. Nothing but similar pairs leaves a group, so the tables written grow with titles times
parts, not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _lcs_length

#: Most titles and letters of a part.
_ROWS, _LETTERS = 32_768, 2_000_000
#: Bins of letters by the mean length of titles from which they are worth their time.
_BINS = {0: 24, 70: 32, 130: 48}
#: Titles of a leaf; titles and pairs that are handled at once; most bit masks of a leaf.
_LEAF, _WIDE, _PAIRS, _MASKS = 256, 1024, 8192, 8_000_000
#: Letters that a kind of letters should have in a title; most kinds.
_KIND, _KINDS = 24, 8
#: Titles by which the sums that tell leaves apart are chosen, and the number of these sums beside the length.
_LOOKED, _SUMS = 2000, 3


@dataclass
class _Letters:
    """Titles cut down to some letters: ``at[k]`` holds the k-th letter of every title as a number below ``size - 1``, and ``size - 1`` after a title's end."""

    n: np.ndarray
    at: np.ndarray
    size: int

    @classmethod
    def of(cls, owner: np.ndarray, letter: np.ndarray, order: np.ndarray, place: np.ndarray, size: int) -> _Letters:
        """``owner`` and ``letter`` go title by title; ``order`` is the order wanted and ``place`` where it puts a title."""
        n = np.bincount(owner, minlength=len(order))
        at = np.full((n.max(initial=0), len(order)), size - 1, np.uint8 if size <= 256 else np.uint16 if size <= 65_536 else np.int32)
        at[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), place[owner]] = letter
        return cls(n[order], at, size)

    def masks(self, x: int, up: int) -> np.ndarray | None:
        """One bit per place of a letter: (64 places, titles ``x`` to ``up`` times letters); none if these are too many."""
        last = self.n[x:up].max()
        shape = (last + 63 >> 6, up - x, self.size)
        if math.prod(map(int, shape)) > _MASKS:
            return None
        out, rows = np.zeros(shape, np.uint64), np.arange(up - x)
        for k in range(last):
            out[k >> 6, rows, self.at[k, x:up]] |= np.uint64(1 << (k & 63))
        out[:, :, -1] = 0
        return out.reshape(shape[0], shape[1] * shape[2])

    def title(self, k: int) -> list[int]:
        return self.at[:self.n[k], k].tolist()


def _common(a: _Letters, masks: np.ndarray | None, x: int, ka: np.ndarray, b: _Letters, kb: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, all pairs at once with one bit per letter of ``a`` (as ``_lcs_length`` does for one pair).

    ``masks`` are those of ``a`` from title ``x`` on.
    """
    words, steps = int(a.n[ka].max() + 63) // 64, b.n[kb].max()
    if masks is None or len(ka) < 12 * words:  # few pairs of long titles
        return np.array([_lcs_length(a.title(i), b.title(j)) for i, j in zip(ka, kb)], np.int64)
    base, row = (ka - x) * a.size, np.full((words, len(ka)), ~np.uint64(0))
    slot, hit = np.empty(len(ka), np.int64), np.empty(len(ka), np.uint64)
    for step in b.at[:steps]:
        np.add(base, step.take(kb), out=slot)
        carry = None
        for w in range(words):
            old = row[w]
            masks[w].take(slot, out=hit, mode="clip")
            np.bitwise_and(hit, old, out=hit)
            new = old + hit
            if words > 1:
                over = new < old
                if carry is not None:
                    new += carry
                    over |= new < carry
                carry = over.astype(np.uint64)
            old ^= hit
            old |= new
    return 64 * words - np.bitwise_count(row).sum(0, dtype=np.int64)


class _Titles:
    """Titles in leaves of alike ones: how many letters of each bin they hold, and their letters, all and of each kind."""

    def __init__(self, n: np.ndarray, letter: np.ndarray, bins: np.ndarray, kinds: np.ndarray, sums: np.ndarray):
        """``bins`` gives the bin of a letter, ``kinds`` the kind of a bin, ``sums`` weights of bins from -1 to 1."""
        rows, size = len(n), len(kinds)
        owner, bin_of = np.repeat(np.arange(rows, dtype=np.int32), n), bins[letter]
        wide = np.bincount(owner * np.int32(size) + bin_of, minlength=rows * size).reshape(-1, size)
        sums = wide @ sums.T
        self.order, cuts = _leaves(sums)
        place = np.empty(rows, np.int32)
        place[self.order] = np.arange(rows)
        self.n, sums = n[self.order], sums[self.order]
        self.cuts = list(zip(cuts[:-1], cuts[1:]))
        self.low, self.high = (np.array([pick(sums[x:y], axis=0) for x, y in self.cuts]) for pick in (np.min, np.max))
        kind = np.uint8 if n.max() < 256 else np.uint16 if n.max() < 65_536 else np.int64
        self.held = np.ascontiguousarray(wide[self.order].T.astype(kind))
        self.all = _Letters.of(owner, letter, self.order, place, len(bins) + 1)
        self.parts = []
        for k in range(kinds.max() + 1 if kinds.max() else 0):
            mine = np.flatnonzero(kinds[bins] == k)
            to = np.zeros(len(bins), np.int32)
            to[mine] = np.arange(len(mine))
            held = (kinds == k)[bin_of]
            self.parts.append((np.flatnonzero(kinds == k), _Letters.of(owner[held], to[letter[held]], self.order, place, len(mine) + 1)))


def _leaves(sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of titles and the borders of its leaves: halves, again and again, by the sum that differs most."""
    done, todo = [], [np.arange(len(sums))]
    while todo:
        rows = todo.pop()
        if len(rows) <= _LEAF:
            done.append(rows)
            continue
        s = sums[rows]
        s = s[:, s.std(0).argmax()]
        half = np.argpartition(s, len(s) // 2)
        todo += [rows[half[len(s) // 2:]], rows[half[:len(s) // 2]]]
    return np.concatenate(done), np.cumsum([0] + [len(r) for r in done]).tolist()


def _sums(n: np.ndarray, letter: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Weights of bins, each from -1 to 1: all letters alike, and those that tell the titles looked at apart. Whatever they are, an edit changes no sum by more than 1."""
    start = np.cumsum(n) - n
    rows = np.unique(np.linspace(0, len(n) - 1, min(len(n), _LOOKED)).astype(np.int64))
    held = np.array([np.bincount(bins[letter[s:s + k]], minlength=size) / k for s, k in zip(start[rows], n[rows])])
    weights = np.linalg.eigh(np.cov(held.T) if len(rows) > 1 else np.eye(size))[1].T[::-1][:_SUMS]
    return np.concatenate([np.ones((1, size)), np.sign(weights)])


def similar_in(left: list[str], right: list[str] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``left``, in ``right``) of the pairs with a ratio above ``threshold``; without ``right`` the pairs within ``left``. No title is empty."""
    titles = left + (right or [])
    n = np.array([len(t) for t in titles], np.int64)
    letter = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32)
    times = np.bincount(letter)
    often = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
    number = np.zeros(len(times), np.int32)
    number[often] = np.arange(len(often))
    letter = number[letter]  # the most frequent letters come first and have bins of their own
    bins = np.arange(len(often), dtype=np.int32)
    size = max(b for length, b in _BINS.items() if n.mean() >= length)
    bins = np.where(bins < size - 8, bins, size - 8 + bins % 8)
    kinds = np.arange(size) % max(1, min(_KINDS, int(n.mean()) // _KIND))
    sums, share = _sums(n, letter, bins, size), threshold / 100.0
    ends = [0, len(left), len(titles)]
    a, *b = [_Titles(n[x:y], letter[n[:x].sum():n[:y].sum()], bins, kinds, sums) for x, y in zip(ends, ends[1:]) if y > x]
    b, within = b[0] if b else a, right is None
    total = np.arange(a.n.max() + b.n.max() + 1)
    least = np.maximum(np.floor(total * share / 2).astype(np.int64) - 1, 0)  # letters that a similar pair has in common, by its length sum
    for _ in range(3):
        least += 200.0 * least <= threshold * total
    floor_a, floor_b = (np.floor(s.n * share / 2 - 1e-6).astype(s.held.dtype) for s in (a, b))
    dtype = max(a.held.dtype, b.held.dtype)
    room = np.empty((2, _LEAF * _WIDE), dtype)
    ends_b = np.array([y for _, y in b.cuts])
    for leaf, (x, up) in enumerate(a.cuts):
        far = np.maximum(b.low - a.high[leaf], a.low[leaf] - b.high).max(1)  # the edits that a pair of two leaves has at least
        near = far <= (1 - share) * (a.high[leaf, 0] + b.high[:, 0]) + 1e-6
        if within:
            near[:leaf] = False
        cols = np.flatnonzero(np.repeat(near, np.diff(ends_b, prepend=0)))
        found = []
        for y in range(0, len(cols), _WIDE):
            to = cols[y:y + _WIDE]
            wide, held = (up - x, len(to)), b.held.take(to, axis=1)
            shared, both = (r[:wide[0] * wide[1]].reshape(wide) for r in room)
            shared[:] = 0
            for k in np.flatnonzero(a.held[:, x:up].any(1) & held.any(1)):
                np.minimum(a.held[k, x:up, None], held[k], out=both)
                np.add(shared, both, out=shared)
            flat = np.flatnonzero(shared > floor_a[x:up, None].astype(dtype) + floor_b[to])
            ka, kb, most = x + flat // wide[1], to[flat % wide[1]], shared.reshape(-1)[flat].astype(np.int64)
            some = most >= least[a.n[ka] + b.n[kb]]
            if within:
                some &= kb > ka
            found.append((ka[some], kb[some], most[some]))
        if not found:
            continue
        ka, kb, most = (np.concatenate(f) for f in zip(*found))
        for (own, la), (_, lb) in zip(a.parts, b.parts):
            if not len(ka):
                break
            masks, kept = la.masks(x, up), []
            short = np.argsort(np.minimum(np.maximum(la.n[ka], lb.n[kb]), 65_535).astype(np.uint16), kind="stable")  # pairs of alike lengths are handled together
            ka, kb, most = ka[short], kb[short], most[short]
            for p in range(0, len(ka), _PAIRS):
                pa, pb, m = ka[p:p + _PAIRS], kb[p:p + _PAIRS], most[p:p + _PAIRS]
                for k in own:
                    m = m - np.minimum(a.held[k].take(pa), b.held[k].take(pb))
                m += _common(la, masks, x, pa, lb, pb)
                some = m >= least[a.n[pa] + b.n[pb]]
                kept.append((pa[some], pb[some], m[some]))
            ka, kb, most = (np.concatenate(k) for k in zip(*kept))
        masks = a.all.masks(x, up) if len(ka) else None
        for p in range(0, len(ka), _PAIRS):
            pa, pb = ka[p:p + _PAIRS], kb[p:p + _PAIRS]
            close = 200.0 * _common(a.all, masks, x, pa, b.all, pb) / (a.n[pa] + b.n[pb]) > threshold
            yield a.order[pa[close]], b.order[pb[close]]


def similar_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """(a, b), each pair once, of the rows of ``titles`` (key long, title, stored: distinct titles) with a ratio above ``threshold``; pairs of two stored titles are left out.

    ``titles`` is read more than once, so it has to be written before. The driver sees one row per length class.
    """
    share = threshold / 100.0
    kind = F.floor(F.log(F.length("title").cast("double")) / math.log((2 - share) / share * (1 + 1e-9))).cast("int")
    t = titles.where(F.length("title") > 0).withColumn("kind", kind)
    size = {r["kind"]: max(-(-r["rows"] // _ROWS), -(-r["letters"] // _LETTERS)) for r in
            t.groupBy("kind").agg(F.count("*").alias("rows"), F.sum(F.length("title").cast("long")).alias("letters")).collect()}
    if not size:
        return titles.select(F.col("key").alias("a"), F.col("key").alias("b")).where("false")
    parts = F.create_map(*[F.lit(x) for kv in size.items() for x in kv])
    of = lambda k: F.coalesce(F.try_element_at(parts, k), F.lit(0))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    t = t.withColumn("parts", of(F.col("kind"))).withColumn("part", part)
    # a group's name: class and part of the left side, whether the right side is of the next class, and its part
    name = lambda kind, x, wide, y, right: F.struct(kind.alias("kind"), x.alias("x"), F.lit(wide).alias("wide"), y.alias("y"), right.alias("right"))
    every = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    me, k, no, yes = F.col("part"), F.col("kind"), F.lit(False), F.lit(True)
    same = F.transform(every(F.col("parts")), lambda p: name(k, F.least(me, p), 0, F.greatest(me, p), me > p))
    above = F.transform(every(of(k + 1).cast("int")), lambda p: name(k, me, 1, p, no))
    below = F.transform(every(of(k - 1).cast("int")), lambda p: name(k - 1, p, 1, me, yes))
    groups = sum(n * (n + 1) // 2 + n * size.get(c + 1, 0) for c, n in size.items())
    dealt = t.select("key", "title", "stored", F.explode(F.concat(same, above, below)).alias("g")).select("key", "title", "stored", "g.*")
    names = ["kind", "x", "wide", "y"]

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        key = (g["kind"].iloc[0], g["x"].iloc[0], g["wide"].iloc[0], g["y"].iloc[0])
        l, r = g[~g["right"]], g[g["right"]]
        within = not key[2] and key[1] == key[3]
        out = [(np.empty(0, np.int64),) * 2]
        if len(l) and (within or len(r)):
            (ik, ib), (jk, jb) = ((s["key"].to_numpy(np.int64), s["stored"].to_numpy(bool)) for s in (l, l if within else r))
            for i, j in similar_in(l["title"].tolist(), None if within else r["title"].tolist(), threshold):
                fresh = ~(ib[i] & jb[j])
                out.append((ik[i[fresh]], jk[j[fresh]]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"a": a, "b": b})

    return dealt.repartition(min(3 * groups, 6000), *names).groupBy(*names).applyInPandas(meet, "a long, b long")

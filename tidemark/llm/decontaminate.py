"""Benchmark decontamination by edit distance over words.

Words (lower-cased ``\\w+``) are hashed. The CGK random walk reads a window and stays at, or moves on from, the current word by a random bit of
(word, step); it maps edit distance to Hamming distance, because walks meet again soon after an edit. A table samples a few steps of a walk;
windows that agree on all samples of some table are candidates. Item windows start at every one of ``stride`` successive words at the head, in the
middle and towards the tail of an item and document windows at every ``stride``-th word, so any occurrence lines up with one of each. Sizes of windows
follow the items: one class for each doubling of item length, with its own number of walks. Every candidate is verified by the exact least edit distance between the whole item and any part of the region.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, id_as_long, id_as_text, mix, word_hashes

SAMPLES, TABLES = 4, 8
log = logging.getLogger(__name__)


def by_class(items: dict[int, np.ndarray]) -> dict[int, dict[int, np.ndarray]]:
    """Items with words by the power of two at or below their length."""
    found: dict[int, dict[int, np.ndarray]] = {}
    for i, w in items.items():
        if len(w):
            found.setdefault(1 << (len(w).bit_length() - 1), {})[i] = w
    return dict(sorted(found.items()))


class SizeClass:
    """Items of ``low`` to ``2 * low - 1`` words and the tables that find them."""

    def __init__(self, low: int, items: dict[int, np.ndarray], walks: int, seed: int):
        self.items = items
        self.stride = max(1, low // 4)
        self.window = max(1, low - self.stride + 1)
        self.steps = max(1, self.window * 3 // 2)
        rng = np.random.default_rng((seed, low))
        self.seeds = rng.integers(1, 2**63, walks, dtype=np.uint64)
        r = min(SAMPLES, self.steps)
        self.at = [[np.sort(rng.choice(self.steps, r, replace=False)) for _ in range(TABLES)] for _ in range(walks)]
        self.by = rng.integers(0, 2**62, (walks, TABLES, r), dtype=np.uint64) * U64(2) + U64(1)
        ids, words, starts, offs, at = [], [], [], [], 0
        for i, w in items.items():
            for o in self.starts(len(w)):
                ids.append(i)
                offs.append(o)
                starts.append(at + o)
            words += [w, np.zeros(self.steps + 1, U64)]
            at += len(w) + self.steps + 1
        self.ids, self.offs = np.array(ids), np.array(offs)
        keys = self.keys(np.concatenate(words), np.array(starts))
        self.bits = max(10, int(np.ceil(np.log2(16 * len(ids)))))
        self.shift = U64(64 - self.bits)
        self.tables = []
        for k in keys:
            order = np.argsort(k, kind="stable")
            seen = np.zeros(1 << self.bits, bool)
            seen[k >> self.shift] = True
            self.tables.append((seen, k[order], order))

    def starts(self, size: int) -> list[int]:
        """Words of an item at which windows start: a walk reads about three quarters of a window, so the last ones end with the item."""
        last = max(0, size - self.window * 3 // 4 - self.stride)
        return sorted({a + o for a in (0, last // 2, last) for o in range(self.stride) if a + o < size})

    def keys(self, words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of the windows at ``starts``, table by table. ``words`` has room for all steps behind every start."""
        for w in range(len(self.seeds)):
            h = mix(words ^ self.seeds[w])
            bits = [h] + [mix(h + U64(k)) for k in range(1, (self.steps + 63) // 64)]
            pos, seen = starts.copy(), []
            for t in range(self.steps):
                seen.append(h[pos])
                more = seen[-1] if t < 64 else bits[t // 64][pos]
                pos += ((more >> U64(t % 64)) & U64(1)).view(np.int64)
            for at, by in zip(self.at[w], self.by[w]):
                key = seen[at[0]] * by[0]
                for a, m in zip(at[1:], by[1:]):
                    key = key + seen[a] * m
                yield key

    def candidates(self, words: np.ndarray, first: np.ndarray, sizes: np.ndarray, chunk: int = 8192) -> set[tuple[int, int, int]]:
        """(document number, item id, document word where the item would start) of all windows that agree with an item window."""
        n = -(-sizes // self.stride)
        doc = np.repeat(np.arange(len(sizes)), n)
        starts = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        found = set()
        for a in range(0, len(doc), chunk):
            d, s = doc[a:a + chunk], starts[a:a + chunk]
            lo, hi = first[d[0]] + s[0], first[d[-1]] + s[-1] + self.steps + 1
            for (seen, keys, order), k in zip(self.tables, self.keys(words[lo:hi], first[d] + s - lo)):
                hit = np.flatnonzero(seen[k >> self.shift])
                if len(hit):
                    left, right = np.searchsorted(keys, k[hit], "left"), np.searchsorted(keys, k[hit], "right")
                    for j in np.flatnonzero(right > left):
                        for x in order[left[j]:right[j]]:
                            found.add((int(d[hit[j]]), int(self.ids[x]), int(s[hit[j]] - self.offs[x])))
        return found


def least_edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance between ``item`` and any part of ``region``, and where the first such part ends.

    Bit-parallel columns (Myers): each bit is a row of the edit table.
    """
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    n, full = len(item), (1 << len(item)) - 1
    up, down, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(region.tolist()):
        eq = masks.get(w, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | (full & ~(d0 | up)), d0 & up
        score += (hp >> (n - 1) & 1) - (hn >> (n - 1) & 1)
        hp, hn = hp << 1 & full, hn << 1 & full
        up, down = hn | (full & ~(d0 | hp)), hp & d0
        if score < best[0]:
            best = (score, j + 1)
    return best


class Finder:
    def __init__(self, items: dict[int, np.ndarray], max_rate: float, walks: dict[int, int], seed: int = 11):
        self.items, self.max_rate = {i: w for i, w in items.items() if len(w)}, max_rate
        self.classes = [SizeClass(low, some, walks[low], seed) for low, some in by_class(self.items).items()]
        self.pad = max((c.steps for c in self.classes), default=0) + 1

    def find(self, docs: list[np.ndarray], verify: bool = True) -> list[tuple[int, int, int, int, int]]:
        """(document number, item id, edits, start word, end word) of the best place of every item in every document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        if not sizes.sum() or not self.classes:
            return []
        first = np.cumsum(sizes + self.pad) - (sizes + self.pad)
        words = np.zeros(int((sizes + self.pad).sum()), U64)
        for d, f in zip(docs, first):
            words[f:f + len(d)] = d
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c in self.classes:
            for d, i, at in sorted(c.candidates(words, first, sizes)):
                if not verify:
                    best[(d, i)] = (0, at, at)
                    continue
                item = self.items[i]
                allowed = int(self.max_rate * len(item))
                lo = max(0, at - 2 * allowed)
                region = docs[d][lo:at + len(item) + 2 * allowed]
                edits, end = least_edits(item, region)
                if edits <= allowed and (edits, lo) < best.get((d, i), (allowed + 1, 0, 0))[:2]:
                    back, size = least_edits(item[::-1], region[:end][::-1])
                    best[(d, i)] = (edits, lo + end - size, lo + end)
        return [(d, i, *b) for (d, i), b in sorted(best.items())]


#: Parts of an item in which test edits fall.
PLACES = {"anywhere": [(0, 1)], "first half": [(0, 0.5)], "second half": [(0.5, 1)], "both ends": [(0, 0.25), (0.75, 1)]}


def edited(words: np.ndarray, edits: int, rng: np.random.Generator, parts: list[tuple[float, float]]) -> np.ndarray:
    """Single edits that fall in ``parts`` of the words, by turns."""
    out, n = words.tolist(), len(words)
    spots = [int(rng.integers(int(lo * n), max(int(lo * n) + 1, int(hi * n)))) for lo, hi in (parts[e % len(parts)] for e in range(edits))]
    for k in sorted(spots, reverse=True):  # from the back, so that earlier places stay where they are
        kind = int(rng.integers(3))
        k = min(k, len(out) - 1)
        if kind == 0:
            out[k] = int(rng.integers(2**63))
        elif kind == 1 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, int(rng.integers(2**63)))
    return np.array(out, U64)


def run_changed(words: np.ndarray, edits: int, rng: np.random.Generator, part: tuple[float, float]) -> np.ndarray:
    """One run of ``edits`` changed words that starts in ``part`` of the words."""
    out, n = words.copy(), len(words)
    at = int(rng.integers(int(part[0] * n), max(int(part[0] * n), int(part[1] * n) - edits) + 1))
    out[at:at + edits] = rng.integers(0, 2**63, len(out[at:at + edits]), dtype=np.uint64)
    return out


def trial_items(items: dict[int, np.ndarray], max_rate: float, rng: np.random.Generator, times: int) -> dict[str, list[tuple[int, np.ndarray]]]:
    """(item id, words) by kind of edits: every item ``times`` times, unedited or edited up to the limit, and set among foreign words."""
    kinds = {name: lambda w, e, parts=parts: edited(w, e, rng, parts) for name, parts in PLACES.items()}
    kinds |= {f"run in {name}": lambda w, e, part=part: run_changed(w, e, rng, part) for name, part in (("first half", (0, 0.5)), ("middle", (0.25, 0.75)), ("second half", (0.5, 1)))}
    kinds["unedited"] = lambda w, e: w
    around = lambda w: np.concatenate([rng.integers(0, 2**63, int(rng.integers(40)), dtype=np.uint64), w, rng.integers(0, 2**63, 80, dtype=np.uint64)])
    return {name: [(i, around(edit(w, int(max_rate * len(w))))) for i, w in items.items() for _ in range(times)] for name, edit in kinds.items()}


def recall_by_kind(tests: dict[str, list[tuple[int, np.ndarray]]], finder: Finder) -> dict[str, float]:
    """Share of the test items that become candidates, by kind of edits."""
    out = {}
    for name, some in tests.items():
        found = {(d, i) for d, i, *_ in finder.find([t for _, t in some], verify=False)}
        out[name] = float(np.mean([(k, i) in found for k, (i, _) in enumerate(some)]))
    return out


def choose_walks(items: dict[int, np.ndarray], max_rate: float, recall: float, most: int = 12, seed: int = 5, least_tests: int = 400) -> dict[int, int]:
    """Walks needed by size class: the fewest with which every unedited item and, of every kind of edits, at least ``recall`` of the test items plus a
    standard error become candidates.

    All items are tested, those of small classes often enough for ``least_tests``. A class that misses the target with ``most`` walks keeps them and is logged.
    """
    walks = {}
    for low, some in by_class(items).items():
        tests = trial_items(some, max_rate, np.random.default_rng((seed, low)), -(-least_tests // len(some)))
        need = {k: 1.0 if k == "unedited" else min(1.0, recall + (recall * (1 - recall) / len(t)) ** 0.5) for k, t in tests.items()}
        for n in range(1, most + 1):
            got = recall_by_kind(tests, Finder(some, max_rate, {low: n}))
            walks[low] = n
            if all(got[k] >= need[k] for k in need):
                break
        else:
            log.warning("items of %d to %d words: %d walks find only %s", low, 2 * low - 1, most, {k: round(got[k], 3) for k in need if got[k] < need[k]})
    return walks


def leaks(docs: DataFrame, benchmark: DataFrame, *, max_rate: float = 0.15, recall: float = 0.95, block_items: int = 1000) -> DataFrame:
    """(doc_id, item_id, edits, item_words, first_word, end_word): for every document and item, the best place with at most ``max_rate`` of the
    item's words edited, if there is one.

    ``recall`` is for items edited right up to the limit, wherever the edits fall, measured on edited items; unedited ones always line up. The benchmark is read in blocks of
    ``block_items`` items, each a bounded broadcast, so a large benchmark means more passes over the documents. Documents and items without
    words (null, empty) match nothing. Every row of ``docs`` is searched on its own: repeated rows give repeated results, a null doc_id gives a null
    doc_id. Of rows with one item_id, the last text counts; items without an id are skipped. Other columns are ignored.
    """
    cache = WordHashes()
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").orderBy("item_id", "text")
    schema = "doc_id string, item_id long, edits int, item_words int, first_word long, end_word long"

    def search(items: dict[int, np.ndarray]) -> DataFrame:
        walks = choose_walks(items, max_rate, recall)
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, words = Finder(shared.value, max_rate, walks), WordHashes()
            for b in batches:
                ids, texts = b["doc_id"].tolist(), b["text"].tolist()
                out, group, held = [], [], 0
                for k, t in enumerate(texts):
                    group.append(word_hashes(t, words))
                    held += len(group[-1])
                    if held > 500_000 or k == len(texts) - 1:
                        base = k + 1 - len(group)
                        out += [(ids[base + d], i, e, len(f.items[i]), s, z) for d, i, e, s, z in f.find(group)]
                        group, held = [], 0
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])
        return id_as_long(docs.select(id_as_text("doc_id"), F.col("text").cast("string")).mapInPandas(run, schema), "doc_id")

    found, block = None, {}
    for r in rows.toLocalIterator():
        if len(block) == block_items and r["item_id"] not in block:
            part = search(block)
            found, block = part if found is None else found.unionByName(part), {}
        block[r["item_id"]] = word_hashes(r["text"], cache)
    last = search(block)
    return last if found is None else found.unionByName(last)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows without doc_id stay; rows that repeat a doc_id go together."""
    gone = leaks(docs, benchmark, **options).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

"""Alignment of two tokenisers' tokens by the byte offsets where both end.

A stretch of a text's bytes gives a fragment: an open prefix (tokens up to the first common end), closed groups, an open suffix (tokens after the
last). Fragments of neighbouring stretches compose, whatever way they are bracketed: a suffix and the prefix behind it close one more group. So a very
long document is cut into byte ranges that are aligned in different tasks and composed eight at a time in rounds; any other document is one range.

Both vocabularies cut for certain before a single blank between other characters. A byte range may end anywhere: it is tokenised from the certain
cut before its start to the one behind its end, and owns the tokens that end inside it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_as_text, materialise, small_batches
from .token_counts import check_model, least_level

#: A certain cut of both vocabularies.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: The blank that one vocabulary writes as this character; a text that holds it cannot be given back.
MARK = "▁"
#: Characters whose classes no two versions of Unicode tell apart; texts of these take the faster of two equal encoders.
OTHER = re.compile("[^\t-\r -~\xa1-\u024f\u2010-\u2027]")
_NONE = np.empty(0, np.int64)


def pair_code(a, b):
    """An id pair as one number."""
    return (a << 32) | b


def summed(pairs: list[np.ndarray], links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their links."""
    if not pairs:
        return _NONE, _NONE
    p, n = np.concatenate(pairs), np.concatenate(links)
    order = np.argsort(p)
    p, n = p[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else _NONE
    return p[first], np.add.reduceat(n, first) if len(p) else _NONE


def group_text(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


@lru_cache(2)
def _endings(n: int) -> np.ndarray:
    """Numbers below ``n`` as text, followed by each of the three separators."""
    return np.array([f"{i}{c}" for c in ",|;" for i in range(n)], object)


def groups_text(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int) -> str:
    """The texts of ``n`` groups, joined. Every token has its place among all tokens, and the separator that follows it there."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    up_a, up_b = np.cumsum(na), np.cumsum(nb)
    size = 1 << int(max(a.max(), b.max())).bit_length()
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + (up_b - nb)[ga]] = a
    out[np.arange(len(b)) + up_a[gb]] = b
    ends = up_a + up_b
    out[ends - nb - 1] += size
    out[ends - 1] += 2 * size
    return "".join(_endings(size)[out].tolist())[:-1]


def group_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of one group with their links, without listing the links."""
    (ua, ka), (ub, kb) = (np.unique(x, return_counts=True) for x in (a, b))
    return pair_code(ua[:, None], ub[None, :]).ravel(), (ka[:, None] * kb[None, :]).ravel()


def all_pairs(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, n: int, listed: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of ``n`` groups with their links; ``ga`` and ``gb`` are the groups of the tokens, ascending. A group of more than ``listed`` links is not listed."""
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    pairs, links = [], []
    for g in np.flatnonzero(na * nb > listed):
        p, k = group_pairs(a[ga == g], b[gb == g])
        pairs.append(p), links.append(k)
    first = np.cumsum(nb) - nb
    times = np.where(na * nb > listed, 0, nb)[ga]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    p, k = np.unique(pair_code(np.repeat(a, times), b[np.repeat(first[ga], times) + at]), return_counts=True)
    return summed([*pairs, p], [*links, k]) if pairs else (p, k.astype(np.int64))


@dataclass
class Fragment:
    """What a stretch of bytes says: ``cut`` is whether both tokenisers end a token together in it (or at its start); without one, all tokens are prefix."""

    a_prefix: list[int] = field(default_factory=list)
    b_prefix: list[int] = field(default_factory=list)
    cut: bool = False
    groups: list[str] = field(default_factory=list)
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    links: np.ndarray = field(default_factory=lambda: _NONE)
    a_suffix: list[int] = field(default_factory=list)
    b_suffix: list[int] = field(default_factory=list)
    ok: bool = True

    def compose(self, other: Fragment) -> Fragment:
        n_a, n_b, ok = self.n_a + other.n_a, self.n_b + other.n_b, self.ok and other.ok
        if not self.cut:
            return Fragment(self.a_prefix + other.a_prefix, self.b_prefix + other.b_prefix, other.cut, other.groups, other.n_groups, n_a, n_b, other.pairs, other.links,
                            other.a_suffix, other.b_suffix, ok)
        a, b = self.a_suffix + other.a_prefix, self.b_suffix + other.b_prefix
        if not other.cut:
            return Fragment(self.a_prefix, self.b_prefix, True, self.groups, self.n_groups, n_a, n_b, self.pairs, self.links, a, b, ok)
        middle = Fragment.closed(a, b) if a or b else Fragment()
        pairs, links = summed([x.pairs for x in (self, middle, other)], [x.links for x in (self, middle, other)])
        return Fragment(self.a_prefix, self.b_prefix, True, [t for t in (*self.groups, *middle.groups, *other.groups)], self.n_groups + middle.n_groups + other.n_groups,
                        n_a, n_b, pairs, links, other.a_suffix, other.b_suffix, ok)

    @staticmethod
    def closed(a: list[int], b: list[int]) -> Fragment:
        pairs, links = group_pairs(np.array(a, np.int64), np.array(b, np.int64))
        return Fragment(cut=True, groups=[group_text(a, b)], n_groups=1, n_a=len(a), n_b=len(b), pairs=pairs, links=links)

    @staticmethod
    def of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
        """Fragment of consecutive tokens given by ids and byte offsets of their ends."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not len(common):
            return Fragment(a.tolist(), b.tolist(), n_a=len(a), n_b=len(b))
        i, j = (np.searchsorted(e, common, "right").tolist() for e in (a_ends, b_ends))  # tokens up to each common end
        ids_a, ids_b = a.tolist(), b.tolist()
        out = Fragment(ids_a[:i[0]], ids_b[:j[0]], True, n_a=len(a), n_b=len(b), n_groups=len(common) - 1, a_suffix=ids_a[i[-1]:], b_suffix=ids_b[j[-1]:])
        if out.n_groups:
            (a, ga), (b, gb) = ((ids[k[0]:k[-1]], np.searchsorted(common[1:], e[k[0]:k[-1]])) for ids, e, k in ((a, a_ends, i), (b, b_ends, j)))
            out.groups = [groups_text(a, ga, b, gb, out.n_groups)]
            out.pairs, out.links = all_pairs(a, ga, b, gb, out.n_groups)
        return out

    def whole(self) -> Fragment:
        """The fragment of a whole document: its start counts as a common end."""
        return Fragment(cut=True).compose(self)


class Aligner:
    """Both tokenisers and the byte lengths of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_padding(), self.a.no_truncation()
        self.a.encode_special_tokens = True
        check_model(self.b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as the character of that number
        symbol = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.a_bytes = {i: bytes(symbol[c] for c in t) for t, i in vocab.items() if i not in special} | {i: t.encode() for i, t in special.items()}
        self.b_bytes = {k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))}
        ranks = {v: k for k, v in self.a_bytes.items() if k not in special}
        self.a_bytes, self.b_bytes = ([x[k] for k in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        ordered = all(x < y for x, y in zip(merged, merged[1:])) and spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        #: merges of the same file in the order of their ids, so both encoders agree
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def ids_a(self, text: str) -> list[int]:
        if self.fast and not OTHER.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def stretch(self, text: str, low: int, high: int) -> Fragment:
        """Fragment of the tokens that end behind byte ``low`` and not behind byte ``high`` of a text that starts with a blank and starts and ends at certain cuts.

        The second tokeniser puts a blank before what it is given, so the first one is left to it.
        """
        raw, tokens = text.encode(), []
        for ids, known, size in ((self.ids_a(text), self.a_bytes, self.a_size), (self.b.encode(text[1:], num_threads=1), self.b_bytes, self.b_size)):
            if b"".join([known[i] for i in ids]) != raw:
                return Fragment(ok=False)
            ids = np.array(ids, np.int64)
            ends = np.cumsum(size[ids])
            mine = slice(*np.searchsorted(ends, (low, high), "right"))
            tokens += [ids[mine], ends[mine]]
        return Fragment.of(*tokens)

    def document(self, text: str | None) -> Fragment:
        """Fragment of a whole document in one range."""
        if not text or MARK in text:
            return Fragment()
        return self.stretch(" " + text, 0, len(text.encode()) + 1).whole()


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per Python worker."""
    return Aligner(a_path, b_path)


def _cut_before(text: str, x: int, least: int) -> int | None:
    at = text.rfind(" ", least, x + 1)
    while at > 0 and not CUT.match(text, at):
        at = text.rfind(" ", least, at)
    return at if at > 0 else None


def byte_ranges(text: str, size: int) -> list[tuple[str, int, int]]:
    """Stretches of about ``size`` characters: (the text from the cut before to the cut behind, first and last byte in it).

    Where no certain cut lies within half a size of a border, the border is left out, so no stretch is read more than twice.
    """
    borders = [(0, 0, 0)]
    for x in range(size, len(text), size):
        before, behind = _cut_before(text, x, x - size // 2), CUT.search(text, x, min(len(text), x + size // 2))
        if before is not None and behind:
            borders.append((x, before, behind.start()))
    borders.append((len(text), len(text), len(text)))
    return [(text[a:z], len(text[a:x].encode()), len(text[a:y].encode())) for (x, a, _), (y, _, z) in zip(borders, borders[1:])]


_DOC = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
_PART = ("row long, doc_id string, k long, a_prefix array<int>, b_prefix array<int>, cut boolean, groups string, n_groups long, n_a long, n_b long, pairs array<long>, links array<long>, "
         "a_suffix array<int>, b_suffix array<int>, ok boolean")
_FIELDS = [c.split(" ")[0] for c in _PART.split(", ")[3:]]


def _row(f: Fragment) -> list:
    return [";".join(f.groups) if c == "groups" else getattr(f, c) for c in _FIELDS]


def _fragment(r) -> Fragment:
    lists = {c: [int(i) for i in r[c]] for c in ("a_prefix", "b_prefix", "a_suffix", "b_suffix")}
    return Fragment(**lists, cut=bool(r["cut"]), groups=[r["groups"]] if r["n_groups"] else [], n_groups=int(r["n_groups"]), n_a=int(r["n_a"]), n_b=int(r["n_b"]),
                    pairs=np.asarray(r["pairs"], np.int64), links=np.asarray(r["links"], np.int64), ok=bool(r["ok"]))


def _document(f: Fragment) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, links of a whole document's fragment."""
    if not f.ok or not f.n_a:
        return 0, 0, 0, 0, "", _NONE, _NONE
    return f.n_a, f.n_b, f.n_groups, int(f.links.sum()), hashlib.sha256(";".join(f.groups).encode()).hexdigest(), f.pairs, f.links


def _documents(rows: list, ids: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
    out.insert(0, "row", [i[0] for i in ids])
    out.insert(1, "doc_id", [i[1] for i in ids])
    return out


def align_documents(docs: DataFrame, a_path: str, b_path: str, size: int) -> DataFrame:
    """One row per row of ``docs``, written to the shared folder: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked id pairs,
    see :func:`pair_code`) and links (their numbers). Documents of more than ``size`` characters are aligned by byte ranges."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), id_as_text("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > size

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(a_path, b_path)
        for b in batches:
            for at in range(0, len(b), 500):
                c = b.iloc[at:at + 500]
                yield _documents([_document(al.document(t)) for t in c["text"]], list(zip(c["row"], c["doc_id"])))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, doc_id, t in zip(b["row"], b["doc_id"], b["text"]):
                parts = byte_ranges(" " + t, size)
                yield pd.DataFrame({"row": row, "doc_id": doc_id, "k": range(len(parts)), "text": [p[0] for p in parts], "low": [p[1] for p in parts], "high": [p[2] for p in parts]})

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(a_path, b_path)
        for b in batches:
            for row, doc_id, k, t, low, high in b.itertuples(index=False):
                yield pd.DataFrame([[row, doc_id, k, *_row(al.stretch(t, low, high) if MARK not in t else Fragment(ok=False))]], columns=["row", "doc_id", "k", *_FIELDS])

    def compose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("k")
        f = reduce(Fragment.compose, [_fragment(r) for _, r in g.iterrows()])
        return pd.DataFrame([[key[0], g["doc_id"].iloc[0], key[1], *_row(f)]], columns=["row", "doc_id", "k", *_FIELDS])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _documents([_document(_fragment(r).whole()) for _, r in b.iterrows()], list(zip(b["row"], b["doc_id"])))

    parts = texts.where(is_long).mapInPandas(ranges, "row long, doc_id string, k long, text string, low long, high long").repartition(F.xxhash64("row", "k"))
    parts = materialise(parts.mapInPandas(fragments, _PART), "fragments")
    most = (parts.agg(F.max("k")).first()[0] or 0) + 1
    while most > 1:
        parts = parts.groupBy("row", F.floor(F.col("k") / 8).cast("long").alias("k8")).applyInPandas(compose, _PART)
        most = -(-most // 8)
        if most == 1:
            parts = materialise(parts, "composed")  # so that no task below holds two Python workers
    return materialise(texts.where(~is_long).mapInPandas(short, _DOC).unionByName(parts.mapInPandas(finish, _DOC)), "aligned")


def _counted(held: list[np.ndarray]) -> pd.DataFrame:
    pair, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"pair": pair, "n": n})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) over all ``aligned`` documents, and whether n is the highest of its first id. Written once."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, most = [], 0
        for b in batches:
            for p in b["pairs"]:
                held.append(np.asarray(p, np.int64))
                most += len(p)
                if most > 1_000_000:  # a batch of documents may hold many times that
                    yield _counted(held)
                    held, most = [], 0
        if held:
            yield _counted(held)

    each = aligned.select("pairs").mapInPandas(count, "pair long, n long")
    pairs = materialise(each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    best = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return materialise(pairs.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def token_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, *, size: int = 32_768, frequent: int = 400_000, batch: int = 500) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text with a blank before it is tokenised by a byte-level vocabulary, the text itself by a piece vocabulary that adds the blank; special tokens' strings are
    ordinary text. Offsets where tokens of both end cut the tokens into groups; all pairs of a group's tokens are links. ``n_best`` counts links
    whose id pair is held by as many documents as any pair of its first id (ties included), ``count_sum`` sums these document counts over links.

    Null and empty texts, and texts whose bytes one vocabulary does not give back (those with U+2581), have no tokens: zeros and an empty hash. Documents of more
    than ``size`` characters are cut into byte ranges; a stretch without a single blank between other characters stays in one range, as its tokens depend
    on all of it. Rows that repeat a doc_id count as documents each; other columns are ignored; an empty table gives an empty table.

    At most ``frequent`` pairs, the most frequent levels of them, are looked up in the scanning task (17 bytes each); a document's other pairs meet
    their counts in a shuffled join. A long group's links are counted by distinct ids, never listed. Tasks take ``batch`` documents at a time: the arrays of
    a default batch of 10,000 filled an executor, in Java and in Python.
    """
    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with small_batches(docs.sparkSession, batch):
        aligned = align_documents(docs, a_path, b_path, size)
        counts = pair_counts(aligned)
    levels = counts.withColumn("level", F.floor(8 * F.log2("n")))
    top = levels.where(F.col("level") >= least_level(levels.groupBy("level").agg(F.count("*").alias("k")).collect(), frequent)).select("pair", "n", "best").toPandas().sort_values("pair")
    known = docs.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, n, best = known.value
        for whole in batches:
            for first in range(0, len(whole), 500):  # what a slice gives goes on before the next one is made
                b = whole.iloc[first:first + 500]
                best_of, sum_of, rest, times = [], [], [], []
                for row, p, k in zip(b["row"], b["pairs"], b["links"]):
                    p, k = np.asarray(p, np.int64), np.asarray(k, np.int64)
                    at = np.searchsorted(pair, p)
                    hit = at < len(pair)
                    hit[hit] = pair[at[hit]] == p[hit]
                    at = at[hit]
                    best_of.append(int(k[hit][best[at]].sum()))
                    sum_of.append(int((k[hit] * n[at]).sum()))
                    rest.append(np.concatenate(([-1 - row], p[~hit])))  # the first stands for the document itself: it meets no pair
                    times.append(np.concatenate(([0], k[~hit])))
                yield b.drop(columns=["pairs", "links"]).assign(n_best=best_of, count_sum=sum_of, rest=rest, times=times)

    head = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    folded = aligned.mapInPandas(fold, _DOC.split(", pairs")[0] + ", n_best long, count_sum long, rest array<long>, times array<long>")
    with small_batches(docs.sparkSession, batch):
        folded = materialise(folded, "folded")
    each = folded.select("row", *head, F.posexplode(F.arrays_zip("rest", "times")).alias("k", "t"))
    each = each.select("row", *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in head], F.col("t.rest").alias("pair"), F.col("t.times").alias("times"))
    met = each.join(counts, "pair", "left")
    sums = {"n_best": F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)), "count_sum": F.sum(F.coalesce(F.col("times") * F.col("n"), F.lit(0)))}
    out = met.groupBy("row").agg(*[(F.max(c) + sums[c] if c in sums else F.max(c)).alias(c) for c in head])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *head[1:])

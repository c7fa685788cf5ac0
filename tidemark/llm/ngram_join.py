"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes its set of word 5-grams (lower-cased ``\\w+`` words; a text of one to four words has one n-gram, all of it), a 128-bit
   digest of the set and one hash per band of its MinHash signature. Bands and rows follow from the threshold and the recall asked for.
2. Texts with equal sets collapse into one class with a weight. Classes meet on band hashes (a shuffle); a class's home is the largest bucket it
   shares, and a home is cut into blocks of bounded row count and bounded n-gram count.
3. Each block verifies its own pairs; blocks that share a bucket verify across. A task holds two blocks. Pairs stay inside the task, which
   returns per class the number of links and a spanning link, so a group of k near copies costs k rows per block it meets, not k squared.
4. Spanning links give the connected components.

No bucket is capped: a hot bucket only has more blocks.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, components, fold, id_as_long, id_as_text, materialise, mix

WORD = re.compile(r"\w+")


def choose_bands(threshold: float, recall: float, max_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows per band for which a pair at the threshold still meets in some band with probability ``recall``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold ** rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if 0 < miss < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a sequence of word hashes."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    m = len(hashes) - size + 1
    h = np.full(m, size, U64)
    for k in range(size):
        h = fold(h, hashes[k:k + m])
    return np.unique(mix(h))


class Signer:
    def __init__(self, n: int, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.bands, self.rows = n, bands, rows
        self.mul = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.words = WordHashes()

    def grams(self, text: str | None) -> np.ndarray:
        return gram_set(self.words.of(WORD.findall(text.lower())) if text else np.empty(0, U64), self.n)

    def digest(self, grams: np.ndarray) -> bytes:
        return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> U64(32)).astype(np.uint32)[:, None]
        low = None
        for k in range(0, len(x), 512):
            part = ((x[k:k + 512] ^ self.xor) * self.mul).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        rows = low.astype(U64).reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=U64)
        for k in range(self.rows):
            h = fold(h, rows[:, k])
        return mix(h).view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, g, n_grams, bands): digest and band hashes of every text; g is null for a text without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Signer(n, bands, rows)
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"]):
                g = s.grams(t)
                out.append((i, s.digest(g), len(g), s.band_hashes(g)) if len(g) else (i, None, 0, None))
            yield pd.DataFrame(out, columns=["doc_id", "g", "n_grams", "bands"])
    return id_as_long(docs.select(id_as_text("doc_id"), F.col("text").cast("string")).mapInPandas(run, "doc_id string, g binary, n_grams int, bands array<long>"), "doc_id")


class Block:
    """Sets of one block over a common list of distinct n-grams."""

    def __init__(self, keys: list[bytes], weights: np.ndarray, universe: np.ndarray, codes: np.ndarray, sizes: np.ndarray):
        self.keys, self.weights, self.universe, self.codes, self.sizes = keys, weights, universe, codes, sizes

    @classmethod
    def build(cls, keys, weights, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(list(keys), np.asarray(weights, np.int64), universe, codes.astype(np.int32), sizes)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez_compressed(f, keys=np.frombuffer(b"".join(self.keys), np.uint8), weights=self.weights, universe=self.universe, codes=self.codes, sizes=self.sizes)
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes):
        z = np.load(io.BytesIO(blob))
        raw = z["keys"].tobytes()
        return cls([raw[k:k + 16] for k in range(0, len(raw), 16)], z["weights"], z["universe"], z["codes"], z["sizes"])


def verify(a: Block, b: Block | None, threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(key, key of a linked group's first member, links weighted by copies) for all members with a link; pairs within ``a``, or between ``a`` and ``b``."""
    own = b is None
    b = a if own else b
    if own:
        ca, cb, n = a.codes, a.codes, len(a.universe)
    else:
        u = np.union1d(a.universe, b.universe)
        ca, cb, n = np.searchsorted(u, a.universe)[a.codes], np.searchsorted(u, b.universe)[b.codes], len(u)
    na, shift = len(a.keys), 0 if own else len(a.keys)
    ends_a, starts_b = np.cumsum(a.sizes), np.cumsum(b.sizes) - b.sizes
    links_a, links_b = np.zeros(na, np.int64), np.zeros(len(b.keys), np.int64)
    label = np.arange(na + (0 if own else len(b.keys)))
    mark = np.zeros(n, np.int32)
    for i in range(na - 1 if own else na):
        mine = ca[ends_a[i] - a.sizes[i]:ends_a[i]]
        first = i + 1 if own else 0
        mark[mine] = 1
        both = np.add.reduceat(mark[cb[starts_b[first]:]], starts_b[first:] - starts_b[first])
        mark[mine] = 0
        hit = np.flatnonzero(both >= threshold * (a.sizes[i] + b.sizes[first:] - both) - 1e-9) + first
        if len(hit):
            links_a[i] += b.weights[hit].sum()
            links_b[hit] += a.weights[i]
            seen = np.unique(label[np.append(hit + shift, i)])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    links = links_a + links_b if own else np.concatenate([links_a, links_b])
    keys = a.keys if own else a.keys + b.keys
    return [(keys[k], keys[label[k]], int(links[k])) for k in np.flatnonzero(links)]


def ngram_links(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, max_hashes: int = 256, block_rows: int = 1024,
                block_grams: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    ``n_links`` counts the other documents whose n-gram set has Jaccard similarity of at least ``threshold`` (copies included); ``class_id`` is the
    least doc_id of the documents connected by links. ``recall`` is the probability to find a pair exactly at the threshold; nearer pairs are
    found more surely. A block holds about ``block_rows`` sets or ``block_grams`` n-grams, whichever is less, and at least one document.

    Null and wordless texts link to nothing and are their own class. Rows with a null doc_id have a null class of their own and count as
    documents of their copies' classes only. A repeated row counts as another copy. Other columns are ignored. An empty table gives an empty table.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    sig = materialise(signatures(docs, n, bands, rows), "signatures")
    sets = materialise(sig.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n_grams").alias("n_grams"),
                                                                  F.first("bands").alias("bands")), "sets")
    buckets = sets.where("rep is not null").select("g", F.explode("bands").alias("bucket"))
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = materialise(buckets.join(sizes, "bucket"), "shared")
    homes = materialise(shared.groupBy("g").agg(F.max(F.struct("size", "bucket")).alias("h")).select("g", F.col("h.bucket").alias("home"))
                        .join(sets.select("g", "rep", "weight", "n_grams"), "g"), "homes")
    cuts = materialise(homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n_grams") / block_grams)).alias("cuts")), "cuts")
    members = materialise(homes.join(cuts, "home").select("g", "rep", "weight", F.xxhash64("home", F.pmod(F.xxhash64("g"), "cuts")).alias("block")), "members")

    met = materialise(shared.select("g", "bucket").join(members.select("g", "block"), "g").select("bucket", "block").distinct(), "met")
    crossed = materialise(met.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket"), "crossed")
    met = materialise(met.join(crossed, "bucket"), "met")
    other = met.withColumnRenamed("block", "other")
    pairs = materialise(met.join(other, "bucket").where("block < other").select("block", "other").distinct(), "pairs")
    outer = pairs.select("block").union(pairs.select("other")).distinct().withColumn("outer", F.lit(True))

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    wanted = members.join(outer, "block", "left").select("g", "rep", "weight", "block", F.coalesce("outer", F.lit(False)).alias("outer"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Signer(n, 1, 1)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                grams = s.grams(r.text)
                if len(grams) and s.digest(grams) == bytes(r.g):  # a doc_id may stand on several texts
                    out.append((r.block, r.outer, r.g, r.weight, grams.tobytes()))
            yield pd.DataFrame(out, columns=["block", "outer", "g", "weight", "grams"])

    # one plan at every size: texts and members meet by a shuffle, which an executor's memory never limits
    grams = (texts.join(wanted.hint("merge"), "rep").select("g", "weight", "block", "outer", "text")
             .mapInPandas(to_sets, "block long, outer boolean, g binary, weight long, grams binary"))

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("g")
        block = Block.build([bytes(g) for g in b["g"]], b["weight"], [np.frombuffer(g, U64) for g in b["grams"]])
        found = verify(block, None, threshold)
        out = pd.DataFrame({"g": [x[0] for x in found], "root": [x[1] for x in found], "links": pd.array([x[2] for x in found], "Int64"), "block": pd.array([None] * len(found), "Int64"), "blob": None})
        if not b["outer"].iloc[0]:
            return out
        own = pd.DataFrame({"g": [None], "root": [None], "links": pd.array([None], "Int64"), "block": pd.array([b["block"].iloc[0]], "Int64"), "blob": [block.dump()]})  # a float would round the block's id
        return pd.concat([out, own], ignore_index=True) if found else own

    done = materialise(grams.groupBy("block").applyInPandas(inside, "g binary, root binary, links long, block long, blob binary"), "inside")
    blobs = done.where("blob is not null")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for r in b.itertuples(index=False) for x in verify(Block.load(r.blob), Block.load(r.blob2), threshold)]
            yield pd.DataFrame(out, columns=["g", "root", "links"])

    work = (pairs.join(blobs.select("block", "blob"), "block")
            .join(blobs.select(F.col("block").alias("other"), F.col("blob").alias("blob2")), "other").select("blob", "blob2"))
    links = materialise(done.where("g is not null").select("g", "root", "links").unionByName(work.mapInPandas(across, "g binary, root binary, links long")), "links")

    roots = components(links.select(F.col("g").alias("u"), F.col("root").alias("v")))
    linked = links.groupBy("g").agg(F.sum("links").alias("links"))
    named = materialise(sets.select("g", "rep", "weight").join(roots.select(F.col("node").alias("g"), "root"), "g", "left").join(linked, "g", "left")
                        .select("g", "rep", "weight", F.coalesce("root", "g").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    info = materialise(named.join(least, "root").select("g", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links")), "classes")
    return sig.select("doc_id", "g").join(info, "g", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose class has a smaller doc_id. Rows without doc_id stay; rows that repeat a doc_id share its fate."""
    gone = ngram_links(docs, **options).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

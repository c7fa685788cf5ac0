"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing: every token has a sparse random index vector; its word vector is the sum of the index vectors of its neighbours over the whole
corpus. Tokens are hashed to a fixed number of rows, so the sums have a fixed size: each task adds up its own documents and the partial
tables are summed by row block in a shuffle, read as a stream. A document is the mean, the spread and the mean neighbour product of its
unit word vectors, with its log length. A two-layer network is trained by numpy on a bounded sample of labelled rows; its logits are divided by a
temperature fitted on rows that it was not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, id_as_long, id_as_text, text_words
from .weak_toxicity import fold, labelled_sample

TOKEN, SPACE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+"), re.compile(r"\s")
ALL_CAPS = "\x01caps"
REACH, NONZERO = 2, 2


class Tokens:
    """Rows of a text's tokens: words in lower case, numbers, runs of marks; a word in capitals is preceded by a sign for it."""

    def __init__(self, rows: int):
        self.rows, self.hashes = rows, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        parts = []
        for ts in text_words(text or "", TOKEN, SPACE):
            out = []
            for t in ts:
                if len(t) > 1 and t.isupper():
                    out.append(ALL_CAPS)
                    t = t.lower()
                out.append(t)
            parts.append((self.hashes.of(out) % U64(self.rows)).astype(np.int32))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def index_vectors(rows: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of every row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (rows, NONZERO)), rng.choice([-1.0, 1.0], (rows, NONZERO))


def add_neighbours(table: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``table`` (rows, dim) the index vectors of all neighbours up to ``REACH`` tokens away in the same document."""
    rows, dim = table.shape
    for o in range(1, REACH + 1):
        same = doc[:-o] == doc[o:]
        left, right = ids[:-o][same].astype(np.int64), ids[o:][same].astype(np.int64)
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                table += np.bincount(a * dim + places[b, k], signs[b, k], rows * dim).reshape(rows, dim).astype(np.int32)


def word_vectors(docs: DataFrame, rows: int, dim: int, seed: int, block: int = 256) -> np.ndarray:
    """Unit word vectors (rows, dim) from all documents. The driver gets the summed table, whose size is fixed by ``rows`` and ``dim``."""
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, (places, signs) = Tokens(rows), index_vectors(rows, dim, seed)
        table, held, n = np.zeros((rows, dim), np.int32), [], 0

        def flush():
            if held:
                add_neighbours(table, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), places, signs)
                held.clear()

        for b in batches:
            for t in b["text"]:
                held.append(tokens.of(t))
                n += len(held[-1])
                if n > 1_000_000:
                    flush()
                    n = 0
        flush()
        yield pd.DataFrame({"block": range(0, rows, block), "part": [table[k:k + block].tobytes() for k in range(0, rows, block)]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b["block"], b["part"]):
                v = np.frombuffer(p, np.int32).astype(np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pd.DataFrame({"block": list(sums), "part": [v.tobytes() for v in sums.values()]}).astype({"block": "int64"})

    parts = docs.select(F.col("text").cast("string")).mapInPandas(gather, "block long, part binary").repartition("block").mapInPandas(total, "block long, part binary").collect()
    table = np.zeros((rows, dim))
    for r in parts:
        v = np.frombuffer(r["part"], np.int64).reshape(-1, dim)
        table[r["block"]:r["block"] + len(v)] = v
    norm = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return (table / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, ids: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Mean, standard deviation and mean product of neighbours of a document's word vectors, and its log length; zeros for no token."""
    dim = vectors.shape[1]
    if not len(ids):
        return np.zeros(3 * dim + 1, np.float32)
    s, q, p = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    for k in range(0, len(ids), chunk):
        v = vectors[ids[k:k + chunk + 1]]
        p += np.einsum("ij,ij->j", v[:-1], v[1:])
        v = v[:chunk]
        s += v.sum(axis=0)
        q += np.einsum("ij,ij->j", v, v)
    n = len(ids)
    mean = s / n
    return np.concatenate([mean, np.sqrt(np.maximum(q / n - mean**2, 0)), p / max(n - 1, 1), [np.log1p(n)]]).astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, a layer of tanh units and a logistic output, divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on four fifths of the rows; the rest choose the best epoch and the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[:len(x) // 5], order[len(x) // 5:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    xs = (x - mean) / scale
    best, kept = np.inf, [p.copy() for p in params]
    for _ in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), batch):
            rows = used[k:k + batch]
            h = np.tanh(xs[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - y[rows]) / len(rows)
            back = g[:, None] * params[2] * (1 - h**2)
            grads = [xs[rows].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for p, d, m, v in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d**2 - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        check = held if len(held) else used
        now = loss(np.tanh(xs[check] @ params[0] + params[1]) @ params[2] + params[3], y[check])
        if now < best:
            best, kept = now, [p.copy() for p in params]
    net = Network(mean, scale, kept[0], kept[1], kept[2], float(kept[3][0]))
    if len(held):
        z = net.logits(x[held])
        net.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 121)), key=lambda t: loss(z / t, y[held])))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def features(docs: DataFrame, vectors: np.ndarray, *columns: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(len(shared.value))
        for b in batches:
            yield b[list(columns)].assign(x=[pooled(shared.value, tokens.of(t)) for t in b["text"]])
    kinds = dict(docs.dtypes)
    return docs.select("text", *columns).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x array<float>")


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, rows: int = 1 << 15, dim: int = 32, seed: int = 17) -> QualityModel:
    """Word vectors from all of ``docs``, the network from at most ``max_rows`` labelled rows whose crc32(doc_id) mod 5 is not 0. Without a usable row the
    network answers one half for everything."""
    vectors = word_vectors(docs, rows, dim, seed)
    sample = features(labelled_sample(docs, labels, "quality", fold(5, 0), max_rows).repartition("doc_id"), vectors, "doc_id", "label").toPandas().sort_values("doc_id")
    if not len(sample):
        n = 3 * dim + 1
        return QualityModel(vectors, Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), 0.0))
    return QualityModel(vectors, train(np.stack(sample["x"]).astype(float), sample["label"].to_numpy(float)))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``docs``. Null and empty texts get the network's answer for a document without tokens; other
    columns are ignored; an empty table gives an empty table."""
    shared, network = docs.sparkSession.sparkContext.broadcast(model.vectors), model.network

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(len(shared.value))
        for b in batches:
            x = np.stack([pooled(shared.value, tokens.of(t)) for t in b["text"]]).astype(float) if len(b) else np.zeros((0, len(network.mean)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": network.scores(x)})
    return (id_as_long(docs.select(id_as_text("doc_id"), F.col("text").cast("string")).mapInPandas(run, "doc_id string, score double"), "doc_id")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))

"""Toxicity by weak supervision.

Many voters look for one lexicon word or one pattern (the first letters of a word) each: a short built-in list, and terms mined from a bounded
sample of labelled rows. A generative model with a hidden class, started from those labels, estimates from the votes how accurate each voter is and how
voters correlate within a class; correlated voters share their weight. Its posteriors are the soft targets of a linear classifier over present terms,
which then scores whole texts in one pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_WORD, U64, WordHashes, materialise, mix, text_words, word_hashes
from .ngram_join import gram_set
from .source_mix import uniform

#: Built-in lexicon voters: common insults of four languages. Mined voters extend it.
LEXICON = ("idiot moron loser scum trash clown stupid pathetic worthless disgusting dumb jerk fool liar filth vermin "
           "idioten dummkopf abschaum trottel widerlich erbärmlich crétin ordure minable dégoûtant imbécile estúpido basura asqueroso patético inútil").split()
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """A word's own term and its pattern terms (``xxxx*``: words that start so)."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def distinct_words(text: str | None) -> set[str]:
    out: set[str] = set()
    for ws in text_words((text or "").lower(), LETTERS, NO_WORD):
        out.update(ws)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``max_rows`` labelled rows outside the held-out fold, those with the least hashes of their ids; the bound makes the broadcast safe."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out)
    order = uniform(F.lit("sample"), F.col("doc_id"))
    near = usable.where(order < min(1.0, 1.2 * max_rows / max(usable.count(), 1)))  # so that the one task that cuts the sample gets a bounded number of rows
    ids = near.dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one row of each group of texts that agree on one of two MinHash values of their word 5-grams: what a text is copied for
    says nothing about toxicity, yet would make its rare words look telling. Ids and values of the bounded sample go through the driver."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for b in batches:
            sets = [gram_set(word_hashes(t, cache), 5) for t in b["text"]]
            yield b.assign(k1=[int(g.min() >> U64(1)) if len(g) else -i - 1 for i, g in zip(b["doc_id"], sets)],
                           k2=[int(mix(g ^ U64(12345)).min() >> U64(1)) if len(g) else -i - 1 for i, g in zip(b["doc_id"], sets)])

    all_rows = materialise(sample.repartition("doc_id").mapInPandas(keyed, "doc_id long, text string, label int, k1 long, k2 long"), "keyed-sample")
    ids = all_rows.select("doc_id", "label", "k1", "k2").toPandas().sort_values(["doc_id", "k1"])
    kept = ids.drop_duplicates(["label", "k1"]).drop_duplicates(["label", "k2"])["doc_id"].astype(int).tolist()
    rows = sample.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    return all_rows.select("doc_id", "label", "text").join(F.broadcast(rows), "doc_id")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@dataclass(frozen=True)
class LabelModel:
    prior: float
    accuracy: np.ndarray  # (voters,): probability of class 1 where a voter fires
    correlation: np.ndarray  # (voters, voters): of votes within a class
    share: np.ndarray  # weight left to each voter after sharing with correlated ones

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that does not fire abstains; a row on which all abstain is as likely toxic as such rows are in the model."""
        odds = np.log(self.accuracy / (1 - self.accuracy)) - np.log(self.prior / (1 - self.prior))
        z = np.log(self.prior / (1 - self.prior)) + votes @ (odds * self.share)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 30, smooth: float = 2.0) -> LabelModel:
    """Expectation-maximisation over a hidden class, from ``start`` (a first guess of the class of every row).

    Maximisation: a voter's accuracy is the mean posterior where it fires, drawn to the prior by ``smooth`` rows. Correlations are those of the
    votes around their class means; a voter's weight is divided by the sum of its correlations above one half, so near copies of a voter count once.
    """
    n, m = votes.shape
    q = start.astype(float)
    fired = votes.sum(axis=0)
    quiet = ~votes.any(axis=1)
    model = None
    for k in range(rounds):
        silent = float(np.clip(q[quiet].mean() if quiet.any() else 0.05, 1e-3, 0.5))
        accuracy = np.clip((votes.T @ q + smooth * silent) / (fired + smooth), silent, 1 - 1e-4)
        if k < 2:
            w, cov = np.stack([1 - q, q], axis=1), np.zeros((m, m))
            for c in (0, 1):
                r = votes - (votes.T @ w[:, c]) / max(w[:, c].sum(), 1e-9)
                cov += r.T @ (r * w[:, c:c + 1])
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / sd[:, None] / sd
            np.fill_diagonal(corr, 1.0)
            share = 1 / np.where(corr > 0.5, corr, 0.0).sum(axis=1)
        model = LabelModel(silent, accuracy, corr, share)
        new = model.posterior(votes)
        done = np.abs(new - q).max(initial=0) < 1e-6
        q = new
        if done:
            break
    return model


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, l2: float = 1e-6, rounds: int = 500, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse presence features and soft targets; the last entry is the bias (Adam steps)."""
    w, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + w[m]
        g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - target
        grad = np.append(np.bincount(cols, g[rows], m), g.sum()) / n
        grad[:m] += l2 * w[:m]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.999**k)) + 1e-10)
    return w[:m], float(w[m])


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    label_model: LabelModel
    voters: list[str]

    def score(self, text: str | None, cache: dict[str, tuple[str, ...]]) -> float:
        found: set[str] = set()
        for w in distinct_words(text):
            ts = cache.get(w)
            if ts is None:
                if len(cache) > 300_000:
                    cache.clear()
                ts = cache[w] = tuple(t for t in terms_of(w) if t in self.weights)
            if ts:
                found.update(ts)
        z = self.bias + sum(self.weights[t] for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, max_voters: int = 300, max_terms: int = 3_000, min_docs: int = 5) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows whose crc32(doc_id) mod 3 is not 1. Labels choose the terms worth a voter and start the label model.

    The driver gets term counts of at most ``max_terms`` terms and their hits in the sample, never texts. With no usable row the built-in voters stay.
    """
    sample = materialise(without_copies(labelled_sample(docs, labels, "toxic", fold(3, 1), max_rows)), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame], only: int, wanted: frozenset | None) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t, y in zip(b["text"], b["label"]):
                if y == only:
                    c.update({x for w in distinct_words(t) for x in terms_of(w) if wanted is None or x in wanted})
        if c:
            yield pd.DataFrame({"term": list(c), "n": list(c.values())})

    def counts(only: int, wanted: frozenset | None = None) -> DataFrame:
        return sample.select("text", "label").mapInPandas(lambda bs: count(bs, only, wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    often = counts(1).where(F.col("n") >= min_docs).orderBy(F.desc("n"), "term").limit(20 * max_terms).collect()
    hits = {r["term"]: r["n"] for r in often} | {t: 0 for t in LEXICON if t not in {r["term"] for r in often}}
    misses = {r["term"]: r["n"] for r in counts(0, frozenset(hits)).collect()}
    odds = {t: np.log((h + 0.5) / (pos + 1)) - np.log((misses.get(t, 0) + 0.5) / (neg + 1)) for t, h in hits.items()}
    sure = {t: odds[t] - 2 * np.sqrt(1 / (h + 0.5) + 1 / (misses.get(t, 0) + 0.5)) for t, h in hits.items()}  # lower bound of the log odds ratio
    telling = sorted((t for t in hits if sure[t] > 1.5 or t in LEXICON), key=lambda t: (-sure[t], t))[:max_terms]
    voters, index = telling[:max_voters], {t: k for k, t in enumerate(telling)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "terms": [sorted({index[x] for w in distinct_words(t) for x in terms_of(w) if x in index}) for t in b["text"]], "label": b["label"]})

    rows = sample.select("doc_id", "text", "label").mapInPandas(find, "doc_id long, terms array<int>, label int").orderBy("doc_id", "terms").collect()
    r = np.array([k for k, x in enumerate(rows) for _ in x["terms"]], np.int64)
    c = np.array([t for x in rows for t in x["terms"]], np.int64)
    votes = np.zeros((len(rows), len(voters)))
    mine = c < len(voters)
    votes[r[mine], c[mine]] = 1
    prior = float(np.clip(pos / max(pos + neg, 1), 0.01, 0.5))
    if not len(rows):
        m = len(voters)
        none = LabelModel(prior, np.full(m, 0.9), np.eye(m), np.ones(m))
        return ToxicityModel(dict.fromkeys(voters, 3.0), -2.0, none, voters)
    model = fit_label_model(votes, np.array([x["label"] for x in rows]))
    w, b = logistic(r, c, len(rows), len(telling), model.posterior(votes))
    return ToxicityModel({t: float(w[k]) for t, k in index.items() if w[k]}, b, model, voters)


def score_column(model: ToxicityModel, text: Column) -> Column:
    """Score of a text between 0 and 1, null and empty texts included."""
    shared = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            yield pd.Series([shared.score(t, cache) for t in texts], dtype="float64")

    return score(text.cast("string"))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``docs``. Null and empty texts get the score of a text without any term; other columns are ignored."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, F.col("text")).alias("score"))
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or more; all columns and clashing names stay as they are."""
    return docs.where(score_column(model, F.col("text")) < threshold)

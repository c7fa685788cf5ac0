"""Language identification by Bayesian evidence fusion.

For every page: the likelihood of its text under character trigram models of the labelled documents, the likelihood of its declared markup language,
the likelihood of its address suffix, and the prior of its host, smoothed towards its domain and the whole. The likelihoods of declarations and
suffixes and the host priors are soft counts: grouped sums, over all pages, of the posterior that text alone gives.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, id_as_long, id_as_text, materialise

BINS = 1 << 16
HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
TAG, NO_LETTER = re.compile(r"<[^>]*>"), re.compile(r"[\W\d_]+")
DECLARED = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def trigrams(text: str | None, chunk: int = 1 << 20) -> np.ndarray:
    """Hashed character trigrams of the lower-cased letters of a text, runs of anything else being one blank."""
    t = NO_LETTER.sub(" ", (text or "").lower()).strip()
    if not t:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(U64)
    h = c[:-2] * U64(0x9E3779B97F4A7C15) + c[1:-1] * U64(0xC2B2AE3D27D4EB4F) + c[2:] * U64(0x165667B19E3779F9)
    return ((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(48)).astype(np.int64)


def visible(page: str | None) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return markup.unescape(TAG.sub(" ", HIDDEN.sub(" ", page or "")))


def models(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities (languages, bins)) from all of ``docs`` with a language; tables of fixed size are summed as a stream per language."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b["lang"], b["text"]):
                ids = trigrams(t)
                table = tables.setdefault(lang, np.zeros(BINS, np.int64))
                if len(ids) > BINS // 8:
                    table += np.bincount(ids, minlength=BINS)
                else:
                    np.add.at(table, ids, 1)
        if tables:
            yield pd.DataFrame({"lang": list(tables), "part": [v.tobytes() for v in tables.values()]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, p in zip(b["lang"], b["part"]):
                v = np.frombuffer(p, np.int64)
                sums[lang] = sums[lang] + v if lang in sums else v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "part": [v.tobytes() for v in sums.values()]})

    texts = docs.select(F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string")).where("lang is not null and lang <> ''")
    rows = texts.mapInPandas(count, "lang string, part binary").repartition("lang").mapInPandas(total, "lang string, part binary").orderBy("lang").collect()
    table = np.stack([np.frombuffer(r["part"], np.int64) for r in rows]).astype(float) if rows else np.zeros((0, BINS))
    return [r["lang"] for r in rows], np.log((table + smooth) / (table + smooth).sum(axis=1, keepdims=True))


def softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def soft_counts(pages: DataFrame, key: str, k: int) -> DataFrame:
    """(key, c0..): sums of the text posteriors over a key's pages, folded before the shuffle. Null keys are no evidence and are left out."""
    return pages.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(f"q{j}").alias(f"{key}_c{j}") for j in range(k)])


def identify(pages: DataFrame, docs: DataFrame, *, text_weight: float = 0.2, host_rows: float = 20.0, domain_rows: float = 50.0, smooth: float = 1.0) -> DataFrame:
    """One row per row of ``pages``: page_id, lang, score (posterior of lang), text_lang (by text alone), declared, suffix, host.

    ``text_weight`` discounts the log likelihood of overlapping trigrams. A page's own soft count is taken out of its host's and domain's before they
    serve as its prior; ``host_rows`` and ``domain_rows`` are the weights, in pages, of the next wider prior. A missing text, declaration, suffix or
    host is no evidence; a page without any gets the most frequent language. Ties go to the first language by name. Without labelled documents lang
    and score are null. Repeated rows count as often as they stand; other columns are ignored; an empty table gives an empty table.
    """
    langs, logp = models(docs)
    k = len(langs)
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lower(F.nullif(F.regexp_extract(F.col("url").cast("string"), HOST, 1), F.lit(""))).alias("host"),
                        F.lower(F.nullif(F.regexp_extract(F.col("html").cast("string"), DECLARED, 1), F.lit(""))).alias("declared"), F.col("html").cast("string").alias("html"))
    if not k:
        return kept.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("text_lang"),
                           "declared", F.substring_index("host", ".", -1).alias("suffix"), "host")
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    def likelihoods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            ll = np.stack([table[trigrams(visible(t))].sum(axis=0) for t in b["html"]]) if len(b) else np.zeros((0, k))
            yield b[["page_id", "host", "declared"]].assign(**{f"t{j}": ll[:, j] * text_weight for j in range(k)})

    schema = "page_id string, host string, declared string, " + ", ".join(f"t{j} double" for j in range(k))
    text = id_as_long(kept.withColumn("page_id", id_as_text("page_id")).mapInPandas(likelihoods, schema), "page_id").withColumns({f"q{j}": q for j, q in enumerate(softmax([F.col(f"t{j}") for j in range(k)]))})
    rows = materialise(text.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)}), "page-evidence")

    whole = rows.agg(*[F.sum(f"q{j}").alias(f"c{j}") for j in range(k)], F.count("*").alias("n")).first()
    total = [float(whole[f"c{j}"] or 0.0) for j in range(k)]
    base = [(c + smooth) / (sum(total) + smooth * k) for c in total]
    found = rows
    for key in ("declared", "suffix", "domain", "host"):
        counts = materialise(soft_counts(rows, key, k), f"counts-{key}")
        found = found.join(counts.withColumnRenamed(key, f"{key}_key"), F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")

    def likelihood(key: str, j: int) -> Column:
        """Log of P(value of key | language), against P(value of key)."""
        all_of = sum((F.col(f"{key}_c{i}") for i in range(1, k)), F.col(f"{key}_c0"))
        own = (F.col(f"{key}_c{j}") + smooth * all_of / (sum(total) or 1.0)) / (total[j] + smooth)
        return F.when(F.col(key).isNotNull(), F.log(own)).otherwise(0.0)

    def prior(key: str, j: int, wider: Column, weight: float) -> Column:
        others = sum((F.col(f"{key}_c{i}") for i in range(1, k)), F.col(f"{key}_c0")) - 1.0
        mine = F.greatest(F.col(f"{key}_c{j}") - F.col(f"q{j}"), F.lit(0.0))
        return F.when(F.col(key).isNotNull(), (mine + weight * wider) / (F.greatest(others, F.lit(0.0)) + weight)).otherwise(wider)

    found = found.withColumns({f"d{j}": prior("domain", j, F.lit(base[j]), domain_rows) for j in range(k)})
    found = found.withColumns({f"z{j}": F.col(f"t{j}") + likelihood("declared", j) + likelihood("suffix", j) + F.log(prior("host", j, F.col(f"d{j}"), host_rows)) for j in range(k)})
    found = found.withColumns({f"p{j}": p for j, p in enumerate(softmax([F.col(f"z{j}") for j in range(k)]))})

    def best(prefix: str) -> Column:
        return F.array_max(F.array(*[F.struct(F.col(f"{prefix}{j}").alias("p"), F.lit(-j).alias("order"), F.lit(langs[j]).alias("lang")) for j in range(k)]))

    chosen = best("p")
    return found.select("page_id", chosen["lang"].alias("lang"), chosen["p"].alias("score"), best("q")["lang"].alias("text_lang"), "declared", "suffix", "host")

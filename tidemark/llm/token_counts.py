"""Token counts from pre-token counts: no token id is ever materialised for a document.

A vocabulary without a piece that holds a blank after another character never merges across a blank, so a text's pieces are those of its
pre-tokens: runs of blanks with the word that follows. Pre-tokens are counted over the corpus, each distinct one is tokenised once, and the
number of its pieces is joined to every document's pre-token frequencies. The most frequent pre-tokens, a table of bounded size, are joined inside
the scanning task, where a text is folded to one number; only rarer pre-tokens are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_as_text, materialise

#: A pre-token: blanks with what follows up to the next blank. Blanks are U+0020 and U+2581, which these models write for it.
SPACE = "\u2581"
PRE_TOKEN, PRE_TOKEN_START = re.compile("[ \u2581]+[^ \u2581]*|[^ \u2581]+"), re.compile("(?<=[^ \u2581])[ \u2581]")


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise unless counts of pre-tokens add up under this model."""
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) or " " in p for p in pieces):
        raise ValueError("a piece of this model holds a blank after another character, so pre-tokens cannot be counted apart")
    if model.normalize(" \u00bd  a ") != f"{SPACE * 2}\u00bd{SPACE * 2}a{SPACE}":  # one blank goes in front, nothing else changes
        raise ValueError("this model's normaliser changes texts, so pre-tokens cannot be counted apart")


def pre_tokens(text: str | None, size: int = 1 << 20) -> Counter:
    """Pre-token frequencies of a text as the model sees it, with its dummy blank in front; so every pre-token starts with a blank."""
    c: Counter = Counter()
    if not text:
        return c
    text, at = " " + text, 0
    while at < len(text):
        cut = PRE_TOKEN_START.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        c.update(PRE_TOKEN.findall(text, at, end))
        at = end
    return c


def piece_counts(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[int]:
    """Pieces of pre-tokens. The model puts a blank before what it is given, unless that is empty, so the first blank of a pre-token is left to it."""
    return [len(x) if t[1:] else 1 for t, x in zip(tokens, model.encode([t[1:] for t in tokens], num_threads=1))] if tokens else []


def least_level(sizes: list, most: int) -> int:
    """The lowest level such that it and all above hold at most ``most`` rows in all."""
    least, held = 1 << 30, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["k"]
        if held > most:
            break
        least = r["level"]
    return least


def token_counts(docs: DataFrame, model_path: str | None = None, *, limit: int = 4096, frequent: int = 100_000, longest: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Tokens are those of the library's plain ``encode``: no begin or end token, special strings are ordinary text. Null counts as empty, and an
    empty text has no tokens. At most ``frequent`` pre-tokens of at most ``longest`` characters, the most frequent levels of them, are joined in the scanning task (at most
    frequent * 4 * longest bytes, 26 MB by default); the exact counts of all others come from a shuffled join. Rows that repeat a doc_id are
    counted each; other columns are ignored; an empty table gives an empty table.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    check_model(load(path))
    texts = docs.select(id_as_text("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def corpus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(pre_tokens(t))
                if len(c) > 400_000:
                    yield pd.DataFrame({"token": list(c), "n": list(c.values())})
                    c.clear()
        if c:
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for b in batches:
            if len(b):
                yield pd.DataFrame({"token": b["token"], "n": b["n"], "pieces": piece_counts(model, b["token"].tolist())})

    vocabulary = materialise(texts.select("text").mapInPandas(corpus, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
                             .mapInPandas(tokenise, "token string, n long, pieces long"), "vocabulary")
    short = vocabulary.where(F.length("token") <= longest).withColumn("level", F.floor(8 * F.log2("n")))
    top = short.where(F.col("level") >= least_level(short.groupBy("level").agg(F.count("*").alias("k")).collect(), frequent)).select("token", "pieces").toPandas()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["token"], (int(x) for x in top["pieces"]))))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = known.value
        for b in batches:
            tokens, times = [], []
            for row, t in zip(b["row"], b["text"]):
                c = pre_tokens(t)
                own = {w: k for w, k in c.items() if w not in pieces}
                tokens.append([f"#{row}", *own])  # no pre-token starts with "#": all start with a blank
                times.append([sum(pieces[w] * k for w, k in c.items() if w in pieces), *own.values()])
            if tokens:
                yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in b["text"]], "tokens": tokens, "times": times})

    # the first entry of a text holds the pieces of its frequent pre-tokens: it meets no row of the vocabulary and counts one each
    each = (texts.withColumn("row", F.monotonically_increasing_id()).mapInPandas(fold, "row long, doc_id string, n_bytes long, tokens array<string>, times array<long>")
            .select("row", "doc_id", "n_bytes", F.posexplode(F.arrays_zip("tokens", "times")).alias("k", "t"))
            .select("row", F.when(F.col("k") == 0, F.col("doc_id").cast("long")).alias("doc_id"), F.when(F.col("k") == 0, F.col("n_bytes")).alias("n_bytes"), F.col("t.tokens").alias("token"), F.col("t.times").alias("times")))
    n = F.sum(F.col("times") * F.coalesce("pieces", F.lit(1)))
    return (each.join(vocabulary.select("token", "pieces"), "token", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n.alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))

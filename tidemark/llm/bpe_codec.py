"""Byte-pair encoding by forced boundaries, and decoding.

A merge makes a token of the vocabulary, so no merge ever spans two bytes that stand side by side in no token: between them is a certain cut, and
the parts on either side can be encoded apart. White space stands in no token of this kind of vocabulary, so a text falls into its words first; a
word falls, after the library's normaliser and pre-tokeniser, at every other certain cut. A part that ends a pre-token takes the
end-of-word mark, any other is encoded without it. Equal parts are encoded once in a task and their ids concatenated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from .common import id_as_text, text_words

#: Words of a text and the white space between them, both in ASCII only: other blanks are left to the library's normaliser.
WORD, BLANK = re.compile(r"[^\x09-\x0d ]+"), re.compile(r"[\x09-\x0d ]")
#: Words of these characters are composed already, have plain lower cases and classes that no two versions of Unicode tell apart, so the library's
#: normaliser and pre-tokeniser (checked by :func:`latin_rule`) are one lower-casing and one pattern; all other words go through the library.
LATIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]+|[\\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\\w\\s]|_)+")


#: A slice of a text, and one whose words are all of the characters above.
SLICE, LATIN_TEXT = re.compile("(?s:.+)"), re.compile("[\x09-\x0d -~\xa1-\u012f\u0131-\u024f]*")


def certain_cuts(tokens: list[str], suffix: str) -> set[str]:
    """Pairs of neighbouring symbols (one per byte) inside some token; every pair outside this set is a certain cut."""
    inside: set[str] = set()
    for t in tokens:
        t = t.removesuffix(suffix) if suffix else t
        inside.update(t[k:k + 2] for k in range(len(t) - 1))
    return inside


def latin_rule(spec: dict) -> bool:
    """Whether a vocabulary file composes, folds white space, lower-cases and splits as :data:`PRE_TOKEN` does."""
    norm, pre = spec["normalizer"], spec["pre_tokenizer"]
    return (norm is not None and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and norm["normalizers"][1]["content"] == " " and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["pattern"] == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
            and pre["pretokenizers"][0]["behavior"] == "Removed" and pre["pretokenizers"][0]["invert"]
            and not pre["pretokenizers"][1]["add_prefix_space"] and not pre["pretokenizers"][1]["use_regex"])


class PreTokens(dict):
    """Ids of lower-cased pre-tokens of :data:`LATIN` characters, bounded as the words of ``codec`` are."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.codec.pre_token(self.codec.as_symbols(pre_token))
        out = pack(f"<{len(ids)}I", *ids)
        if len(pre_token) <= self.codec.longest:
            if len(self) >= self.codec.limit:
                self.clear()
            self[pre_token] = out
        return out


class Codec(dict):
    """Encoder and decoder of one vocabulary; a dict of the words it has met, bounded by ``limit`` words of at most ``longest`` characters."""

    def __init__(self, path: str, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest, self.whole = limit, longest, Tokenizer.from_file(path)
        self.whole.no_padding(), self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        if model["continuing_subword_prefix"] or model["byte_fallback"] or model["unk_token"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("this kind of vocabulary is not encoded by parts")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inside = certain_cuts(list(model["vocab"]), self.suffix)
        self.open = models.BPE(vocab=model["vocab"], merges=merges)  # for parts that do not end a word
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = [self.whole.id_to_token(k) for k in range(self.whole.get_vocab_size())]
        self.parts: dict[str, list[int]] = {}
        self.latin_ids = PreTokens(self)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as the character of that number
        self.symbols = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.latin = latin_rule(spec)
        if any(BLANK.search(t) for t in self.special) or self.encode("a b\n\tc d ").tobytes() != self.by_library("a b\n\tc d ").tobytes():
            raise ValueError("white space is not a certain cut of this vocabulary")

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def part(self, part: str, ends: bool) -> list[int]:
        """Ids of a part between two certain cuts; ``ends`` if it ends its pre-token."""
        key = part + " " if ends else part
        ids = self.parts.get(key)
        if ids is None:
            ids = [t.id for t in (self.whole.model if ends else self.open).tokenize(part)]
            if len(part) <= self.longest:
                if len(self.parts) >= self.limit:
                    self.parts.clear()
                self.parts[key] = ids
        return ids

    def pre_token(self, symbols: str) -> list[int]:
        pairs = [*map(add, symbols, symbols[1:])]
        if self.inside.issuperset(pairs):
            return self.part(symbols, True)
        cuts = [k for k, pair in enumerate(pairs, 1) if pair not in self.inside]
        return [i for a, b in zip([0, *cuts], [*cuts, len(symbols)]) for i in self.part(symbols[a:b], b == len(symbols))]

    def as_symbols(self, piece: str) -> str:
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)

    def pre_tokens(self, piece: str) -> list[str]:
        """Pre-tokens of a piece of text, one symbol per byte."""
        if self.latin and LATIN.fullmatch(piece):
            return [self.as_symbols(p) for p in PRE_TOKEN.findall(piece.lower())]
        return [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(piece))]

    def __missing__(self, word: str) -> bytes:
        ids: list[int] = []
        for piece in self.special_at.split(word) if self.special_at else [word]:
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for symbols in self.pre_tokens(piece):
                    ids += self.pre_token(symbols)
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out

    def slices(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text as little-endian 32-bit integers, in slices of about a million characters.

        A slice of Latin words without special tokens falls into its pre-tokens at once: their pattern never spans white space, and they are fewer
        than the words, which differ by capitals and punctuation too. Any other slice goes word by word.
        """
        for piece, in text_words(text or "", SLICE, BLANK):
            if self.latin and LATIN_TEXT.fullmatch(piece) and not any(s in piece for s in self.special):
                yield b"".join(map(self.latin_ids.__getitem__, PRE_TOKEN.findall(piece.lower())))
            else:
                yield b"".join(map(self.__getitem__, WORD.findall(piece)))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.slices(text)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with blanks between them, as the library gives them where no decoder is set; ids outside the vocabulary are skipped."""
        tokens, n = self.token, len(self.token)
        return " ".join([tokens[i] for i in ids.tolist() if i < n])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, their hash, and the hash of the text decoded from them, slice by slice."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
        for raw in self.slices(text):
            if raw:
                of_ids.update(raw)
                of_text.update((" " * (n > 0) + self.decode(np.frombuffer(raw, "<u4"))).encode())
                n += len(raw) // 4
        return n, of_ids.hexdigest(), of_text.hexdigest()


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary file."""
    return Codec(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit integers, as binary).

    Ids are those of the library without added special tokens, padding or truncation; a special token's string inside a text is that token, as the
    library's default has it. Null counts as empty and an empty text has no ids. Rows that repeat a doc_id are encoded each, whole texts of any
    length in slices; other columns are ignored, an empty table gives an empty table. Nothing is shuffled.
    """
    path = _path(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [c.encode(t).tobytes() for t in b["text"]]})

    return docs.select(id_as_text("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id string, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id, text, the decoded ids. Null ids count as none."""
    path = _path(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [c.decode(np.frombuffer(x or b"", "<u4")) for x in b["ids"]]})

    return encoded.select(id_as_text("doc_id"), "ids").mapInPandas(run, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``, by :class:`Codec` in one pass; cases as in :func:`encode_documents`."""
    path = _path(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            rows = [c.digests(t) for t in b["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return (docs.select(id_as_text("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long")))

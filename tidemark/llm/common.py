"""Helpers shared by the operators: intermediate tables, stable hashes, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

U64 = np.uint64
_P1, _P2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; every executor reaches it."""
    return f"{shared_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: short lineage, safe from lost executors, columns still pruned."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks written within take at most ``rows`` rows at a time: for rows that hold long texts or arrays. The session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_as_text(name: str) -> Column:
    """An id column for Python tasks: pandas would turn a long column with nulls into floats, which round large ids."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_as_long(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """Word to 64-bit hash, remembered. ``trim`` between documents bounds the memory."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), U64, len(words))
        if len(self) > self.limit:
            self.clear()
        return out


def text_words(text: str, pattern: re.Pattern, gap: re.Pattern, size: int = 1 << 20) -> Iterator[list[str]]:
    """``pattern.findall`` over the whole text in slices of about ``size`` characters that end where ``gap`` matches, so that lists stay small."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield pattern.findall(text, at, end)
        at = end


WORD, NO_WORD = re.compile(r"\w+"), re.compile(r"\W")


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased ``\\w+`` words of a text; none for null."""
    if not text:
        return np.empty(0, U64)
    parts = [cache.of(ws) for ws in text_words(text.lower(), WORD, NO_WORD)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * _P2
    h = (h ^ (h >> U64(29))) * _P1
    return h ^ (h >> U64(32))


def fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of hashes, element by element."""
    h = (h ^ x) * _P1
    return h ^ (h >> U64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, root) for every node of ``edges`` (u, v), root being the component's least node.

    Large-star and small-star rounds over the distributed edge list, each written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Stars, the usual input here, settle in the first round.
    """
    def oriented(e):
        return e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def print_of(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()

    e = materialise(oriented(edges), "edges")
    seen = print_of(e)
    while seen["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = oriented(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialise(oriented(small), "edges")
        now = print_of(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

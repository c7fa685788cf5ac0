"""Mixing sources to target weights by Poisson replication. Built-in expressions only.

Each source gets a mean repetition rate: its share of the target over its share of the corpus. A document's number of copies inverts the Poisson
distribution with that mean at a uniform number hashed from the seed and the document's id, so it never depends on partitioning or on a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def uniform(*parts) -> Column:
    """A number in (0, 1) from the md5 of the parts, null parts written as ``null``; 52 bits, so that every value is exact."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_rates(docs: DataFrame, targets: DataFrame | None = None, *, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, size, rate): characters and mean repetition rate of every source.

    The target is ``epochs`` times the corpus, split by ``targets`` (source, weight), or by size to the power ``alpha`` if none are given. A source
    without characters, or with no row in ``targets``, has no share of its own: the former is repeated ``epochs`` times on average, the latter never.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).cast("double").alias("size"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        given = targets.select(F.col("source").cast("string").alias("named"), F.col("weight").cast("double").alias("given"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "size", F.when(F.col("size") > 0, F.coalesce("given", F.lit(0.0))).otherwise(0.0).alias("weight"))
    sizes = materialise(sizes, "sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(epochs * (total["size"] or 0.0))
    return sizes.select("source", "size", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(float(epochs))).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, rate, cdf): cumulative Poisson probabilities from 0 up to where no double below 1 is left."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    ks = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    upto = W.partitionBy("source").orderBy("k")
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("lf"))).otherwise((F.col("k") == 0).cast("double"))
    steps = ks.withColumn("lf", F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(0.0)).over(upto)).withColumn("c", F.sum(p).over(upto))
    return steps.groupBy("source").agg(F.first("rate").alias("rate"), F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("cdf"))


def copies(docs: DataFrame, targets: DataFrame | None = None, *, seed: int = 7, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``docs`` with ``n_copies``, the least count whose cumulative probability reaches the document's number."""
    tables = materialise(poisson_tables(source_rates(docs, targets, alpha=alpha, epochs=epochs)), "poisson").select(F.col("source").alias("named"), "cdf")
    packed = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("source"), uniform(F.lit(seed), F.col("doc_id")).alias("u"))  # other columns cannot clash
    counted = packed.join(tables, F.col("source").eqNullSafe(F.col("named"))).select("doc", F.size(F.filter("cdf", lambda c: c < F.col("u"))).alias("n_copies"))
    return counted.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "n_copies"], "n_copies")


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, *, seed: int = 7, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """The mixed corpus: every document as often as its ``n_copies``, numbered from 1 by ``copy``, in random order.

    ``shuffle_key`` is hashed from seed, doc_id and copy; rows are dealt over partitions by it and sorted within them, which is a uniformly random
    order of the whole. Sources are compared as they are, null being one more source; null and empty texts count no characters and are
    repeated like their source. Rows that repeat a doc_id get equal numbers of copies each. Extra columns are kept, but ones named ``n_copies``,
    ``copy`` or ``shuffle_key`` are replaced. An empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in ("n_copies", "copy", "shuffle_key")]
    each = copies(docs.select(*names), targets, seed=seed, alpha=alpha, epochs=epochs).where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = each.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy")))
    return keyed.select(*names, "n_copies", "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")

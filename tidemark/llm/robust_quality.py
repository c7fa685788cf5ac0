"""Quality rules and robust multivariate outliers. Built-in expressions only.

Per-document counts become a vector of transformed statistics. For every language and source, deterministic minimum-covariance-determinant steps
run from two starts until no determinant falls any more; the estimate of least determinant is that of the half-and-more of the documents whose covariance
is tightest, and a document far from its centre by Mahalanobis distance is rejected. Groups are shrunk to their language and to the whole, in
proportion to their size, so small groups behave like large ones.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .secret_scan import let

log = logging.getLogger(__name__)

#: What separates words, and the symbols that are counted.
BLANKS, WORD, SYMBOLS = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+", "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Statistics and the standard deviation below which their spread is taken for degenerate (a group without any symbol has none).
VECTOR = {"x1": 0.05, "x2": 0.25, "x3": 0.35, "x4": 0.2, "x5": 0.05}


def removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hashes within one text."""
    def positions(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, o: F.coalesce(F.get(s, k + o)["h"] == F.get(s, k)["h"], F.lit(False))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: same(s, k, -1) | same(s, k, 1)), lambda e: e["i"])))

    def covered(at):
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    def count(w):
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(positions(h)))))

    return let(words, count)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, base_failed); null texts have no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                      counted.alias("w"), (F.length(text) - removed(text, BLANKS)).cast("long").alias("word_chars"), removed(text, SYMBOLS).cast("long").alias("n_symbols"),
                      dup.cast("long").alias("n_dup_lines"), removed(text, CAPITALS).cast("long").alias("n_capitals"))
    n, r = F.col("w.n").cast("long"), F.col("w.r").cast("long")
    return out.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), "n_capitals",
                      ((n < 50) | (100 * r > 50 * n)).alias("base_failed"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x1..x5: log mean word length, log symbols and repeated lines per 100 words, root share of repeated words, root share of capitals."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x2": F.log1p(100 * F.col("n_symbols") / n), "x3": F.log1p(100 * F.col("n_dup_lines") / n),
        "x4": F.sqrt(F.col("n_repeat_words") / n), "x5": F.sqrt(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)))})


DIMS = list(VECTOR)
PAIRS = [(a, b) for k, a in enumerate(DIMS) for b in DIMS[:k + 1]]


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution function with ``k`` degrees of freedom, by its power series."""
    if x <= 0:
        return 0.0
    term = total = math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    n = 0
    while term > 1e-16 * total:
        n += 1
        term *= x / (k + 2 * n)
        total += term
    return min(total, 1.0)


def consistency(share: float, p: int) -> float:
    """What the covariance of the innermost ``share`` of a Gaussian in ``p`` dimensions is multiplied by to match the whole."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < share else (lo, mid)
    return share / chi2_cdf(lo, p + 2)


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the right side's keys are dropped."""
    renamed = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(renamed, cond, "left").drop(*[f"_{k}" for k in keys])


def cholesky(t: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds the Cholesky factor l_* of the covariances c_* times ``scale``, with the least variances of ``VECTOR`` added, and its ``logdet``."""
    for k, a in enumerate(DIMS):
        for b in DIMS[:k + 1]:
            c = F.col(f"c_{a}_{b}") * scale + (VECTOR[a] ** 2 if a == b else 0.0)
            for d in DIMS[:DIMS.index(b)]:
                c = c - F.col(f"l_{a}_{d}") * F.col(f"l_{b}_{d}")
            t = t.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(c, F.lit(VECTOR[a] ** 2 / 4))) if a == b else c / F.col(f"l_{b}_{b}"))
    return t.withColumn("logdet", 2 * sum((F.log(f"l_{a}_{a}") for a in DIMS[1:]), F.log(f"l_{DIMS[0]}_{DIMS[0]}")))


MODEL = [f"m_{a}" for a in DIMS] + [f"l_{a}_{b}" for a, b in PAIRS]


def starts(rows: DataFrame) -> DataFrame:
    """(start, lang, m_*, l_*), two estimates by language around its medians: scaled quartile distances without correlations, and the covariance of
    spatial signs (directions from the centre, however far), which keeps correlations and is bent by no single far row."""
    q = {x: F.percentile_approx(x, [0.25, 0.5, 0.75], 1000) for x in DIMS}
    t = rows.groupBy("lang").agg(*[v.alias(x) for x, v in q.items()])
    zero = {f"l_{a}_{b}": F.lit(0.0) for a, b in PAIRS if a != b}
    wide = {f"l_{x}_{x}": F.sqrt(F.pow((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, 2) + VECTOR[x] ** 2) for x in DIMS}
    plain = materialise(t.select("lang", *[F.get(x, F.lit(1)).alias(f"m_{x}") for x in DIMS], *[v.alias(k) for k, v in (zero | wide).items()]), "start")
    far = distance(null_safe(rows, plain, ["lang"]))
    signs = {f"c_{a}_{b}": F.avg(F.when(F.col("d2") > 0, F.col(f"y_{a}") * F.col(f"y_{b}") / F.col("d2")).otherwise(0.0)) for a, b in PAIRS}
    signs = null_safe(far.groupBy("lang").agg(*[v.alias(k) for k, v in signs.items()]), plain, ["lang"])
    bent = cholesky(signs.withColumns({f"c_{a}_{b}": len(DIMS) * F.col(f"c_{a}_{b}") * F.col(f"l_{a}_{a}") * F.col(f"l_{b}_{b}") for a, b in PAIRS}))
    return plain.select(F.lit(0).alias("start"), "lang", *MODEL).unionByName(bent.select(F.lit(1).alias("start"), "lang", *MODEL))


def distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance to the joined estimates, by forward substitution in the Cholesky factor."""
    ys = []
    for k, a in enumerate(DIMS):
        r = F.col(a) - F.col(f"m_{a}")
        for j, b in enumerate(DIMS[:k]):
            r = r - F.col(f"l_{a}_{b}") * F.col(f"y_{b}")
        rows = rows.withColumn(f"y_{a}", r / F.col(f"l_{a}_{a}"))
        ys.append(F.col(f"y_{a}") * F.col(f"y_{a}"))
    return rows.withColumn("d2", sum(ys[1:], ys[0]))


def inner_moments(rows: DataFrame, share: float) -> DataFrame:
    """(start, lang, source, n, sums, product sums) over the ``share`` of each group with the least distances, in steps of an eighth of a log unit. The
    last step counts in part, so that every start weighs the same share and determinants compare.

    Rows fold into bins before the shuffle, so a hot group sends some hundred rows per task.
    """
    names = [f"s_{a}" for a in DIMS] + [f"p_{a}_{b}" for a, b in PAIRS]
    sums = [F.sum(a).alias(f"s_{a}") for a in DIMS] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in PAIRS]
    bins = rows.withColumn("bin", F.floor(8 * F.log(F.col("d2") + 1e-6))).groupBy("start", "lang", "source", "bin").agg(F.count("*").alias("n"), *sums)
    group = W.partitionBy("start", "lang", "source")
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("all", F.sum("n").over(group)).withColumn("before", before).where(F.col("before") < share * F.col("all"))
    part = F.least(F.lit(1.0), (share * F.col("all") - F.col("before")) / F.col("n"))
    return inner.groupBy("start", "lang", "source").agg(*[F.sum(F.col(c) * part).alias(c) for c in ["n", *names]])


def estimates(moments: DataFrame, share: float, shrink: float) -> DataFrame:
    """(start, lang, source, logdet, m_*, l_*): centres, Cholesky factors and log determinants. A group's moments are averaged with its language's as if
    those were ``shrink`` more rows, the language's with the whole's likewise."""
    names = [c for c in moments.columns if c not in ("start", "lang", "source")]

    def central(t: DataFrame, tag: str) -> DataFrame:
        means = {f"{tag}m_{a}": F.col(f"s_{a}") / F.col("n") for a in DIMS}
        covs = {f"{tag}c_{a}_{b}": F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"s_{a}") / F.col("n") * F.col(f"s_{b}") / F.col("n") for a, b in PAIRS}
        return t.withColumns(means | covs).withColumnRenamed("n", f"{tag}n").drop(*[c for c in names if c != "n"])

    own = central(moments, "g")
    langs = central(moments.groupBy("start", "lang").agg(*[F.sum(c).alias(c) for c in names]), "a")
    whole = central(moments.groupBy("start").agg(*[F.sum(c).alias(c) for c in names]), "w")
    t = null_safe(null_safe(own, langs, ["start", "lang"]), whole, ["start"])
    mixed = {}
    for v in ["m_" + a for a in DIMS] + [f"c_{a}_{b}" for a, b in PAIRS]:
        lang = (F.col("an") * F.col("a" + v) + shrink * F.col("w" + v)) / (F.col("an") + shrink)
        mixed[v] = (F.col("gn") * F.col("g" + v) + shrink * lang) / (F.col("gn") + shrink)
    t = t.select("start", "lang", "source", *[e.alias(v) for v, e in mixed.items()])
    return cholesky(t, consistency(share, len(DIMS))).select("start", "lang", "source", "logdet", *MODEL)


def least_determinant(good: DataFrame, share: float, shrink: float, max_steps: int, tolerance: float) -> DataFrame:
    """(lang, source, logdet, m_*, l_*): of all steps from both starts, each group's estimate with the least determinant.

    Steps go on while the log determinant of any group falls by ``tolerance`` or more from either start; the driver gets one number a step. If they still
    fall after ``max_steps``, that is logged and the least found so far holds.
    """
    found, keys, steps = materialise(starts(good), "starts"), ["lang"], []
    for k in range(max_steps):
        inner = materialise(inner_moments(distance(null_safe(good, found, keys)), share), f"moments-{k}")
        last, found, keys = found, materialise(estimates(inner, share, shrink), f"estimates-{k}"), ["lang", "source"]
        steps.append(found.withColumn("step", F.lit(k)))
        if k:
            before = last.select("start", *keys, F.col("logdet").alias("before"))
            fell = null_safe(found, before, ["start", *keys]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
            if fell is None or fell < tolerance:
                log.info("determinants stand after %d steps", k + 1)
                break
    else:
        log.warning("determinants still fall after %d steps", max_steps)
    every = steps[0]
    for t in steps[1:]:
        every = every.unionByName(t)
    least = every.groupBy(*keys).agg(F.min(F.struct("logdet", "step", "start", *MODEL)).alias("e"))
    return least.select(*keys, "e.logdet", *[f"e.{c}" for c in MODEL])


def robust_outliers(docs: DataFrame, *, share: float = 0.75, shrink: float = 50.0, cutoff: float = 40.0, max_steps: int = 20, tolerance: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, the counts, base_failed, d2 (squared distance) and kept.

    Estimates come from the documents that pass the base rules, all of them. Each step keeps the ``share`` of a group with the least distances and
    estimates anew from those; :func:`least_determinant` says when steps end and which estimate holds. ``cutoff`` 40 leaves out about one in ten million of a
    Gaussian group. Null and empty texts have no words and fail the base rules, as do all texts under 50 words; null languages and sources are groups of
    their own. Repeated rows count as often as they stand, equal distances share a step. Of equal determinants the earliest step of the first start holds. If no
    document passes the base rules, none is kept. Other columns are ignored; an empty table gives an empty table.
    """
    rows = materialise(vectors(statistics(docs)), "quality-vectors")
    good = rows.where("not base_failed").select("lang", "source", *DIMS)
    found = materialise(least_determinant(good, share, shrink, max_steps, tolerance), "estimates")
    judged = distance(null_safe(rows, found, ["lang", "source"]))
    kept = ~F.col("base_failed") & (F.col("d2") <= cutoff)
    return judged.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "base_failed", "d2",
                         F.coalesce(kept, F.lit(False)).alias("kept"))

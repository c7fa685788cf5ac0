"""Registered queries: each operator with production parameters over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_codec,
    decontaminate,
    language_fusion,
    license_scan,
    merkle_manifest,
    ngram_join,
    quality_net,
    robust_quality,
    secret_scan,
    source_mix,
    token_alignment,
    token_counts,
    weak_toxicity,
)

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        RUN[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def repository() -> Column:
    """``documents`` has no repository column: a source is an owner, its part in one language a repository."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+')"


JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k + 4], ' ') END AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, coalesce(l.k, 0) AS n_links FROM documents d
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY 1) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY 1) l ON l.a = d.doc_id"""

_KEY = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
_HEAD = f"""(?:{_KEY})["'']?\\x20*[:=]\\x20*["'']?"""
_PATTERNS = [(0, _HEAD + "[A-Za-z0-9+/_.=-]+", 6), (1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24), (3, "[A-Za-z0-9+/_=-]+", 16)]
SECRET_SQL = f"""
WITH t AS (SELECT doc_id, source AS owner, concat(coalesce(source, chr(0)), '/', concat(coalesce(source, ''), '/', coalesce(lang, ''))) AS repo, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(f"SELECT doc_id, owner, repo, {r} AS rank, {k} AS least, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM t" for r, p, k in _PATTERNS)}),
one AS (SELECT doc_id, owner, repo, rank, least, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, unnest(generate_series(1, len(m))) AS i FROM raw WHERE len(m) > 0),
placed AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
       CASE WHEN rank = 0 THEN regexp_replace(v, '^{_HEAD}', '') ELSE v END AS value FROM one WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i)),
c AS (SELECT doc_id, owner, repo, rank, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b, value,
      regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS varied FROM placed WHERE length(value) >= least),
d AS (SELECT * FROM c WHERE rank < 3 OR varied),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT repo) AS repos FROM d GROUP BY 1),
e AS (SELECT d.*, varied AND owners <= 2 AND repos <= 4 AS live FROM d JOIN o USING (value)),
k AS (SELECT * FROM e WHERE rank < 3 UNION ALL SELECT * FROM e x WHERE rank = 3 AND live
      AND NOT EXISTS (SELECT 1 FROM e y WHERE y.doc_id = x.doc_id AND y.rank < 3 AND y.a < x.b AND x.a < y.b)),
s AS (SELECT *, concat(['assign', 'access', 'hex', 'live'][rank + 1], ':', a, ':', b) AS s FROM k)
SELECT t.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, rank), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples
FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""

MIX_SQL = """
WITH z AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1),
r AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM z) * (SELECT sum(size) FROM z) / size ELSE 1.0 END AS rate FROM z),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS c
      FROM (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf
            FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM r))),
u AS (SELECT *, (CAST(concat('0x', substring(md5(concat('7:', doc_id)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.c < u.u) AS n_copies FROM u)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5(concat('7:order:', doc_id, ':', copy)) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM n WHERE n_copies > 0)"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD_FIELDS = ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 bit by bit, divisible by three
_THIRD = """(4294967295 - list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda acc, c: list_reduce(range(8), lambda h, i: xor(h >> 1, (h & 1) * 3988292384), xor(acc, c)), 4294967295)) % 3 = 0"""
_UP = "list_transform(range(0, len(nodes), 8), lambda k: sha256(array_to_string(nodes[k + 1:k + 8], '')))"
MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(concat({_HEAD_FIELDS}, {_field("text")})) AS leaf,
                            CASE WHEN {_THIRD} THEN sha256(concat({_HEAD_FIELDS}, {_field(_LOWER)})) END AS found FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv AS (SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
       UNION ALL SELECT lang, level + 1, {_UP} FROM lv WHERE len(nodes) > 1),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM lv WHERE len(nodes) = 1),
tops AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subs UNION ALL SELECT level + 1, {_UP} FROM tops WHERE len(nodes) > 1),
steps AS (SELECT p.pos, p.lang, 0 AS part, level, p.pos // CAST(8 ** level AS BIGINT) AS place, nodes FROM p JOIN lv ON p.lang IS NOT DISTINCT FROM lv.lang WHERE len(nodes) > 1
          UNION ALL SELECT p.pos, p.lang, 1, level, subs.place // CAST(8 ** level AS BIGINT), nodes FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang, tops WHERE len(nodes) > 1),
sides AS (SELECT pos, lang, row_number() OVER (PARTITION BY lang, pos ORDER BY part, level) AS step,
                 array_to_string(nodes[place - place % 8 + 1:place], '') AS l, array_to_string(nodes[place + 2:place - place % 8 + 8], '') AS r FROM steps),
proof AS (SELECT pos, lang, sha256(string_agg(concat(l, r), '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY 1, 2),
fold AS (SELECT pos, lang, CAST(0 AS BIGINT) AS step, coalesce(found, leaf) AS h FROM p
         UNION ALL SELECT f.pos, f.lang, s.step, sha256(concat(s.l, f.h, s.r)) FROM fold f JOIN sides s ON f.pos = s.pos AND f.lang IS NOT DISTINCT FROM s.lang AND s.step = f.step + 1),
ends AS (SELECT pos, lang, arg_max(h, step) AS folded_root FROM fold GROUP BY 1, 2)
SELECT p.doc_id, p.leaf, subs.subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang JOIN (SELECT nodes[1] AS h FROM tops WHERE len(nodes) = 1) root ON true
JOIN ends ON p.pos = ends.pos AND p.lang IS NOT DISTINCT FROM ends.lang LEFT JOIN proof ON p.pos = proof.pos AND p.lang IS NOT DISTINCT FROM proof.lang"""


@query("op1_robust_quality")
def _(spark, sf):
    """The distance is left out: its last digits depend on the order of sums."""
    return robust_quality.robust_outliers(table(spark, sf, "documents")).drop("lang", "source", "n_capitals", "d2")


@query("op2_weak_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    scored = weak_toxicity.score_documents(docs, weak_toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", weak_toxicity.fold(3, 1).alias("held_out"), "score", "predicted")


@query("op3_token_counts")
def _(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"))


@query("op4_ngram_jaccard_join", JACCARD_SQL)
def _(spark, sf):
    return ngram_join.ngram_links(table(spark, sf, "documents"))


@query("op5_secret_scan", SECRET_SQL)
def _(spark, sf):
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf, "documents"), repo=repository(), owner="source"))


@query("op6_mix_sources", MIX_SQL)
def _(spark, sf):
    return source_mix.mix_sources(table(spark, sf, "documents"))


@query("op7_quality_net")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    scored = quality_net.score_documents(docs, quality_net.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", weak_toxicity.fold(5, 0).alias("held_out"), "score", "predicted")


@query("op8_license_scan")
def _(spark, sf):
    return license_scan.summary(license_scan.license_scan(table(spark, sf, "documents")))


@query("op9_decontaminate")
def _(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_language_fusion")
def _(spark, sf):
    """Languages of all pages; the score is rounded, its last digits depend on the order of sums."""
    found = language_fusion.identify(table(spark, sf, "pages"), table(spark, sf, "documents"))
    return found.withColumn("score", F.round("score", 6))


@query("op11_bpe_round_trip")
def _(spark, sf):
    return bpe_codec.round_trip(table(spark, sf, "documents"))


@query("op12_merkle_manifest", MERKLE_SQL)
def _(spark, sf):
    found = merkle_manifest.manifest(table(spark, sf, "documents"), merkle_manifest.every_third(), merkle_manifest.lower_ascii())
    return merkle_manifest.verification(found)


@query("op13_token_alignment")
def _(spark, sf):
    return token_alignment.token_alignment(table(spark, sf, "documents"))

"""Null, empty, very long, repeated and clashing inputs, and empty tables, for every operator and pipeline stage."""

import pytest

pytest.importorskip("tidemark.llm")

import corpus_pipeline  # noqa: E402
from tidemark.llm import (  # noqa: E402
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

LONG = " ".join(f"word{k % 7000}" for k in range(150_000)) + " mit license password=abc123def456ghi789 idiot"
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "One, two; three four FIVE six seven!", "de", "b", 36),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "en", "a", len(LONG)),
    (6, "two words", "fr", None, 9),
    (7, "two words", None, "b", 9),
    (None, "a row without an id has a text too", "en", "a", 34),
    (8, " \t\n\x0b ", "en", "a", 5),
    (9, "\U0001f600 ünïcödé ▁ ſecret=", "en", "a", 20),
]
CLASHES = ["g", "class_id", "n_links", "score", "predicted", "label", "row", "spans", "found", "bucket", "rep", "rate", "copy", "n_copies", "shuffle_key", "x1", "d2", "kept", "token", "held_out",
           "__u", "key", "doc", "text2", "size", "weight", "block", "k1", "item_id", "host", "s", "all"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "two words"), (4, "two words")], "item_id long, text string")


def pages_of(docs):
    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") != 2, F.lit("http://a.example.com/x")).alias("url"), F.col("text").alias("html"), "host", "lang", "score")


def op2(docs, labels):
    return weak_toxicity.score_documents(docs, weak_toxicity.fit(docs, labels))


def op7(docs, labels):
    return quality_net.score_documents(docs, quality_net.fit(docs, labels, rows=1024, dim=8))


OPERATORS = {
    "op1": lambda d, lab, b: robust_quality.robust_outliers(d),
    "op2": lambda d, lab, b: op2(d, lab),
    "op3": lambda d, lab, b: token_counts.token_counts(d, frequent=5),
    "op4": lambda d, lab, b: ngram_join.ngram_links(d),
    "op5": lambda d, lab, b: secret_scan.digest(secret_scan.secret_scan(d)),
    "op6": lambda d, lab, b: source_mix.copies(d.drop("n_copies")),
    "op7": lambda d, lab, b: op7(d, lab),
    "op8": lambda d, lab, b: license_scan.summary(license_scan.license_scan(d)),
    "op10": lambda d, lab, b: language_fusion.identify(pages_of(d), d),
    "op11": lambda d, lab, b: bpe_codec.decode_documents(bpe_codec.encode_documents(d)),
    "op11_digest": lambda d, lab, b: bpe_codec.round_trip(d),
    "op12": lambda d, lab, b: merkle_manifest.verification(merkle_manifest.manifest(d, merkle_manifest.every_third(), merkle_manifest.lower_ascii())),
    "op13": lambda d, lab, b: token_alignment.token_alignment(d, frequent=50),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(name, docs, labels, benchmark):
    out = OPERATORS[name](docs, labels, benchmark).collect()
    assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", [*sorted(OPERATORS), "op9", "mix"])
def test_empty_table(name, docs, labels, benchmark):
    none = docs.where("false")
    if name == "op9":
        assert decontaminate.leaks(none, benchmark).count() == 0
        assert decontaminate.leaks(docs, benchmark.where("false")).count() == 0
    elif name == "mix":
        assert source_mix.mix_sources(none).count() == 0
    else:
        assert OPERATORS[name](none, labels.where("false"), benchmark).count() == 0


def test_no_labels(docs, labels):
    assert {r["score"] for r in op7(docs, labels.where("false")).collect()} == {0.5}
    scores = {r["doc_id"]: r["predicted"] for r in op2(docs, labels.where("false")).collect()}
    assert scores[5] == 1 and scores[3] == 0 and scores[4] == 0


def test_quality_rules(docs):
    rows = {r["doc_id"]: r for r in robust_quality.robust_outliers(docs).collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"]
    assert rows[5]["n_words"] == 150_004 and rows[5]["n_repeat_words"] > 149_000 and rows[5]["base_failed"]


def test_links_of_edge_cases(docs):
    rows = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_links(docs).collect()), key=str)
    want = [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0), (None, None, 0)]
    assert rows == sorted(want, key=str)


def test_leaks_of_edge_cases(docs, benchmark):
    rows = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert rows == {(1, 1, 0), (2, 1, 0), (6, 4, 0), (7, 4, 0)}


def test_secrets_of_edge_cases(docs):
    rows = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.secret_scan(docs)).collect()}
    assert rows[5]["n_assign"] == 1 and rows[5]["n_live"] == 1 and rows[9]["n_assign"] == 0 and rows[3]["spans"] == ""
    out = {r["doc_id"]: r for r in secret_scan.blank_live(docs).collect()}
    assert "password" not in out[5]["text"] and out[5]["n_chars"] == len(out[5]["text"]) and out[3]["text"] is None and out[1]["text"] == ROWS[0][1]


def test_licenses_of_long_text(docs):
    rows = {r["doc_id"]: r for r in license_scan.summary(license_scan.license_scan(docs)).collect()}
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["base_labels"]) == (1, 150_000, "mit")
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None and rows[3]["labels"] == "" and rows[3]["score"] == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(name, docs, labels, benchmark, tmp_path):
    for t, n in ((labels, "labels"), (benchmark, "benchmark")):
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(docs.sparkSession, docs, str(tmp_path))
    if name != "mixing":
        assert out.columns == docs.columns
        assert out.where("doc_id is null").count() == 1 and out.where("doc_id in (3, 4)").count() == 2
    out.collect()
    assert stage(docs.sparkSession, docs.where("false"), str(tmp_path)).count() == 0


def test_tokens_of_edge_cases(docs):
    for rows in (bpe_codec.round_trip(docs).collect(), token_alignment.token_alignment(docs).collect()):
        n = {r["doc_id"]: r[1] for r in rows}
        assert n[3] == n[4] == 0 and n[5] > 150_000 and len([r for r in rows if r["doc_id"] == 1]) == 2
    assert {r["doc_id"]: r["groups_sha256"] for r in rows}[9] == ""  # U+2581 cannot be given back


def test_manifest_of_edge_cases(docs):
    rows = merkle_manifest.verification(merkle_manifest.manifest(docs, merkle_manifest.every_third(), merkle_manifest.lower_ascii())).collect()
    assert len({r["root"] for r in rows}) == 1 and len({r["leaf"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows) and all(r["verified"] for r in rows if r["doc_id"] in (None, 3))

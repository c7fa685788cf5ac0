"""Encoding, alignment and manifests against the libraries, brute force and SQL, with planted odd texts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tidemark.llm import bpe_codec, merkle_manifest, token_alignment  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

LARGER = "/root/testdata/sf0.01"
ODD = ["", " ", "  ", "a", "don't'''s we're I'LL", "<|startoftext|>x<|endoftext|> y", "<|endoftext|", "é É ́ a ́b", "İΑΣ ΟΔΟΣ. ﬁ ẞ", "tab\tline\nend\r\n\x0b\x0c\x1c\x85\xa0 x",
       "\U0001f600\U0001f468‍\U0001f469 中文字符没有空格" * 40, "12345 1.5e10 ½ ²", "a" * 3000, "ab12" * 2000, "  two  blanks \n after ", "▁ mark▁", "<0x41> <s> </s> <unk> [MASK]", "\x00\x01",
       "x" + " y" * 50, "عربى हिन्दी ไทย", "-'s --'t ''' 's", "long " * 30_000, "日本語" * 9_000, "word " * 9000 + "日本語" * 15_000 + " tail and more" * 4000, "a  b" * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(10_000 + k, t, [None, "en", "xx"][k % 3], "s", len(t or "")) for k, t in enumerate([*ODD, None])], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{LARGER}/documents.parquet").select(*own.columns).unionByName(own)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_encoding_is_the_library_s(docs, texts):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe_codec.encode_documents(docs).collect()}
    assert got == want
    back = {r["doc_id"]: r["text"] for r in bpe_codec.decode_documents(bpe_codec.encode_documents(docs)).collect()}
    assert back == {i: lib.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.round_trip(docs).collect()}
    assert rows == {(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back[i].encode())) for i, ids in want.items()}


def test_forced_cuts_stay_exact_inside_words():
    """Words of random bytes fall at certain cuts; parts encoded apart give the ids of the whole word."""
    c, rng = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json")), np.random.default_rng(3)
    cut = 0
    for _ in range(3000):
        word = "".join(rng.choice(list("etaoinqxzjвжшü漢字ı"), int(rng.integers(2, 30))))
        symbols = [s for s, _ in c.whole.pre_tokenizer.pre_tokenize_str(c.whole.normalizer.normalize_str(word))]
        cut += any(s[k - 1:k + 1] not in c.inside for s in symbols for k in range(1, len(s)))
        assert c.encode(word).tolist() == c.by_library(word).tolist()
    assert cut > 1000


def test_encoding_of_every_latin_character():
    """The short way of these words agrees with the library for each character in each neighbourhood."""
    c = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))
    for x in map(chr, range(33, 0x250)):
        for word in (x, f"a{x}", f"{x}a", f"1{x}2", f"'{x}s", f"{x}'s", f"-{x}-", f"Ab{x}{x}cD"):
            assert c.encode(word).tolist() == c.by_library(word).tolist(), word


def test_fast_encoder_is_the_library_s(texts):
    al = token_alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    every = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xa1, 0x250), *range(0x2010, 0x2028)]))
    fast = [t for t in [*texts.values(), *(f"{x}a {x} 1{x}{x} '{x}" for x in every)] if not token_alignment.OTHER.search(t)]
    assert len(fast) > 1000 and all(al.ids_a(" " + t) == al.a.encode(" " + t, add_special_tokens=False).ids for t in fast)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAsStT '\n\t-1é́ Σ<|>endoftext▁中")), max_size=60))
def test_encoding_of_any_text(text):
    c = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))
    assert c.encode(text).tolist() == c.by_library(text).tolist()


def brute_alignment(texts):
    """Rows by encoding whole texts and listing groups plainly."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {}
    plain = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255]
    for k in range(256):
        byte_of[chr(k) if k in plain else chr(256 + k - sum(p < k for p in plain))] = k
    docs, held = {}, Counter()
    for i, t in texts.items():
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs[i] = None
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups_a, groups_b = ([[] for _ in cuts] for _ in range(2))
        for ids, ends, groups in ((ids_a, ends_a, groups_a), (ids_b, ends_b, groups_b)):
            for k, e in zip(ids, np.searchsorted(cuts, ends).tolist()):
                groups[e].append(k)
        links = Counter()
        for x, y in zip(groups_a, groups_b):
            for (p, n), (q, m) in ((u, v) for u in Counter(x).items() for v in Counter(y).items()):
                links[p, q] += n * m
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in zip(groups_a, groups_b))
        docs[i] = (len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest())
        held.update(links.keys())
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    return {(i, 0, 0, 0, 0, 0, 0, "") if d is None else (i, d[0], d[1], d[2], sum(d[3].values()), sum(k for (p, q), k in d[3].items() if held[p, q] == most[p]),
                                                       sum(k * held[x] for x, k in d[3].items()), d[4]) for i, d in docs.items()}


@pytest.fixture(scope="module")
def aligned(texts):
    return brute_alignment(texts)


@pytest.mark.parametrize("size,frequent", [(32_768, 400_000), (500, 300), (2_000, 0)])
def test_alignment_against_brute_force(docs, aligned, size, frequent):
    """Also with tiny byte ranges, many rounds and nearly all pairs in the shuffled join."""
    got = {tuple(r) for r in token_alignment.token_alignment(docs, size=size, frequent=frequent).collect()}
    assert got == aligned


def state(f):
    return (f.a_prefix, f.b_prefix, f.cut, ";".join(f.groups), f.n_groups, f.n_a, f.n_b, f.pairs.tolist(), f.links.tolist(), f.a_suffix, f.b_suffix, f.ok)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.lists(st.integers(1, 3), min_size=1, max_size=40), st.lists(st.integers(1, 80), max_size=6), st.randoms())
def test_fragments_are_a_monoid(a, b, borders, rnd):
    """Any byte ranges, bracketed anyhow, compose to the fragment of the whole; the empty fragment changes nothing."""
    ids, ends = ([rnd.randrange(5) for _ in x] for x in (a, b)), [np.cumsum(x).tolist() for x in (a, b)]
    (ia, ib), (ea, eb) = ids, ends
    of = lambda *x: token_alignment.Fragment.of(*[np.array(v, np.int64) for v in x])
    edges = [0, *sorted(set(borders)), 1 << 30]
    parts = [of(*[y for i, e in ((ia, ea), (ib, eb)) for y in ([k for k, x in zip(i, e) if lo < x <= hi], [x for x in e if lo < x <= hi])]) for lo, hi in zip(edges, edges[1:])]
    whole = state(of(ia, ea, ib, eb))
    while len(parts) > 1:
        k = rnd.randrange(len(parts) - 1)
        parts[k:k + 2] = [parts[k].compose(parts[k + 1])]
    assert state(parts[0]) == whole
    for f in (token_alignment.Fragment().compose(parts[0]), parts[0].compose(token_alignment.Fragment())):
        assert state(f) == whole


def test_long_documents_are_cut(texts):
    long = [t for t in texts.values() if len(t) > 5000]
    parts = [token_alignment.byte_ranges(" " + t, 1000) for t in long]
    assert len(long) > 20 and sum(map(len, parts)) > sum(map(len, long)) / 4000
    assert all(sum(high - low for _, low, high in p) == len((" " + t).encode()) for p, t in zip(parts, long))
    assert len(token_alignment.byte_ranges(" " + "日本語" * 9_000, 1000)) == 1


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain lists."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(enc, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        trees[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    lv = {n: levels([leaf(r, r["text"]) for r in trees[n]]) for n in names}
    top = levels([lv[n][-1][0] for n in names])
    out = []
    for at, n in enumerate(names):
        for pos, r in enumerate(trees[n]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h = leaf(r, r["text"].translate(lower) if tampered and r["text"] is not None else r["text"])
            proof = ""
            for k, tree in ((pos, lv[n]), (at, top)):
                for level in tree[:-1]:
                    run, i = level[k - k % 8:k - k % 8 + 8], k % 8
                    proof += "".join(run[:i] + run[i + 1:])
                    h, k = sha("".join([*run[:i], h, *run[i + 1:]])), k // 8
            out.append((r["doc_id"], leaf(r, r["text"]), lv[n][-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return out


def query(docs):
    return merkle_manifest.verification(merkle_manifest.manifest(docs, merkle_manifest.every_third(), merkle_manifest.lower_ascii()))


@pytest.mark.parametrize("cases", ["all", "lone", "langs", "ties"])
def test_manifest_against_brute_force(spark, docs, cases):
    """Large trees of several rounds, a single row, more languages than one run holds, rows that share an id or are equal."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = {"all": docs, "lone": docs.where("doc_id = 5"),
             "langs": spark.createDataFrame([(k, f"Text {k}", f"l{k % 700}" if k % 7 else None, None, None) for k in range(2000)], schema),
             "ties": spark.createDataFrame([(None if k % 5 == 0 else 7, f"T{k % 3}", "en", "s", 2) for k in range(40)], schema)}[cases]
    assert sorted(map(tuple, query(table).collect()), key=str) == sorted(brute_manifest(table.collect()), key=str)


def test_versions_share_all_but_their_ancestors(docs):
    found = merkle_manifest.manifest(docs, F.col("doc_id") == 3, F.upper("text"))
    own = {r["level"]: r["hash"] for r in merkle_manifest.versions(found).collect()}
    row = found.where("doc_id = 3").first()
    path = merkle_manifest.unpacked(row["path"])
    assert len(own) == len(path) + 1 and own[len(path)] != row["root"] and own[0] != row["leaf"]
    assert merkle_manifest.copied(path, row["leaf"])[-1] == row["root"] and merkle_manifest.copied(path, own[0])[-1] == own[len(path)]
    assert found.where("not changed").where(F.element_at("copies", -1) != F.col("root")).count() == 0

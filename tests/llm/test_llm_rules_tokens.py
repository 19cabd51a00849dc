"""Compression rules, byte BPE, license scan: against brute force, on edge rows and empty tables."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard

from posterwall.llm import byte_bpe, compression_rules, license_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def expected_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(*(words[i:] for i in range(5))))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_rules_equal_brute_force(edges):
    rows = compression_rules.measure(edges).collect()
    texts = edges.select("doc_id", "text").collect()
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows)
    assert got == sorted(repr((t.doc_id, *expected_base(t.text))) for t in texts)
    assert not any(r.kept and r.base_failed for r in rows)


def test_bands_by_length():
    bands = compression_rules.Bands()
    sizes = np.array([0, 10, 100, 300, 5000, 50_000, 5000, 50_000])
    packed = np.array([0, 30, 20, 60, 2000, 19_000, 4500, 5000])
    assert bands.outside(sizes, packed).tolist() == [False, False, True, True, False, False, True, True]


def test_encoded_bytes_are_outside_and_clean_ratios_inside():
    rng, bands = np.random.default_rng(3), compression_rules.Bands()
    coded = lambda n, f: b" ".join(f(rng.bytes(9)) for _ in range(n // 8))[:n]
    texts = [coded(n, base64.b64encode) for n in (300, 600, 1200, 2000)] + [coded(n, lambda b: b[:6].hex().encode()) for n in (4096, 9000)]
    assert not compression_rules.compression(texts, bands)["in_band"].any()
    sizes = np.array([150, 300, 600, 1200, 2500, 6000, 20_000])
    most = np.array([0.923, 0.744, 0.682, 0.58, 0.521, 0.482, 0.428])  # of texts labelled 1 at sf0.1
    assert not bands.outside(sizes, np.floor(most * sizes)).any()


def test_chunks_find_a_repetitive_part():
    rng = np.random.default_rng(0)
    prose = bytes(rng.choice(np.frombuffer(b"etaoinshrdlu     ", np.uint8), 8192))
    found = compression_rules.compression([prose, prose + b"spam " * 1700, None, b""], compression_rules.Bands())
    assert found["in_band"].tolist() == [True, False, True, True]
    assert found["zstd_ratio"][0] == len(zstandard.ZstdCompressor(level=3).compress(prose)) / len(prose)


def test_keep_documents_keeps_columns(edges, nothing):
    kept = compression_rules.keep_documents(edges)
    assert kept.schema == edges.schema
    verdicts = {(r.doc_id, r.n_words) for r in compression_rules.measure(edges).where("kept").collect()}
    assert {(r.doc_id, len(WORD.findall(r.text))) for r in kept.collect()} == verdicts
    assert compression_rules.keep_documents(nothing).count() == compression_rules.measure(nothing).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_character_encodes_as_with_the_ranks(ranks, reference):
    codec = byte_bpe.Codec(byte_bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    for code in [*range(0, 0x3100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)]:
        text = f"a {chr(code)} b{chr(code)}1 {chr(code)}{chr(code)}!"
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), hex(code)
        assert codec.decode(ids) == text.encode()


def test_bpe_on_edge_rows(edges, nothing, reference):
    for row in byte_bpe.encode(edges, VOCABULARY, public_tokenizers.PATTERN).join(edges.select("doc_id", "text"), "doc_id").collect():
        assert row.ids == reference.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_stays_bounded(ranks, monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    codec = byte_bpe.Codec(byte_bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    for text in ("one two three", "two three four five six seven", "one one two"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_digest_of_ids_in_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([5, 17, 0],), ([],)], "ids array<int>")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    assert [r[0] for r in df.select(digest).collect()] == [hashlib.sha256(x).hexdigest() for x in (b"5 17 0", b"")]


def test_vocabulary_must_be_whole():
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({base64.b64decode("YQ=="): 0})


def containment(text, template):
    words = [w for w in re.sub("[^A-Za-z0-9]+", " ", text or "").lower().split(" ") if w]
    tokens = [w for w in re.sub("[^A-Za-z0-9]+", " ", template).lower().split(" ") if w]
    wanted, span = set(zip(tokens, tokens[1:])), len(tokens) - 1
    found = {}
    for pos, pair in enumerate(zip(words, words[1:])):
        if pair in wanted:
            for region in (pos // span, pos // span - 1):
                found.setdefault(region, set()).add(pair)
    return max(map(len, found.values()), default=0) / len(wanted)


def test_license_scan_equals_brute_force(spark, nothing):
    filler = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{filler[: 7 * i]} {text}. {filler}") for i, (_, text) in enumerate(license_scan.TEMPLATES * 2)]
    rows += [(90, None), (91, ""), (92, "license"), (None, "Released under the MIT License"), (93, filler * 50), (93, "MIT License MIT")]
    rows += [(94, license_scan.TEMPLATES[4][1].replace("charge", "fee") * 3), (95, "Licensed under the Apache")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, template string, h string")
    got = {(r.doc_id, r.template): r.containment for r in license_scan.scan(docs).collect()}
    want = {}
    for i, text in rows:
        for k, (_, template) in enumerate(license_scan.TEMPLATES):
            if (c := containment(text, template)) >= license_scan.LEAST_CONTAINMENT:
                want[i, k] = max(c, want.get((i, k), 0))
    assert got == pytest.approx(want)
    assert license_scan.scan(nothing).count() == 0

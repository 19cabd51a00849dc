"""Cases that once gave wrong results: structured words, repeated page ids, clashing names, equal weights."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posterwall.llm import compression_rules, context_tree, minhash_groups, source_mix, warc_bundles
from posterwall.llm.textscan import Scan


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal for any odd base from n = 11 on."""
    bits = "a"
    for _ in range(n):
        bits += bits.translate(str.maketrans("ab", "ba"))
    return bits, bits.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [10, 11, 12, 13])
def test_structured_words_and_lines_have_hashes_of_their_own(n):
    x, y = thue_morse(n)
    words = Scan([x.encode(), y.encode(), x.encode()]).word_hash()
    assert words[0] == words[2] != words[1]
    scan = Scan([f"{x}\n{y}\nz {x}".encode()])
    _, start, end = scan.lines()
    assert len(set(scan.span_hash(start, end).tolist())) == 3
    assert scan.word_hash()[0] == scan.word_hash()[3]


def test_span_hash_depends_on_bytes_and_length_only():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abé"), n)) for n in (*rng.integers(1, 9, 300), 127, 128, 129, 500)]
    text = "  " + " \n".join(words) + "\t"
    apart = {w: Scan([w.encode()]).word_hash()[0] for w in words}
    assert Scan([None, b"", text.encode()]).word_hash().tolist() == [apart[w] for w in words]
    assert len(set(apart.values())) == len(set(words))
    assert len(Scan([]).word_hash()) == len(Scan([b" "]).word_hash()) == 0


def test_structured_texts_are_no_duplicates(spark):
    x, y = thue_morse(12)
    docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, x), (3, y), (4, x)], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in compression_rules.measure(docs).collect()}[1] == 0
    assert {r.doc_id: r.component_id for r in minhash_groups.components(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_a_page_id_with_two_payloads(spark):
    rows = [(1, "u", "A"), (2, "u", "B"), (5, "u", "A"), (5, "u", "B"), (5, "u", "C"), (None, "u", "A"), (7, "u", None), (8, "u", ""), (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    _, records = warc_bundles.archive(pages)
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=repr)
    sha = {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in ("A", "B", "C", "")}
    want = [
        (1, sha["A"], "response", None), (2, sha["B"], "response", None), (5, sha["A"], "revisit", 1), (5, sha["B"], "revisit", 2),
        (5, sha["C"], "response", None), (None, sha["A"], "response", None), (7, sha[""], "response", None),
        (8, sha[""], "revisit", 7), (8, sha[""], "revisit", 7),
    ]
    assert got == sorted(want, key=repr)


def test_mixed_documents_with_clashing_names(spark):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit("x").alias("_copies"),
        F.lit("y").alias("_id"), F.lit("z").alias("_from"), F.lit(1).alias("_time"), F.lit(2).alias("MIX_ID"), F.lit(3).alias("mix_source"),
    )
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r["_copies"], r["_id"], r["_from"], r["_time"], r["MIX_ID"], r["mix_source"]) for r in mixed.collect()} == {("x", "y", "z", 1, 2, 3)}


@pytest.mark.parametrize("weights", [[200_000] * 1000, [5] * 30 + [9] * 8, list(range(1, 200)), [1], []])
def test_the_head_is_bounded(spark, weights):
    rows = spark.createDataFrame([(i, float(i), w) for i, w in enumerate(weights)], "key long, value double, weight long")
    for most in (0, 1, 10, 100, 5000):
        keys, values, least = context_tree._head(rows, "value", "weight", most)
        assert len(keys) <= most and keys.tolist() == sorted(i for i, w in enumerate(weights) if w >= least) == values.tolist()
        if most >= len(weights):
            assert len(keys) == len(weights)


def test_scores_do_not_depend_on_the_head(spark):
    docs = spark.createDataFrame([(i, f"some words number {i} and words") for i in range(30)] + [(30, None)], "doc_id long, text string")
    scores = [
        {r.doc_id: (round(r.score, 6), round(r.base_score, 6), r.n_known) for r in context_tree.score(docs, F.lit(False), **bounds).collect()}
        for bounds in ({}, {"head_words": 0, "head_runs": 0}, {"head_words": 3, "head_runs": 20})
    ]
    assert scores[0] == scores[1] == scores[2]

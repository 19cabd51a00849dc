"""Near-duplicate groups and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from posterwall.llm import compression_rules, minhash_groups, rule_ensemble
from posterwall.llm.registry import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(width))))


def expected(rows, width, percent):
    """(size, component, kept) by comparing all pairs; rows are (doc_id, text)."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(live):
        for j, b in live[:k]:
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def changed(rng, words, share):
    return [rng.choice("pqrstuvw") * 3 if rng.random() < share else w for w in words]


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(("ta", "lo", "mi", "ser", "un", "é")) for _ in range(rng.randint(2, 5))) for _ in range(4000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, other = fresh(40), fresh(120), fresh(300)
    texts = [fresh(rng.randint(3, 60)) + passage for _ in range(120)]  # a passage in many documents
    texts += [changed(rng, base, rng.choice((0, 0.01, 0.02, 0.04))) for _ in range(150)]  # a large group
    texts += [other[: 300 - 4 * k] for k in range(30)]  # a chain of cut copies
    texts += [base] * 20 + [["one"], ["one"], ["two", "words"], []]
    for _ in range(40):  # small groups
        start = fresh(rng.randint(5, 200))
        texts += [start] + [changed(rng, start, 0.02) for _ in range(rng.randint(1, 4))]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, " ".join(base)), (None, None), (5, rows[5][1])]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, digest string").repartition(4)
    got = sorted(map(tuple, minhash_groups.components(docs, width, percent).collect()), key=repr)
    assert got == expected(rows, width, percent)
    kept = minhash_groups.keep_representatives(docs, width, percent)
    assert kept.schema == docs.schema
    want = Counter({r[0]: 1 for r in got if r[3] and r[0] is not None})
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_estimate_drops_next_to_no_pair_at_the_limit(t):
    k = minhash_groups.SKETCH
    least = t - minhash_groups.MARGIN * (t * (1 - t) / k) ** 0.5
    assert sum(math.comb(k, i) * t**i * (1 - t) ** (k - i) for i in range(k) if i < least * k) < 2e-9


def repeated_ids():
    """Ids with several texts: each links the groups of its texts; one of them is empty."""
    a, b, c = (" ".join(w * 3 for w in words.split()) for words in ("p q r s t u v", "k l m n o a b", "c d e f g h i"))
    return [(5, a), (7, a), (9, a), (3, b), (5, b), (8, c), (7, c), (2, a + " z"), (11, "x y z w"), (4, b), (4, "")]


def test_ids_with_several_texts_are_one_document(spark):
    rows = repeated_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, minhash_groups.components(docs, 5, 80).collect()), key=repr)
    assert got == expected(rows, 5, 80)
    assert sorted(r.doc_id for r in minhash_groups.keep_representatives(docs, 5, 80).collect()) == sorted({r[0] for r in got if r[3]})


def composites(seed, passages, n):
    """Documents of two frequent passages each; near copies share the pair, which no other document has."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    parts = [[word() for _ in range(60)] for _ in range(passages)]
    pairs = rng.sample([(i, j) for i in range(passages) for j in range(i)], n)
    texts = []
    for i, j in pairs:
        for _ in range(2):
            texts.append([*parts[i], word(), *parts[j], *(word() for _ in range(rng.choice((1, 4, 6))))])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_copies_of_frequent_passages_in_rare_pairs(spark):
    rows = composites(11, 24, 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, minhash_groups.components(docs, 5, 80).collect()), key=repr)
    assert got == expected(rows, 5, 80) and sum(not r[3] for r in got) > 200


def templates(seed, n, width):
    """Pairs of near copies: one long passage is in all documents, two short frequent ones tell the pairs apart, the rest is new."""
    rng = random.Random(seed)
    words = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(k)]
    long, short = words(342), [words(8 + width) for _ in range(32)]
    texts = []
    for i, j in rng.sample([(i, j) for i in range(32) for j in range(i)], n):
        texts += [[*long, *short[i], *short[j], *words(24)] for _ in range(2)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_copies_that_only_a_small_part_tells_from_all_others(spark):
    rows = templates(5, 200, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, minhash_groups.components(docs, 3, 85).collect()), key=repr)
    assert got == expected(rows, 3, 85) and sum(not r[3] for r in got) >= 200


def one_passage(n, share, copies):
    """n documents that are alike in one passage, that share of their words, and as many near copies of one text as given."""
    rng = random.Random(n)
    words = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(k)]
    passage, base = words(share), words(100)
    texts = [[*passage, *words(100 - share)] for _ in range(n)] + [changed(rng, base, rng.choice((0.01, 0.02, 0.03))) for _ in range(copies)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("share", [60, 92])
def test_a_frequent_passage_forms_few_pairs_a_document(spark, monkeypatch, share):
    rows = one_passage(300, share, 100)
    counts = []

    def counted(name, step):
        def run(self, pairs):
            pairs = pairs.select("a", "b").distinct().cache()
            counts.append((name, pairs.count()))
            return step(self, pairs)
        return run

    for name in ("estimated", "verified"):
        monkeypatch.setattr(minhash_groups._Search, name, counted(name, getattr(minhash_groups._Search, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, minhash_groups.components(docs, 3, 85).collect()), key=repr)
    assert got == expected(rows, 3, 85)
    for step in ("estimated", "verified"):
        assert sum(n for name, n in counts if name == step) <= 5 * len(rows), counts


def test_groups_of_edge_rows_and_none(edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    got = sorted(map(tuple, minhash_groups.components(edges, 3, 85).collect()), key=repr)
    assert got == expected(rows, 3, 85)
    assert minhash_groups.components(nothing).count() == minhash_groups.keep_representatives(nothing).count() == 0


def test_connected_follows_long_chains(spark):
    links = [(i, i + 1) for i in range(200, 400)] + [(900, 7), (8, 900)]
    found = {r.id: r.component for r in minhash_groups.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 200 for i in range(200, 401)} | {7: 7, 8: 7, 900: 7}


def test_union_sketch_is_the_sketch_of_the_union():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 500, 200)) for _ in range(2))
    union = np.union1d(a[:64], b[:64])[:64]
    assert union.tolist() == np.union1d(a, b)[:64].tolist()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """documents and labels with good prose, junk, copies and sources."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        text = " ".join(words) + "."
        if i % 6 == 1:
            text = " ".join(f"{w}$$$" for w in words)
        if i % 6 == 2 and i > 10:
            text = rows[i - 6][1] if i % 12 == 2 else rows[i - 6][1] + " more words"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(i % 6 != 1), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "spam spam " * 300, "en", "s1", 3000)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_pipeline_stages_against_brute_force(spark, small):
    path, rows = small
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near-duplicates", "source mix", "byte BPE"]
    texts, docs = {r[0]: r[1] for r in rows}, table(spark, path, "documents")
    rules, classifier, dedup, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    passed = {r.doc_id for r in compression_rules.measure(docs).where("kept").collect()}
    docs = corpus_pipeline.written(rules(spark, docs, path), "t1")
    assert {r.doc_id for r in docs.collect()} == passed and 902 not in passed and 900 not in passed
    judged = rule_ensemble.score(docs, table(spark, path, "labels")).where("predicted = 1")
    good = {r.doc_id for r in judged.collect()}
    docs = corpus_pipeline.written(classifier(spark, docs, path), "t2")
    assert {r.doc_id for r in docs.collect()} == good and not any(i % 6 == 1 for i in good) and len(good) > 150
    docs = corpus_pipeline.written(dedup(spark, docs, path), "t3")
    left = {r[0] for r in expected([(i, texts[i]) for i in good], 5, 80) if r[3]}
    assert {r.doc_id for r in docs.collect()} == left and len(left) < len(good)
    columns = docs.columns
    docs = corpus_pipeline.written(mix(spark, docs, path), "t4")
    assert docs.columns == columns
    times = Counter(r.doc_id for r in docs.collect())
    assert max(times.values()) <= 3 and set(times) <= left
    total, size = sum(len(WORD.findall(texts[i])) for i in left), sum(len(WORD.findall(texts[i])) * n for i, n in times.items())
    assert abs(size - total) < 0.2 * total
    assert encode(spark, docs, path).count() == sum(times.values())
    assert corpus_pipeline.run(spark, path).count() == sum(times.values())

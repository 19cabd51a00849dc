"""Context trees, recurrent network, rule ensemble: against direct computation, gradients, held-out rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from posterwall.llm import byte_gru, context_tree, rule_ensemble

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def is_held_out(doc_id, fold, of):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == fold


def log_kt(n0, n1):
    """By adding one symbol after the other."""
    p, a, b = 0.0, 0, 0
    for bit in [0] * n0 + [1] * n1:
        p += math.log(((b if bit else a) + 0.5) / (a + b + 1))
        a, b = a + (bit == 0), b + (bit == 1)
    return p


class Tree:
    """Context-tree weighting by recursion over contexts, as defined."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, node, bit in self.decisions(text):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], node][bit] += 1
                    if d:
                        self.children[context[depth - d + 1 :], node].add(context[depth - d :])
        self.memo = {}

    def decisions(self, text):
        data = bytes([255]) * self.depth + lower(text).encode() + bytes([255])
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield data[i - self.depth : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1

    def weighted(self, context, node):
        key = context, node
        if key not in self.memo:
            own = log_kt(*self.counts[key]) if key in self.counts else 0.0
            if len(context) < self.depth:
                below = sum(self.weighted(c, node) for c in self.children.get(key, ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[key] = own
        return self.memo[key]

    def probability(self, context, node, bit):
        p, rest = 0.0, 1.0
        for d in range(self.depth + 1):
            c = context[self.depth - d :]
            n = self.counts[c, node] if (c, node) in self.counts else [0, 0]
            kt = (n[bit] + 0.5) / (sum(n) + 1)
            if d == self.depth:
                return p + rest * kt
            own = log_kt(*n)
            below = sum(self.weighted(x, node) for x in self.children.get((c, node), ()))
            share = 1 / (1 + math.exp(below - own))
            p, rest = p + rest * share * kt, rest * (1 - share)

    def score(self, text):
        return sum(math.log10(self.probability(*x)) for x in self.decisions(text))


@pytest.mark.parametrize("heads", [(1 << 10, 1 << 12), (2, 3), (0, 0)])
def test_context_tree_equals_direct_computation(spark, heads):
    texts = ["Abra abra", "abracadabra cab", "", None, "bad cab Ÿ", "rare zz", "abra abra"]
    rows = [(i if i < 6 else 0, t, "x", "y") for i, t in enumerate(texts)] + [(None, "cab cab", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row string")
    learned = [t for i, t, *_ in rows if not is_held_out(i, 2, 7)]
    assert len(learned) < len(rows)
    tree = Tree(learned, 2)
    counts = Counter(w for t in learned for w in [*WORD.findall(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = context_tree.held_out("doc_id", 2, 7)
    got = sorted(context_tree.score(docs, out, 2, *heads).collect(), key=repr)
    want = []
    for i, t, *_ in rows:
        words = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        size = len((t or "").encode()) + 1
        score = tree.score(t)
        want.append((i, is_held_out(i, 2, 7), len(words), sum(counts[w] > 0 for w in words), n, base, score, -score * math.log2(10) / size))
    key = lambda r: (repr(r[0]), r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)


def test_context_tree_without_rows_or_training(spark, nothing):
    assert context_tree.score_documents(nothing).count() == 0
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    row = context_tree.score(docs, F.lit(True), 2).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)
    assert row.score == pytest.approx(-3 * 8 * math.log10(2))


def test_run_keys_hold_the_bytes_before():
    doc, key = context_tree.runs([b"AB", None], 2)
    assert doc.tolist() == [0, 0, 0, 1]
    assert [k.to_bytes(3, "big") for k in map(int, key)] == [b"\xff\xffa", b"\xffab", b"ab\xff", b"\xff\xff\xff"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in byte_gru.initial(3).items()}
    data, labels, mask = rng.integers(0, 9, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 0]), rng.random((5, 4)) < 0.8
    _, g = byte_gru.gradients(w, data, labels, mask)
    for k in w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) if k[0] != "E" or j else data[rng.integers(0, 5), 0] for j, s in enumerate(w[k].shape))
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][at] += 1e-2
            down[k][at] -= 1e-2
            slope = (byte_gru.gradients(up, data, labels, mask)[0] - byte_gru.gradients(down, data, labels, mask)[0]) / 2e-2
            assert g[k][at] == pytest.approx(slope, rel=0.05, abs=2e-4)


def test_every_letter_has_a_place():
    text = "aé漢1 🙂ß-x"
    want = [c.isalpha() for c in text for _ in c.encode()]
    assert byte_gru._letters(text).tolist() == want
    assert byte_gru._letters(text * 40).tolist() == want * 40
    assert byte_gru._letters("Ab1 [").tolist() == [True, True, False, False, False]
    data, mask, owner = byte_gru.windows([b"x" * 65, b"", b"yy"], [np.ones(65, bool), np.ones(0, bool), np.ones(2, bool)])
    assert (mask.sum(), owner.tolist(), data.shape) == (67, [0, 0, 2], (byte_gru.WINDOW, 3))


def test_languages_of_held_out_rows(spark, edges, monkeypatch):
    monkeypatch.setattr(byte_gru, "ROUNDS", 150)
    rng = np.random.default_rng(0)
    parts = {"xx": ["ba", "do", "ki"], "yy": ["sch", "ung", "rst"], "zz": ["é", "ou", "aux"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang) for i in range(300) for lang in [("xx", "yy", "zz")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = byte_gru.identify_documents(docs).collect()
    held = [r for r in got if r.held_out]
    assert sorted(r.doc_id for r in held) == [i for i in range(300) if is_held_out(i, 0, 5)]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    by_id = byte_gru.identify_documents(edges).collect()
    assert len(by_id) == edges.count()
    blank = {r.lang_pred for r in by_id if r.doc_id in (0, 1, 2)}
    assert blank == {"und"}
    equal = {(r.lang_pred, r.score) for r in by_id if r.doc_id in (6, 7)}
    assert len(equal) == 1


def test_language_without_anything_to_learn(nothing, spark):
    assert byte_gru.identify_documents(nothing).count() == 0
    docs = spark.createDataFrame([(1, "abc", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in byte_gru.identify_documents(docs).collect()} == {"und"}
    one = byte_gru.Model(("en",), {})
    assert byte_gru.predict(["abc", "1", None], one)[0] == ["en", "und", "und"]


def labelled(spark, n=600):
    rng = np.random.default_rng(0)
    words = ["river", "stone", "light", "walks", "under", "quiet", "seven", "and", "the", "of"]
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rng.choice(words, 40)) if good else " ".join(["BUY!! $$$"] * 20 + list(rng.choice(words, 5)))
        rows.append((i, text, "x"))
        marks.append((i, int(good), 0))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, statistics string"),
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int"),
    )


def test_rules_separate_held_out_rows_and_compile_alike(spark):
    docs, labels = labelled(spark)
    rows = rule_ensemble.score(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    kept = rule_ensemble.keep_documents(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    x = np.array([list(r.statistics) for r in rows])
    y = np.array([r.doc_id % 3 > 0 for r in rows], float)
    model = rule_ensemble.fit(x, y)
    assert 0 < len(model.rules) < 60 and model.describe()
    struct = "struct<" + ",".join(f"{s}:double" for s in rule_ensemble.STATISTICS) + ">"
    df = spark.createDataFrame([(list(map(float, r)),) for r in x[:50]], f"s {struct}")
    got = [r[0] for r in df.select(model.column(lambda s: F.col(f"s.{s}"))).collect()]
    assert got == pytest.approx(model.probability(x[:50]).tolist())


def test_statistics_of_a_text():
    x = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.statistics([b"One one | two!\nOne one | two!", None])[0]))
    assert (x["n_words"], x["dup_lines"], x["words_a_line"]) == (8, 0.5, 4)
    assert x["distinct_words"] == 0.5 and x["repeated_windows"] == pytest.approx(1 / 8)
    assert not rule_ensemble.statistics([None, b""]).any()


def test_labels_may_be_missing_null_or_one_sided(spark, edges, nothing):
    _, labels = labelled(spark, 3)
    none = labels.where("false")
    assert {r.score for r in rule_ensemble.score(edges, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert rule_ensemble.score(edges, odd).count() == rule_ensemble.keep_documents(edges, odd).count() == edges.count()
    assert rule_ensemble.score(nothing, labels).count() == rule_ensemble.keep_documents(nothing, labels).count() == 0


def test_lasso_drops_what_does_not_help():
    rng = np.random.default_rng(0)
    met = rng.random((2000, 20)) < 0.5
    y = (rng.random(2000) < np.where(met[:, 3], 0.9, 0.1)).astype(float)
    _, weights = rule_ensemble.lasso_logistic(met, y, 0.02)
    assert weights[3] > 1 and (np.abs(np.delete(weights, 3)) < 0.05).all()

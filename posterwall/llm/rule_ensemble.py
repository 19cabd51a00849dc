"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on the statistics of labelled documents. Every path from a root to a node is
a rule, a conjunction of thresholds. A logistic model with a lasso penalty weighs the rules and sets
most weights to zero. What remains is compiled into one Spark column over the statistics, so
scoring is plain column arithmetic.

Null and empty texts have statistics of zero and get a score like any other. Labels of null quality
or id are ignored, of several labels for a document the highest counts. With no usable label the
score is 0.5, with one class alone it is that class's smoothed share. Scores depend on the text
only; other columns of the input are ignored by `score` and kept by `keep_documents`.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.folds import held_out
from posterwall.llm.store import free_name, written
from posterwall.llm.textscan import Scan, repeats, text_slices

# Bounds of the sample that the model is fitted on, and of the model.
MAX_ROWS = 20_000
TREES = 40
TREE_DEPTH = 3
THRESHOLDS = 32
LASSO = 2e-4
THRESHOLD = 0.3

STATISTICS = (
    "n_words",
    "mean_word",
    "long_words",
    "symbols",
    "pipes",
    "marks",
    "uppercase",
    "digits",
    "non_letters",
    "dup_lines",
    "distinct_words",
    "same_word_pairs",
    "repeated_windows",
    "words_a_line",
    "zstd_ratio",
)


def _members(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


_SYMBOL, _PIPE, _MARK = _members(b"#*$%&<>~^{}\\"), _members(b"|"), _members(b"!?")
_UPPER, _DIGIT = _members(bytes(range(65, 91))), _members(bytes(range(48, 58)))
_LETTER = _members(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """The statistics of each text, one row each, in the order of STATISTICS."""
    scan = Scan(texts)
    n = scan.n
    words = scan.n_words()
    of_words, lengths = np.maximum(words, 1), scan.end - scan.start
    hashes = scan.word_hash()
    in_words = np.maximum(np.bincount(scan.doc, lengths, minlength=n), 1)
    share = lambda flags: scan.per_text(flags[scan.data] & scan.in_word) / in_words
    line_doc, start, end = scan.lines()
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    _, dup_line = repeats(scan.keyed(line_doc, scan.span_hash(start, end)))
    _, dup_word = repeats(scan.keyed(scan.doc, hashes))
    doc, window = scan.windows(4, hashes)
    inside = doc >= 0
    _, dup_window = repeats(scan.keyed(doc[inside], window[inside]))
    same = (hashes[1:] == hashes[:-1]) & (scan.doc[1:] == scan.doc[:-1])
    packer = zstandard.ZstdCompressor(level=3)
    packed = np.array([len(packer.compress(t)) / len(t) if t else 0.0 for t in texts])
    columns = (
        words,
        in_words / of_words * (words > 0),
        np.bincount(scan.doc[lengths > 15], minlength=n) / of_words,
        share(_SYMBOL),
        share(_PIPE),
        share(_MARK),
        share(_UPPER),
        share(_DIGIT),
        share(~_LETTER),
        np.bincount(line_doc[dup_line], minlength=n) / lines,
        (words > 0) - np.bincount(scan.doc[dup_word], minlength=n) / of_words,
        np.bincount(scan.doc[1:][same], minlength=n) / of_words,
        np.bincount(doc[inside][dup_window], minlength=n) / of_words,
        words / lines,
        packed,
    )
    return np.stack([np.asarray(c, float) for c in columns], 1)


# A rule is a conjunction of (statistic, above, threshold).
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self, statistic) -> Column:
        """The score as a Spark column; statistic(name) gives the column of a statistic."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for k, above, threshold in rule:
                value = statistic(STATISTICS[k])
                met = met & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(met, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        text = lambda c: f"{STATISTICS[c[0]]} {'>' if c[1] else '<='} {c[2]:.6g}"
        return [f"{weight:+.3f} if {' and '.join(map(text, rule))}" for rule, weight in self.rules]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for k, above, threshold in rule:
        met &= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
    return met


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient, hessian, rows, depth: int, path: Rule, rules: list, step) -> None:
    """Split rows by the cut that fits the gradients best; each child's path becomes a rule."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best, best_gain = None, 1e-6
    if depth:
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            gs = np.cumsum(np.bincount(bins[rows, k], gradient[rows], minlength=len(edges) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, k], hessian[rows], minlength=len(edges) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(hs < 1) | (h - hs < 1)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best_gain:
                best, best_gain = (k, at), gain[at]
    if best is None:
        step[rows] += -0.3 * g / (h + 1)
        return
    k, at = best
    for above in (False, True):
        child = rows[(bins[rows, k] > at) == above]
        longer = (*path, (k, above, float(cuts[k][at])))
        rules.append(longer)
        _grow(bins, cuts, gradient, hessian, child, depth - 1, longer, rules, step)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, without repeats."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges, x[:, k], "left") for k, edges in enumerate(cuts)], 1)
    rules: list[Rule] = []
    logit = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        step = np.zeros(len(y))
        _grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), TREE_DEPTH, (), rules, step)
        logit += step
    return list(dict.fromkeys(tuple(sorted(set(rule))) for rule in rules))


def lasso_logistic(met: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    x = np.concatenate([np.ones((len(y), 1)), met.astype(float)], 1)
    rate = 4 * len(y) / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = np.zeros(x.shape[1])
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ ahead)))
        new = ahead - rate * (x.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the labels y (0 or 1) by the statistics x."""
    positive = float(y.sum())
    if not len(y) or positive in (0.0, float(len(y))):
        return Model(float(np.log((positive + 1) / (len(y) - positive + 1))), ())
    rules = extract_rules(x, y)
    intercept, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], 1), y, LASSO)
    chosen = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4]
    return Model(intercept, tuple(chosen))


_KIND = "struct<" + ", ".join(f"{name}: double" for name in STATISTICS) + ">"
_TYPE = pa.struct([(name, pa.float64()) for name in STATISTICS])


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column of the statistics of its text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                x = statistics(texts)
                struct = pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(x.shape[1])], fields=list(_TYPE))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, struct], names=[*rows.schema.names, name])

    columns = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*columns, f"`{name}` {_KIND}"]))


def learn(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, fold: int = 0, of: int = 5) -> Model:
    """Fit on measured(doc_id, s) joined with labels, outside the held-out fold.

    About max_rows labelled documents are used, all if there are no more: those whose hash of the
    id is below a threshold. So what reaches the driver does not grow with the labels.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.where(~held_out("doc_id", fold, of))
    share = max_rows / max(marked.count(), 1)
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = measured.join(marked, "doc_id").select("s.*", "quality")
    rows = sample.toPandas().sort_values(list(STATISTICS))
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["quality"].to_numpy(float) > 0).astype(float))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, statistics of every row of docs."""
    measured = written(with_statistics(docs.select("doc_id", "text"), "s").select("doc_id", "s"), "rule-statistics")
    model = learn(measured, labels, max_rows)
    value = model.column(lambda name: F.col(f"s.{name}"))
    return measured.select("doc_id", held_out("doc_id", 0, 5).alias("held_out"), value.alias("score"), "s").select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("s").alias("statistics")
    )


def keep_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs predicted to be of quality 1, with all their columns."""
    # Only the statistics meet the labels; texts are read again for the verdict and never shuffled.
    model = learn(with_statistics(docs.select("doc_id", "text"), "s").select("doc_id", "s"), labels, max_rows)
    name = free_name(docs, "statistics")
    measured = with_statistics(docs, name)
    return measured.where(model.column(lambda s: F.col(f"{name}.{s}")) >= THRESHOLD).select(*docs.columns)

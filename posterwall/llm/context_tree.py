"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node of the binary tree of bytes. Every such node has
a context tree of its own whose contexts are the DEPTH bytes before. A context keeps how often the
decision was 0 and 1. Its Krichevsky-Trofimov estimate depends on these counts alone, and its weighted
probability is half that estimate and half the product of its children's, so all depths are mixed.

Training counts runs of DEPTH + 1 bytes over all training texts and climbs from the longest context
to the root, one aggregation per depth. Coming down again, each depth mixes its own prediction
with the one below, by weights from both probabilities; what arrives at the leaves is the probability
of every bit, and so of every run, after training. A text's score is the sum over its bytes and the
end of the text. Runs that occur in scored texts only take part with a count of zero.

Texts are lower-cased (A-Z). The base score is that of single words with add-one smoothing. Both
look up frequent keys in a broadcast table whose number of rows is bounded by a parameter; the
others of each text are joined with the full tables, so nothing is left out.

Null and empty texts hold the end only. Repeated rows are scored each. Null ids are learned
from and never held out. Without training texts every bit has probability 1/2 and the base score is
log10(1 / (0 + 1 * (0 + 1))) = 0 per token.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.folds import held_out
from posterwall.llm.store import written
from posterwall.llm.textscan import LOWER, Scan, text_slices

DEPTH = 5
HEAD_WORDS = 1 << 18
HEAD_RUNS = 1 << 20
END = 0xFF  # never occurs in UTF-8; also the context before the first byte

_WORD, _RUN, _TEXT = 0, 1, 2
_PENDING = 2 << 20


def runs(texts: list[bytes | None], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, run) of each byte of each text and of its end: the byte and the `depth` before it."""
    pad, end = bytes([END]) * depth, bytes([END])
    data = LOWER[np.frombuffer(b"".join(pad + (t or b"") + end for t in texts), np.uint8)]
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    key = np.zeros(max(len(data) - depth, 0), np.int64)
    for j in range(depth + 1):
        key <<= 8
        key |= data[j : j + len(key)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    # The position in data of a text's i-th byte, less depth, is where its run starts.
    start = np.cumsum(sizes + depth) - (sizes + depth)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[doc]
    return doc, key[place]


class _Counter:
    """Sums by (kind, key), merged when they get many and handed on beyond a bound."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, kind: int, keys: np.ndarray, learned: np.ndarray) -> None:
        found, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, learned, minlength=len(found)).astype(np.int64)
        self.parts.append((np.full(len(found), kind, np.int8), found.view(np.int64), n, np.bincount(at, minlength=len(found))))
        self.size += len(found)

    def merge(self) -> None:
        kind, key, learned, total = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, kind))
        kind, key, learned, total = kind[order], key[order], learned[order], total[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))))
        self.parts = [(kind[first], key[first], np.add.reduceat(learned, first), np.add.reduceat(total, first))]
        self.size = len(first)

    def take(self) -> pa.RecordBatch:
        self.merge()
        columns = [pa.array(x) for x in self.parts[0]]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "learned", "total"])


def _counted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, texts in text_slices(batch.column(0)):
                scan = Scan(texts, lower=True)
                learned = ~out[a:b]
                counter.add(_WORD, scan.word_hash(), learned[scan.doc])
                doc, key = runs(texts, depth)
                counter.add(_RUN, key, learned[doc])
                counter.add(_TEXT, np.zeros(b - a, np.int64), learned)
                if counter.size > _PENDING:
                    counter.merge()
                    if counter.size > _PENDING // 2:
                        yield counter.take()
        if counter.parts:
            yield counter.take()

    return run


def count_corpus(docs: DataFrame, out: Column, depth: int = DEPTH) -> DataFrame:
    """kind, key, learned, total: how often words and runs occur in training texts and in all."""
    pairs = docs.select("text", out.alias("out"))
    partial = pairs.mapInArrow(_counted(depth), "kind tinyint, key bigint, learned bigint, total bigint")
    return partial.groupBy("kind", "key").agg(F.sum("learned").alias("learned"), F.sum("total").alias("total"))


def _log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series from x + 7 on."""
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    stirling = (y - 0.5) * F.log(y) - y + 0.5 * float(np.log(2 * np.pi)) + series
    # x alone in the product would overflow for large counts; there the shift is not needed.
    large = (x - 0.5) * F.log(x) - x + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * x)
    return F.when(x < 1e5, stirling - F.log(product)).otherwise(large)


def _log_estimate() -> Column:
    """Krichevsky-Trofimov estimate of n0 zeros and n1 ones, as a natural logarithm."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - float(np.log(np.pi)) - _log_gamma(n0 + n1 + 1)


def _parent(node: str, depth: int) -> Column:
    """The node of the same decision whose context is the last `depth` bytes."""
    context = F.shiftright(node, 8).bitwiseAND(F.lit((1 << 8 * depth) - 1).cast("long"))
    return F.shiftleft(context, 8).bitwiseOR(F.col(node).bitwiseAND(F.lit(255).cast("long")))


def run_probabilities(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, logp of every run: log10 of its last byte's probability after the bytes before."""
    runs_ = counts.where(F.col("kind") == _RUN)
    bits = runs_.select("key", "learned", F.explode(F.array(*map(F.lit, range(8)))).alias("k")).select(
        "key",
        "learned",
        F.shiftleft(F.shiftright("key", 8), 8)
        .bitwiseOR(F.expr("shiftleft(1, k)").bitwiseOR(F.expr("shiftright(cast(key & 255 as int), 8 - k)")).cast("long"))
        .alias("node"),
        F.expr("shiftright(cast(key & 255 as int), 7 - k) & 1").alias("bit"),
    )
    leaves = bits.groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("learned")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("learned")).otherwise(0)).alias("n1"),
    )
    estimate = _log_estimate()
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    levels = {depth: written(leaves.select("node", "n0", "n1", one.alias("one"), estimate.alias("weighted")), "ctw-leaf")}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(_parent("node", d).alias("node")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
        )
        up = up.select("node", "n0", "n1", "below", one.alias("one"), estimate.alias("own"))
        # Half and half of both, without leaving the logarithms.
        more, less = F.greatest("own", "below"), F.least("own", "below")
        weighted = more + F.log1p(F.exp(less - more)) - float(np.log(2))
        share = 1 / (1 + F.exp(F.col("below") - F.col("own")))
        levels[d] = written(up.select("node", "n0", "n1", "one", weighted.alias("weighted"), share.alias("share")), "ctw-node")
    mixed = levels[0].select("node", (F.col("share") * F.col("one")).alias("sum"), (1 - F.col("share")).alias("rest"))
    for d in range(1, depth + 1):
        share = F.col("share") if d < depth else F.lit(1.0)
        above = mixed.withColumnRenamed("node", "parent")
        # Sizes of files say little here: the tables are numbers that compress well.
        joined = levels[d].withColumn("parent", _parent("node", d - 1)).join(above.hint("merge"), "parent")
        mixed = joined.select(
            "node", (F.col("sum") + F.col("rest") * share * F.col("one")).alias("sum"), (F.col("rest") * (1 - share)).alias("rest")
        )
    of_bit = F.when(F.col("bit") == 1, F.col("sum")).otherwise(1 - F.col("sum"))
    return bits.join(mixed.hint("merge"), "node").groupBy("key").agg(F.sum(F.log10(of_bit)).alias("logp"))


def _head(rows: DataFrame, value: str, weight: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, values, least weight) of the rows of the highest weights: `most` at most, whole weights only.

    Weights are counted by their logarithm, so what reaches the driver is a few hundred counts and the
    head itself. Weights that are too frequent to fit are left to the join, and so is all below them.
    """
    step = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double")) * 16)
    counted = rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(weight).alias("low"), F.max(weight).alias("high"))
    least, held = None, 0
    for row in counted.orderBy(F.desc("step")).collect():
        held += row["n"]
        if held > most:
            least = row["high"] + 1 if least is None else least
            break
        least = row["low"]
    least = 0 if least is None else least
    kept = rows.where(F.col(weight) >= least).select("key", value).toArrow()
    keys, values = kept["key"].to_numpy().astype(np.int64), kept[value].to_numpy().astype(float)
    order = np.argsort(keys)
    return keys[order], values[order], least


def _found(keys: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted head, and whether it is there; keys are looked up in order."""
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(head, keys[order])
    at[at == len(head)] = 0
    return at, (head[at] == keys) if len(head) else np.zeros(len(keys), bool)


_TAIL_TYPE = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))


def _tails(doc: np.ndarray, keys: np.ndarray, n_texts: int) -> pa.Array:
    """Per text, its distinct keys with their numbers."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])))) if len(doc) else doc
    n = np.diff(np.append(first, len(doc)))
    offsets = np.searchsorted(doc[first], np.arange(n_texts + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(keys[first]), pa.array(n)], names=["key", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def score(docs: DataFrame, out: Column, depth: int = DEPTH, head_words: int = HEAD_WORDS, head_runs: int = HEAD_RUNS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    counts = written(count_corpus(docs, out, depth), "ctw-counts")
    words = counts.where((F.col("kind") == _WORD) & (F.col("learned") > 0))
    n_words, known, n_texts = counts.agg(
        F.sum(F.when(F.col("kind") == _WORD, F.col("learned"))),
        F.sum(F.when((F.col("kind") == _WORD) & (F.col("learned") > 0), 1)),
        F.sum(F.when(F.col("kind") == _TEXT, F.col("learned"))),
    ).first()
    n_words, known, n_texts = n_words or 0, known or 0, n_texts or 0
    tokens, distinct = n_words + n_texts, known + (n_texts > 0)
    unknown = -float(np.log10(tokens + distinct + 1))
    table = written(run_probabilities(counts, depth), "ctw-runs").join(
        counts.where(F.col("kind") == _RUN).select("key", "total").hint("merge"), "key"
    )
    table = written(table.select("key", "logp", "total"), "ctw-table")
    word_gain = F.log10(F.col("learned") + 1)
    word_keys, word_values, least_word = _head(words.select("key", "learned", word_gain.alias("gain")), "gain", "learned", head_words)
    run_keys, run_values, least_run = _head(table, "logp", "total", head_runs)
    shared = spark.sparkContext.broadcast((word_keys, word_values, run_keys, run_values))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare_words", "rare_runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, gains, runs_, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, part in text_slices(batch.column(1)):
                n = b - a
                scan = Scan(part, lower=True)
                tokens_ = scan.n_words() + 1
                hashes = scan.word_hash().view(np.int64)
                at, there = _found(hashes, words_)
                gain = np.bincount(scan.doc[there], gains[at[there]], minlength=n) + ends
                doc, key = runs(part, depth)
                at_run, there_run = _found(key, runs_)
                columns = [
                    pa.array(np.arange(row, row + n)),
                    batch.column(0).slice(a, n),
                    batch.column(2).slice(a, n),
                    pa.array(tokens_),
                    pa.array(np.bincount(scan.doc[there], minlength=n) + (n_texts > 0)),
                    pa.array(tokens_ * unknown + gain),
                    pa.array(np.bincount(doc[there_run], logs[at_run[there_run]], minlength=n).astype(float)),
                    pa.array(np.bincount(doc, minlength=n)),
                    _tails(scan.doc[~there], hashes[~there], n),
                    _tails(doc[~there_run], key[~there_run], n),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ends = float(np.log10(n_texts + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "array<struct<key: bigint, n: bigint>>"
    partial = docs.select("doc_id", "text", out.alias("held_out")).mapInArrow(
        run,
        f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
        f"n_bytes bigint, rare_words {tail}, rare_runs {tail}",
    )
    partial = written(partial, "ctw-partial")

    def rare(column: str, values: DataFrame, value: str) -> DataFrame:
        each = partial.select("row", F.explode(column).alias("r")).select("row", "r.key", "r.n")
        return each.join(values.hint("merge"), "key").select("row", "n", F.col(value).alias("value"))

    rare_words = rare("rare_words", words.where(F.col("learned") < least_word).select("key", word_gain.alias("gain")), "gain")
    rare_runs = rare("rare_runs", table.where(F.col("total") < least_run).select("key", "logp"), "logp")
    zero = F.lit(0.0)
    added = (
        rare_words.select("row", F.col("n").alias("known"), (F.col("n") * F.col("value")).alias("base"), zero.alias("model"))
        .unionAll(rare_runs.select("row", F.lit(0).cast("long"), zero, F.col("n") * F.col("value")))
        .groupBy("row")
        .agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("model").alias("model"))
    )
    full = partial.drop("rare_words", "rare_runs").join(added.hint("merge"), "row", "left")
    score_ = F.col("score") + F.coalesce("model", zero)
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        score_.alias("score"),
        (-score_ * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame, fold: int = 2, of: int = 7) -> DataFrame:
    """Scores of docs(doc_id, text), learned from the rows outside the held-out fold."""
    return score(docs, held_out("doc_id", fold, of))

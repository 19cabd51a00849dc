"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a window forwards and backwards and labels every position; the
probabilities of a document are the mean over all its positions that lie in letters. It is trained
in numpy by backpropagation through time on windows of a bounded sample of documents, and applied
to whole texts: long ones are cut into windows, which run side by side.

Each gate of the forward and of the backward cell is a row block of one matrix, so a step of a cell
is one product for all windows. The gate for the candidate multiplies the product, not the state.

Null texts and texts without letters get `und` with score 0. Scores have six decimals. Rows of
null language are not learned from. Without any language to learn, the answer is `und`; with a single
one it is that language. Extra columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from posterwall.llm.folds import held_out
from posterwall.llm.textscan import slices
from posterwall.session import broadcast_if_small

# Bounds of the sample that is learned from, per language, and of what is taken of each text there.
MAX_DOCUMENTS = 400
WINDOWS_A_TEXT = 8

HIDDEN = 8
WINDOW = 64
ROUNDS = 600
BATCH = 128
RATE = 0.02
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_WORDS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Model:
    """languages, and the weights: per direction input table (256, 3H), recurrent (3H, H), bias (3H), output (L, H)."""

    languages: tuple[str, ...]
    weights: dict


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(n_languages: int, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        w[f"U{d}"] = rng.normal(0, HIDDEN**-0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)
        w[f"c{d}"] = np.zeros((3 * HIDDEN, 1), np.float32)
        w[f"V{d}"] = rng.normal(0, HIDDEN**-0.5, (n_languages, HIDDEN)).astype(np.float32)
    w["o"] = np.zeros((n_languages, 1), np.float32)
    return w


def run_cell(w: dict, d: str, data: np.ndarray, keep: bool = False):
    """States (T, H, B) of a direction over bytes (T, B); with keep also what training needs.

    z decides how much of the state stays, r how much of it the candidate sees.
    """
    steps, width = data.shape
    state = np.zeros((HIDDEN, width), np.float32)
    states = np.empty((steps, HIDDEN, width), np.float32)
    table, u, c, kept = np.ascontiguousarray(w[f"E{d}"].T), w[f"U{d}"], w[f"c{d}"], {}
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[:, data[t]]
        h = u @ state + c
        gates = sigmoid(x[: 2 * HIDDEN] + h[: 2 * HIDDEN])
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        n = np.tanh(x[2 * HIDDEN :] + r * h[2 * HIDDEN :])
        if keep:
            kept[t] = (state, z, r, n, h[2 * HIDDEN :])
        state = n + z * (state - n)
        states[t] = state
    return (states, kept) if keep else states


def position_probabilities(w: dict, data: np.ndarray) -> np.ndarray:
    """(T, L, B): the label of every position."""
    logits = w["Vf"] @ run_cell(w, "f", data) + w["Vb"] @ run_cell(w, "b", data) + w["o"]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(1, keepdims=True)


def gradients(w: dict, data: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the positions of mask (T, B), and its gradient by the weights."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    states, kept = {}, {}
    for d in "fb":
        states[d], kept[d] = run_cell(w, d, data, keep=True)
    logits = w["Vf"] @ states["f"] + w["Vb"] @ states["b"] + w["o"]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    n = max(float(mask.sum()), 1.0)
    columns = np.arange(data.shape[1])
    loss = float(-(np.log(p[:, labels, columns] + 1e-9) * mask).sum() / n)
    p[:, labels, columns] -= 1
    error = p * (mask[:, None] / n).astype(np.float32)
    g["o"] = error.sum((0, 2))[:, None]
    steps = data.shape[0]
    for d in "fb":
        g[f"V{d}"] = np.einsum("tlb,thb->lh", error, states[d], optimize=True)
        into = np.zeros((HIDDEN, data.shape[1]), np.float32)
        u, inputs = w[f"U{d}"], np.empty((steps, 3 * HIDDEN, data.shape[1]), error.dtype)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            before, z, r, new, h_new = kept[d][t]
            dh = w[f"V{d}"].T @ error[t] + into
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * h_new * r * (1 - r)
            dx = np.concatenate([dz, dr, dn])
            dgate = np.concatenate([dz, dr, dn * r])
            g[f"U{d}"] += dgate @ before.T
            g[f"c{d}"] += dgate.sum(1, keepdims=True)
            inputs[t] = dx
            into = dh * z + u.T @ dgate
        # Rows of the input table are summed over the places of their byte.
        flat = inputs.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
        order = np.argsort(data, axis=None, kind="stable")
        present, first = np.unique(data.reshape(-1)[order], return_index=True)
        g[f"E{d}"][present] = np.add.reduceat(flat[order], first, axis=0)
    return loss, g


def train(data: np.ndarray, labels: np.ndarray, mask: np.ndarray, n_languages: int, rounds: int = ROUNDS) -> dict:
    """Adam on random batches of windows; data (T, N), labels (N), mask (T, N)."""
    rng = np.random.default_rng(11)
    w = initial(n_languages)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    for i in range(1, rounds + 1):
        rows = rng.integers(0, data.shape[1], BATCH)
        _, g = gradients(w, data[:, rows], labels[rows], mask[:, rows])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * (1 - i / (rounds + 1))
        for k in w:
            x = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            s[k] = 0.99 * s[k] + 0.01 * x * x
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _letters(text: str) -> np.ndarray:
    """Which bytes of a text belong to letters."""
    flags = np.zeros(len(text.encode()), np.int8)
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8) | 32
        return (codes >= 97) & (codes <= 122)
    # Place of each character's first byte; marks at the edges of runs of letters, summed up.
    sizes = np.array([len(c.encode()) for c in text]) if len(text) < 64 else _sizes(text)
    start = np.concatenate(([0], np.cumsum(sizes)))
    edges = np.zeros(len(flags) + 1, np.int32)
    spans = [m.span() for m in _WORDS.finditer(text)]
    if spans:
        at = np.array(spans)
        np.add.at(edges, start[at[:, 0]], 1)
        np.add.at(edges, start[at[:, 1]], -1)
    return np.cumsum(edges[:-1]) > 0


def _sizes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def windows(texts: list[bytes], letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes (T, N), counted positions (T, N), text of each window) of whole texts.

    A window past the end of its text is filled with zeros, which are not counted.
    """
    count = [-(-len(t) // WINDOW) for t in texts]
    total = sum(count)
    data, mask = np.zeros((total, WINDOW), np.uint8), np.zeros((total, WINDOW), bool)
    at = 0
    for text, flags, n in zip(texts, letters, count):
        flat = slice(at * WINDOW, at * WINDOW + len(text))
        data.reshape(-1)[flat] = np.frombuffer(text, np.uint8)
        mask.reshape(-1)[flat] = flags
        at += n
    return np.ascontiguousarray(data.T), np.ascontiguousarray(mask.T), np.repeat(np.arange(len(texts)), count)


def sample(docs: DataFrame, most: int = MAX_DOCUMENTS) -> DataFrame:
    """lang, data, mask: WINDOWS_A_TEXT windows, evenly spread over the whole text, of each of about
    `most` documents of each language, chosen by a hash of the id."""
    rows = docs.where("lang is not null and text is not null")
    counts = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_count"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # Languages are few, so texts stay where they are.
    counts = broadcast_if_small(counts, F.length("_lang"))
    drawn = rows.join(counts, F.col("lang") == F.col("_lang")).where(draw < most / F.col("_count")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, mask, _ = windows([text.encode()], [_letters(text)])
                if not mask.any():
                    continue
                chosen = np.unique(np.linspace(0, data.shape[1] - 1, WINDOWS_A_TEXT).astype(int))
                columns = [[lang] * len(chosen), [data[:, k].tobytes() for k in chosen], [mask[:, k].tobytes() for k in chosen]]
                kinds = [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["lang", "data", "mask"])

    return drawn.mapInArrow(run, "lang string, data binary, mask binary")


def learn(docs: DataFrame, most: int = MAX_DOCUMENTS) -> Model:
    """A model of the languages in docs(doc_id, text, lang), from a bounded sample."""
    rows = sorted((r["lang"], bytes(r["data"]), bytes(r["mask"])) for r in sample(docs, most).collect())
    languages = tuple(sorted({lang for lang, _, _ in rows}))
    if len(languages) < 2:
        return Model(languages, {})
    labels = np.array([languages.index(lang) for lang, _, _ in rows])
    data = np.frombuffer(b"".join(d for _, d, _ in rows), np.uint8).reshape(-1, WINDOW)
    mask = np.frombuffer(b"".join(m for _, _, m in rows), bool).reshape(-1, WINDOW)
    # Every language weighs the same, whatever its share of the sample.
    order = np.argsort(labels, kind="stable")
    rng, size = np.random.default_rng(3), max(np.bincount(labels))
    even = np.concatenate([rng.choice(order[labels[order] == k], size) for k in range(len(languages))])
    return Model(languages, train(data[even].T, labels[even], mask[even].T, len(languages)))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    letters = [_letters(t) if t else np.zeros(0, bool) for t in texts]
    if len(model.languages) < 2:
        known = model.languages[0] if model.languages else UNDETERMINED
        labels = [known if f.any() else UNDETERMINED for f in letters]
        return labels, np.array([float(x != UNDETERMINED) for x in labels])
    data, mask, owner = windows([(t or "").encode() for t in texts], letters)
    p = np.zeros((len(model.languages), data.shape[1]), np.float32)
    step = 4096
    for a in range(0, data.shape[1], step):
        part = position_probabilities(model.weights, data[:, a : a + step])
        p[:, a : a + step] = np.einsum("tlb,tb->lb", part, mask[:, a : a + step].astype(np.float32))
    n = np.array([f.sum() for f in letters])
    pooled = np.stack([np.bincount(owner, row, minlength=len(texts)) for row in p], 1) / np.maximum(n, 1)[:, None]
    # Single precision rounds by the place in a block; that ends well below the sixth decimal.
    pooled = np.round(pooled, 6)
    best = pooled.argmax(1)
    labels = [model.languages[k] if m else UNDETERMINED for k, m in zip(best, n)]
    return labels, np.where(n > 0, np.clip(pooled[np.arange(len(texts)), best], 0, 1), 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                labels, score = predict(texts[a:b], shared.value)
                columns = [batch.column(0).slice(a, b - a), pa.array(labels), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_documents(docs: DataFrame, fold: int = 0, of: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside the held-out fold."""
    out = held_out("doc_id", fold, of)
    model = learn(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")

"""Quality rules by compression: bands of zstandard ratios over whole texts and fixed chunks.

A text that compresses far better than prose repeats itself; one that hardly compresses is
encoded or random. Prose compresses better the longer it is, so each limit belongs to a length.
The base rules count words, symbols, repeated lines and repeated five-word windows.

Null and empty texts have no words: they fail the base rule and count zero everywhere. Equal
texts get equal verdicts. All columns of the input may be null and extra columns are ignored by
`measure` and kept by `keep_documents`.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from posterwall.llm.textscan import Scan, repeats, text_slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """(bytes from which a band holds, lowest ratio, highest ratio), by rising length.

    The highest ratios stand 0.03 to 0.06 above those of texts labelled 1 in four languages (sf0.1: 0.92
    from 128 bytes on, 0.74, 0.68, 0.58, 0.52, 0.48 with chunks, 0.43). Hexadecimal digits compress as
    such texts do below 2,048 bytes, so only longer ones leave the bands (from 4,096 bytes on).
    Very short texts have no limits, as the frame header outweighs them. A text is rejected when
    its own ratio is outside, or when chunks outside hold more than bad_share of its bytes.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (64, 0.35, float("inf")),
        (128, 0.35, 0.95),
        (256, 0.30, 0.80),
        (512, 0.30, 0.72),
        (1024, 0.25, 0.62),
        (2048, 0.25, 0.56),
        (4096, 0.25, 0.51),
        (16384, 0.20, 0.48),
    )
    chunk_bytes: int = 4096
    bad_share: float = 1 / 3
    level: int = 3
    min_words: int = 10
    max_repeat_percent: int = 20

    def outside(self, sizes: np.ndarray, packed: np.ndarray) -> np.ndarray:
        edges = np.array([b for b, _, _ in self.limits])
        band = np.searchsorted(edges, sizes, "right") - 1
        low = np.array([x for _, x, _ in self.limits])[band]
        high = np.array([x for _, _, x in self.limits])[band]
        ratio = packed / np.maximum(sizes, 1)
        return (sizes > 0) & ((ratio < low) | (ratio > high))


def base_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    scan = Scan(texts)
    line_doc, start, end = scan.lines()
    _, again = repeats(scan.keyed(line_doc, scan.span_hash(start, end)))
    doc, hashes = scan.windows(5)
    inside = np.flatnonzero(doc >= 0)
    members, _ = repeats(scan.keyed(doc[inside], hashes[inside]))
    covered = np.zeros(len(scan.start), bool)
    for j in range(5):
        covered[inside[members] + j] = True
    character = (scan.data & 0xC0) != 0x80
    return {
        "n_words": scan.n_words(),
        "word_chars": scan.per_text(scan.in_word & character),
        "n_symbols": scan.per_text(SYMBOLS[scan.data]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=scan.n),
        "n_repeat_words": np.bincount(scan.doc[covered], minlength=scan.n),
    }


def compression(texts: list[bytes | None], bands: Bands) -> dict[str, np.ndarray]:
    """Ratio of each whole text, share of its bytes in chunks outside their band, and the verdict."""
    packer = zstandard.ZstdCompressor(level=bands.level)
    size = np.array([len(t or b"") for t in texts], np.int64)
    packed = np.array([len(packer.compress(t)) if t else 0 for t in texts], np.int64)
    owner, chunk_size, chunk_packed = [], [], []
    for i, text in enumerate(texts):
        if len(text or b"") <= bands.chunk_bytes:
            continue
        for at in range(0, len(text), bands.chunk_bytes):
            chunk = text[at : at + bands.chunk_bytes]
            owner.append(i)
            chunk_size.append(len(chunk))
            chunk_packed.append(len(packer.compress(chunk)))
    chunk_size = np.array(chunk_size, np.int64)
    bad = bands.outside(chunk_size, np.array(chunk_packed, np.int64))
    bad_bytes = np.bincount(np.array(owner, np.int64)[bad], chunk_size[bad], minlength=len(texts))
    share = bad_bytes / np.maximum(size, 1)
    return {
        "zstd_ratio": packed / np.maximum(size, 1),
        "bad_chunk_share": share,
        "in_band": ~bands.outside(size, packed) & (share <= bands.bad_share),
    }


def verdicts(texts: list[bytes | None], bands: Bands) -> dict[str, np.ndarray]:
    """All columns of the rules for a slice of texts."""
    out = base_counts(texts)
    words, repeated = out["n_words"], out["n_repeat_words"]
    out["base_failed"] = (words < bands.min_words) | (100 * repeated > bands.max_repeat_percent * words)
    out |= compression(texts, bands)
    out["kept"] = ~out["base_failed"] & out.pop("in_band")
    return out


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"
)
_ORDER = [c.split()[0] for c in _COLUMNS.split(", ")]


def measure(docs: DataFrame, bands: Bands = Bands(), id_column: str = "doc_id") -> DataFrame:
    """The id and the rules' columns of every row of docs, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                found = verdicts(texts, bands)
                columns = [batch.column(0).slice(a, b - a), *(pa.array(found[c]) for c in _ORDER)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, *_ORDER])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {kind}, {_COLUMNS}")


def keep_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that pass the rules, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(verdicts(texts, bands)["kept"]))

    return docs.mapInArrow(run, docs.schema)

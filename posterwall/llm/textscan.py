"""Words, lines and word windows of many texts at once, as numpy arrays.

Words are maximal runs of bytes outside space and \\x09-\\x0D; these bytes never occur inside a
multi-byte UTF-8 character, so the words are those of the text. Words, lines and windows are
told apart by 64-bit hashes: sums of a random-looking number for each byte at each place of the span,
then mixed, so no structure of a text makes hashes collide. Texts are scanned in slices of
about SLICE_BYTES, so memory does not grow with the batch (a longer text is a slice of its own).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_SALT = np.uint64(0xD1B54A32D192ED03)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# The numbers of all bytes at the first places of a span.
_NUMBERS = mix((np.arange(_PLACES << 8, dtype=np.uint64) + np.uint64(1)) * _SPREAD)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of a text column as `slices` gives them, with their texts; no more is held as objects."""
    sizes = pc.binary_length(column.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False) + 1
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), start + 1)
        yield start, stop, text_bytes(column.slice(start, stop - start))
        start = stop


class Scan:
    """The words of a slice of texts. A null text has no words."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), np.uint8)
        self.data = LOWER[raw] if lower else raw
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, self.n)
        self.text_start = np.cumsum(sizes) - sizes
        self.in_word = ~WHITE[self.data]
        edge = np.flatnonzero(np.diff(self.in_word.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        if not self.n:
            return np.zeros(0, np.int64)
        return np.add.reduceat(flags, self.text_start, dtype=np.int64)

    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span (none is empty), whatever its place in the texts."""
        if not len(start):
            return np.zeros(0, np.uint64)
        sizes = end - start
        first = np.cumsum(sizes) - sizes
        total = int(first[-1] + sizes[-1])
        # Steps of one, and at the first byte of a span the jump there: two running sums.
        place, at = np.ones(total, np.int32), np.ones(total, np.int32)
        place[0], at[0] = 0, start[0]
        place[first[1:]] = 1 - sizes[:-1]
        at[first[1:]] = start[1:] - end[:-1] + 1
        np.cumsum(place, out=place)
        np.cumsum(at, out=at)
        far = np.flatnonzero(place >= _PLACES) if sizes.max() > _PLACES else place[:0]
        number = place << 8
        number |= self.data[at]
        beyond = number[far].astype(np.uint64)
        number[far] = 0
        numbers = _NUMBERS[number]
        numbers[far] = mix((beyond + np.uint64(1)) * _SPREAD)
        return mix(np.add.reduceat(numbers, first) + sizes.astype(np.uint64) * _SALT)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, width: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every window of so many words; none crosses a text."""
        words = self.word_hash() if words is None else words
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total = mix(total + words[j : j + n])
        inside = self.doc[:n] == self.doc[width - 1 :]
        return np.where(inside, self.doc[:n], -1), total

    def keyed(self, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Hashes that differ between texts."""
        return mix(hashes ^ (doc.astype(np.uint64) * _SALT))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the lines that hold a word."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        filled = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end = start[filled], end[filled]
        return np.searchsorted(self.text_start, start, "right") - 1, start, end


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all members of equal groups, all but one of each group) as flags."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    members, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    members[order[1:][same]] = True
    members[order[:-1][same]] = True
    later[order[1:][same]] = True
    return members, later

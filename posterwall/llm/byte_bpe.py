"""Byte-level BPE through a sentencepiece model that is serialised straight from the vocabulary.

Every byte stands for one printable character, so a token is a piece of such characters and text
needs no normalisation, escaping or byte fallback. A piece's score is its negative rank:
sentencepiece merges the pair of the highest score first, the leftmost of equal ones, which is
the order of the ranks. Pre-tokens, the matches of the vocabulary's pattern, are encoded one by one,
so no merge crosses them. Decoding maps ids to pieces and characters back to bytes.

Null text counts as empty; empty text has no ids. Equal texts have equal ids. Other columns of the
input are ignored.
"""

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from posterwall.llm.textscan import slices

# A worker forgets the pre-tokens it has seen beyond so many.
CACHE_ENTRIES = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_characters() -> list[str]:
    """A character for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model (protocol buffer) whose piece ids are the ranks.

    The unknown piece that the format asks for comes last; every byte has a piece, so nothing uses it.
    """
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to the number of tokens less one")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for bytes {missing[:5]}")
    character = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(character[b] for b in token).encode()
        pieces.append(_bytes(1, _bytes(1, name) + b"\x15" + struct.pack("<f", -rank) + _number(3, normal)))
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(ranks))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))  # no begin, end or padding piece
    identity = _bytes(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, identity)


class Codec:
    """Encoder and decoder of one model, with a bounded cache of pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))  # Latin-1 code point, that is byte, to character
        back = {ord(c): b for b, c in enumerate(characters)}
        n = self.processor.get_piece_size() - 1
        self.token = [bytes(back[ord(c)] for c in self.processor.id_to_piece(i)) for i in range(n)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        parts = self.pattern.findall(text)
        cache = self.cache
        new = [p for p in dict.fromkeys(parts) if p not in cache]
        if new:
            mapped = [p.encode().decode("latin-1").translate(self.to_characters) for p in new]
            found = dict(zip(new, map(tuple, self.processor.encode(mapped, num_threads=1))))
            if len(cache) + len(new) > CACHE_ENTRIES:
                known = {p: cache[p] for p in dict.fromkeys(parts) if p in cache}
                cache.clear()
                found |= known
            cache.update(found)
        return list(chain.from_iterable(map(cache.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(model: bytes, pattern: str) -> Codec:
    key = (hash(model), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id, ids array<int>, decoded binary of every row of docs(id, text).

    vocabulary is the path of a rank file on the driver; the model made from it travels with the
    tasks as a broadcast, whose size is that of the vocabulary.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [codec.encode(t) if t else [] for t in texts[a:b]]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(map(codec.decode, ids), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_column}` {kind}, ids array<int>, decoded binary"
    return docs.select(id_column, "text").mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, text_sha256 of every row of docs(doc_id, text); the digest is of the decoded ids."""
    encoded = encode(docs, vocabulary, pattern)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256")
    )

"""Media columns cut into content-defined chunks.

A payload is cut where a rolling gear hash of the last 32 bytes has zeros on top, so equal stretches
of different payloads give equal chunks wherever they stand. The chunk list of a payload, digests
and sizes in order, is its recipe. The store holds each distinct chunk once, packed. It is a table
of packs: what a payload brings that no other brings. Joins of the digests tell which payload
brings a chunk (the smallest digest and position) and which row brings a payload (the smallest id);
no chunk moves for that. Reading joins the recipes with the chunks of other packs where a payload
needs them, puts the chunks in order, verifies the digests of chunks and payload, and computes
features; of a payload its packed chunks are held, nothing of its neighbours.

The stored form of a payload is its manifest (the serialised recipe) followed by its packed chunks.
Null text counts as empty; payloads are never empty, as they are padded to a positive multiple of
576 bytes. Repeated rows, also of one id, give rows with equal values. Null ids are rows like others.
Extra columns are ignored.
"""

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.store import written
from posterwall.llm.textscan import mix, slices, text_bytes
from posterwall.session import broadcast_if_small

UNIT = 576
PAD = 255
MIN_CHUNK = 2048
MAX_CHUNK = 16384
MASK_BITS = 12
LEVEL = 9
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MAGIC = b"CDC1"


def pad(text: bytes | None) -> bytes:
    """The payload of a text."""
    data = text or b""
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum over the last 32 bytes of gear << age, modulo 2**32."""
    total = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        older = total[:-width] << np.uint32(width)
        total = total.copy()
        total[width:] += older
    return total


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload. MIN_CHUNK exceeds the window, so no neighbour matters."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    marks = (np.flatnonzero(rolling_hash(data) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    out, base = [], 0
    for payload in payloads:
        ends, start, size = [], 0, len(payload)
        while size - start > MIN_CHUNK:
            at = bisect_left(marks, base + start + MIN_CHUNK)
            end = marks[at] - base if at < len(marks) else size
            end = min(end, start + MAX_CHUNK, size)
            ends.append(end)
            start = end
        if start < size:
            ends.append(size)
        out.append(ends)
        base += size
    return out


def manifest(chunks: list[tuple[bytes, int]]) -> bytes:
    return _MAGIC + struct.pack("<I", len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int64())]))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, chunks of every row of docs(doc_id, text)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "chunks"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in slices(texts):
                payloads = list(map(pad, texts[a:b]))
                lists = [
                    [{"digest": hashlib.sha256(p[s:e]).digest(), "size": e - s} for s, e in zip([0, *ends], ends)]
                    for p, ends in zip(payloads, cuts(payloads))
                ]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(t or b"") for t in texts[a:b]], pa.int64()),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array(hashlib.sha256(p).hexdigest() for p in payloads),
                    pa.array(lists, _CHUNKS),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, "
        "chunks array<struct<digest: binary, size: bigint>>"
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


_PACKED = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("size", pa.int64()), ("packed", pa.binary())]))


def _payload_sha256() -> Column:
    """Digest of the payload of text, in the JVM."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(data)
    missing = F.when(size == 0, UNIT).otherwise(F.pmod(-size, F.lit(UNIT)))
    return F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("FF"), missing))), 256)


def copies(lists: DataFrame) -> DataFrame:
    """doc_id, payload_sha256, skip, known: what the store need not get from a row of the recipes.

    skip: another row (of the smallest id) brings the payload. known: positions of chunks that another
    payload, or an earlier position, brings. Rows that bring all of theirs are left out.
    """
    rows = lists.select("doc_id", "payload_sha256").distinct()
    bringer = rows.groupBy("payload_sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    skipped = rows.join(bringer.hint("merge"), "payload_sha256").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    skipped = skipped.select("doc_id", "payload_sha256", F.lit(True).alias("skip"), F.array().cast("array<int>").alias("known"))
    payloads = lists.select("payload_sha256", "chunks").dropDuplicates(["payload_sha256"])
    named = payloads.select("payload_sha256", F.posexplode("chunks").alias("pos", "c")).select("payload_sha256", "pos", "c.digest")
    owner = named.groupBy("digest").agg(F.min(F.struct("payload_sha256", "pos")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = named.join(owner.hint("merge"), "digest").where(F.struct("payload_sha256", "pos") != F.col("owner"))
    known = known.groupBy("payload_sha256").agg(F.collect_set("pos").alias("known"))
    first = rows.groupBy("payload_sha256").agg(F.min("doc_id").alias("doc_id"))
    partly = first.join(known.hint("merge"), "payload_sha256").select("doc_id", "payload_sha256", F.lit(False).alias("skip"), "known")
    return written(skipped.unionAll(partly), "media-copies")


def write_store(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """payload_sha256, n, chunks(pos, digest, size, packed): each distinct chunk of docs, once.

    lists are the recipes of docs. A row of the store is a pack: what its payload brings. The join
    with the copies goes before the cutting, so nothing is packed twice; chunks are not shuffled.
    """
    notes = copies(lists).select(F.col("doc_id").alias("_id"), F.col("payload_sha256").alias("_sha"), "skip", "known")
    keyed = docs.select("doc_id", "text", _payload_sha256().alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    noted = keyed.join(broadcast_if_small(notes, F.length("_sha")), same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts, keys, knowns = text_bytes(batch.column(0)), batch.column(1), batch.column(2).to_pylist()
            for a, b in slices(texts):
                payloads, packs, sizes = list(map(pad, texts[a:b])), [], []
                for p, ends, known in zip(payloads, cuts(payloads), knowns[a:b]):
                    spans = enumerate(zip([0, *ends], ends))
                    own = [(pos, p[s:e]) for pos, (s, e) in spans if not known or pos not in known]
                    sizes.append(len(ends))
                    packs.append([
                        {"pos": pos, "digest": hashlib.sha256(c).digest(), "size": len(c), "packed": packer.compress(c)}
                        for pos, c in own
                    ])
                columns = [keys.slice(a, b - a), pa.array(sizes, pa.int32()), pa.array(packs, _PACKED)]
                yield pa.RecordBatch.from_arrays(columns, names=["payload_sha256", "n", "chunks"])

    brought = noted.where(~F.coalesce("skip", F.lit(False))).select("text", "sha", "known")
    packs = brought.mapInArrow(run, f"payload_sha256 string, n int, chunks {_PACK}")
    if not lists.groupBy("doc_id", "payload_sha256").count().where("count > 1").isEmpty():
        packs = packs.dropDuplicates(["payload_sha256"])  # rows that repeat an id with its text
    return written(packs.where(F.size("chunks") > 0), "media-store")


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Read the distinct payloads of the recipes back from the store, verified.

    payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each. Payloads whose pack holds
    all their chunks are read where the pack lies; the recipes of the others are joined with the
    chunks that they name.
    """
    whole = store.where(F.size("chunks") == F.col("n")).select("payload_sha256", "n", F.explode("chunks").alias("c"))
    apart = lists.select("payload_sha256", "chunks").join(
        store.where(F.size("chunks") == F.col("n")).select("payload_sha256").hint("merge"), "payload_sha256", "left_anti"
    )
    refs = apart.dropDuplicates(["payload_sha256"]).select(
        "payload_sha256", F.size("chunks").alias("n"), F.posexplode("chunks").alias("pos", "c")
    )
    refs = written(refs.select("payload_sha256", "n", "pos", "c.digest", "c.size"), "media-refs")
    held = store.select(F.explode("chunks").alias("c")).select("c.digest", "c.packed")
    held = held.join(broadcast_if_small(refs.select("digest").distinct()), "digest", "left_semi")
    pieces = refs.join(held.hint("merge"), "digest", "left").select("payload_sha256", "n", "pos", "digest", "size", "packed")
    ordered = pieces.repartition("payload_sha256").sortWithinPartitions("payload_sha256", "pos")
    columns = ["payload_sha256", "n", "digest", "size", "packed"]
    schema = "payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    own = whole.select("payload_sha256", "n", "c.digest", "c.size", "c.packed").mapInArrow(_assembled, schema)
    return own.unionAll(ordered.select(*columns).mapInArrow(_assembled, schema))


_PACK = "array<struct<pos: int, digest: binary, size: bigint, packed: binary>>"
_READ = {
    "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(),
    "feature": pa.string(),
}


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per payload, whose chunks follow each other in order."""
    reader, media = zstandard.ZstdDecompressor(), None
    for batch in batches:
        done = []
        for key, n, digest, size, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if media is None:
                media = _Media(key, n)
            media.add(digest, size, packed, reader)
            if len(media.chunks) == n:
                done.append(media.close())
                media = None
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in _READ.items()], names=list(_READ))


class _Media:
    """One payload as its chunks arrive in order."""

    def __init__(self, key: str, n: int):
        self.key, self.n = key, n
        self.chunks: list[tuple[bytes, int]] = []
        self.payload, self.packed = hashlib.sha256(), []
        self.packed_bytes, self.tail, self.samples = 0, b"", np.zeros(256, np.int64)

    def add(self, digest: bytes, size: int, packed: bytes | None, reader) -> None:
        if packed is None:
            raise ValueError(f"a chunk of {self.key} is not in the store")
        data = reader.decompress(packed, max_output_size=size)
        if hashlib.sha256(data).digest() != digest:
            raise ValueError(f"a chunk of {self.key} does not have its digest")
        self.chunks.append((digest, size))
        self.payload.update(data)
        self.packed.append(packed)
        self.packed_bytes += len(packed)
        self.tail = (self.tail + data)[-32:]
        self.samples += np.bincount(np.frombuffer(data, np.uint8), minlength=256)

    def close(self) -> dict:
        if self.payload.hexdigest() != self.key:
            raise ValueError(f"payload {self.key} does not have its digest")
        head = manifest(self.chunks)
        stored = hashlib.sha256(head)
        for packed in self.packed:
            stored.update(packed)
        n, values = int(self.samples.sum()), np.arange(256)
        mean = int((self.samples * values).sum()) / n
        square = int((self.samples * values * values).sum()) / n
        distinct = len({d for d, _ in self.chunks})
        return {
            "payload_sha256": self.payload.hexdigest(),
            "tail_crc32": zlib.crc32(self.tail),
            "media_bytes": len(head) + self.packed_bytes,
            "media_sha256": stored.hexdigest(),
            "feature": f"chunks={self.n};distinct={distinct};mean={mean:.4f};rms={square**0.5:.4f}",
        }


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(recipes of every row, chunk store, distinct payloads read back) of docs(doc_id, text)."""
    lists = written(recipes(docs), "media-recipes")
    store = write_store(docs, lists)
    return lists, store, read_media(lists, store)

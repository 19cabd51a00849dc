"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle is its frames, one after the
other, and a skippable frame at the end: the seek table of the public seekable Zstandard format,
with the sizes of all frames. The index has a row per record: bundle, frame, and offset and length
in the decompressed frame, so one record is read by decompressing one frame.

Of records with equal payloads the one with the smallest id is the response; the others are
revisits that refer to it and carry no payload. A null payload counts as empty. A row with a null id
is a response of its own that nothing refers to. Rows that repeat the response's id are responses,
too. Extra columns are ignored. An empty table gives no bundles.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from posterwall.llm.store import written
from posterwall.session import broadcast_if_small

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable Zstandard format and of the WARC standard.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "array<struct<record_id: string, frame: int, start: bigint, length: bigint>>"
BUNDLES = f"path string, content binary, records {_INDEX}"
_INDEX_TYPE = pa.list_(
    pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _headers(*pairs: tuple[str, str | int]) -> bytes:
    """Header lines; line breaks in a value would end it and are dropped."""
    lines = "".join(f"{k}: {str(v).replace(chr(13), '').replace(chr(10), '')}\r\n" for k, v in pairs)
    return lines.encode() + b"\r\n"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the HTTP headers but not the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers(
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))
    )
    block = http if refers_to is not None else http + payload
    kind = [("WARC-Type", "response")]
    if refers_to is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head = _headers(
        *kind,
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", url or ""),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    )
    return b"WARC/1.1\r\n" + head + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines) if name}


def read_record(record: bytes) -> dict:
    """Headers and payload of a record; revisits have no payload but its digest and length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = warc["warc-type"] == "revisit"
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
    return {
        "page_id": page_of(warc["warc-record-id"]),
        "url": warc["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": warc["warc-type"],
        "refers_to": page_of(warc.get("warc-refers-to")) if revisit else None,
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle of frames (compressed size, size)."""
    entries = b"".join(struct.pack("<II", *frame) for frame in frames)
    footer = struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    table = content[-9 - n * entry : -9]
    frames, start = [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", table, i * entry)
        frames.append((start, packed, size))
        start += packed
    return frames


def read_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    start, packed, size = frame
    data = zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=max(size, 1))
    if len(data) != size:
        raise ValueError("frame does not have the size in the seek table")
    return data


class _Bundle:
    """Records packed into frames; closes to content and index."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.content, self.open, self.index = bytearray(), bytearray(), []

    def add(self, record: str, data: bytes) -> None:
        self.index.append({"record_id": record, "frame": len(self.frames), "start": len(self.open), "length": len(data)})
        self.open += data
        if len(self.open) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open)))
        self.content += packed
        self.open.clear()

    def close(self) -> bytes:
        if self.open:
            self.end_frame()
        return bytes(self.content) + seek_table(self.frames)


def _digest() -> Column:
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def first_of_equal(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the payloads that revisit another page's; only digests are shuffled."""
    digests = pages.where("page_id is not null").select("page_id", _digest().alias("digest"))
    shared = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    shared = shared.where("refers_to < last").drop("last")
    return digests.join(shared.hint("merge"), "digest").where("page_id <> refers_to").distinct()


def write_bundles(pages: DataFrame) -> DataFrame:
    """path, content, records (the index) of the bundles of pages(page_id, url, html).

    path and content are those of a .warc.zst file. A page_id that has several payloads has a record
    for each row; every one refers by its own payload. Revisits are broadcast where a count shows
    that they are few, so pages are not shuffled for them.
    """
    rows = pages.select("page_id", "url", "html", _digest().alias("digest"))
    revisits = written(first_of_equal(pages), "warc-revisits")
    typed = rows.join(broadcast_if_small(revisits), ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, bundle = TaskContext.get().partitionId(), 0, _Bundle()

        def closed() -> pa.RecordBatch:
            columns = [
                pa.array([f"part-{part:05d}-{n:05d}.warc.zst"]),
                pa.array([bundle.close()], pa.binary()),
                pa.array([bundle.index], _INDEX_TYPE),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["path", "content", "records"])

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                bundle.add(record_id(page), write_record(page, url, (html or "").encode(), first))
                if len(bundle.content) >= BUNDLE_BYTES:
                    yield closed()
                    n, bundle = n + 1, _Bundle()
        if bundle.index:
            yield closed()

    return typed.select("page_id", "url", "html", "refers_to").mapInArrow(run, BUNDLES)


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, path, frame, start, length: where each record lies."""
    return bundles.select("path", F.explode("records").alias("r")).select("path", "r.*")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read back through seek table and index."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, payload binary"
    )
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content, index = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                frames, at = read_seek_table(content), 0
                for number, frame in enumerate(frames):
                    data, found = read_frame(content, frame), []
                    while at < len(index) and index[at]["frame"] == number:
                        r = index[at]
                        found.append(read_record(data[r["start"] : r["start"] + r["length"]]))
                        at += 1
                    columns = [pa.array([f[c] for f in found], t) for c, t in zip(names, types)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return bundles.select("content", "records").mapInArrow(run, schema)


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written bundles, records read back from them)."""
    bundles = written(write_bundles(pages), "warc-bundles")
    return bundles, read_bundles(bundles)

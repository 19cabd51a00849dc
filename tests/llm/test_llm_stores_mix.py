"""Chunk store, WARC bundles, source mix: round trips and invariants."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pytest
import zstandard

from posterwall.llm import chunk_store, source_mix, warc_bundles
from posterwall.llm.textscan import slices


def test_media_round_trip(edges, nothing):
    lists, store, read = chunk_store.store_media(edges)
    rows = lists.join(read, "payload_sha256").collect()
    assert len(rows) == edges.count()
    texts = {}
    for r in edges.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(chunk_store.pad((r.text or "").encode()))
    values = {}
    for r in rows:
        payload = next(p for p in texts[r.doc_id] if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 < len(payload)
        assert values.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    digests = [bytes(c.digest) for r in store.collect() for c in r.chunks]
    named = {bytes(c.digest) for r in lists.collect() for c in r.chunks}
    assert len(digests) == len(set(digests)) and set(digests) == named
    assert chunk_store.store_media(nothing)[2].count() == 0


def test_shared_stretches_are_stored_once(spark):
    rng = np.random.default_rng(1)
    part = "".join(map(chr, rng.integers(97, 123, 60_000)))
    docs = spark.createDataFrame([(1, part), (2, "x" * 999 + part), (3, part[:30_000]), (3, part[:30_000])], "doc_id long, text string")
    lists, store, read = chunk_store.store_media(docs)
    stored = sum(c.size for r in store.collect() for c in r.chunks)
    # All four hold 180,000 bytes; a cut moved by the prefix is found again within a few chunks.
    assert stored < 60_000 + 3 * chunk_store.MAX_CHUNK
    assert read.count() == 3


def test_cuts_depend_on_the_payload_alone():
    rng = np.random.default_rng(2)
    a, b = bytes(rng.integers(0, 256, 100_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 5_000, dtype=np.uint8))
    assert chunk_store.cuts([b, a, b])[1] == chunk_store.cuts([a])[0]
    ends = chunk_store.cuts([a])[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes[:-1].min() >= chunk_store.MIN_CHUNK and sizes.max() <= chunk_store.MAX_CHUNK
    h = 0
    for byte in a[:200]:
        h = ((h << 1) + int(chunk_store.GEAR[byte])) & 0xFFFFFFFF
    assert chunk_store.rolling_hash(np.frombuffer(a[:200], np.uint8))[-1] == h


def test_missing_or_damaged_chunks_are_noticed():
    packed = zstandard.ZstdCompressor().compress(b"data")
    media = chunk_store._Media("0" * 64, 1)
    with pytest.raises(ValueError):
        media.add(hashlib.sha256(b"data").digest(), 4, None, zstandard.ZstdDecompressor())
    with pytest.raises(ValueError):
        media.add(hashlib.sha256(b"else").digest(), 4, packed, zstandard.ZstdDecompressor())


PAGES = "page_id long, url string, html string, refers_to string, digest string"


def test_warc_round_trip(spark, monkeypatch):
    htmls = ["<p>a</p>", "", None, "x\r\n\r\ny", "<p>é</p>" * 1000, "b" * 700_000]
    rows = [(i, f"http://h/{i}\nx" if i % 7 else None, htmls[i % 6], "", "") for i in range(60)] + [(None, None, "<p>a</p>", "", "")]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    bundles, records = warc_bundles.archive(pages)
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()}
    first, want = {}, set()
    for page, _, html, *_ in sorted(rows[:60]):
        first.setdefault(html or "", page)
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = page is not None and first[html or ""] != page
        want.add((page, len(data), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert got == want
    # One record by its frame alone; a bundle is also one ordinary zstandard stream.
    content = {r.path: bytes(r.content) for r in bundles.collect()}
    for r in warc_bundles.record_index(bundles).collect():
        frame = warc_bundles.read_seek_table(content[r.path])[r.frame]
        data = warc_bundles.read_frame(content[r.path], frame)[r.start : r.start + r.length]
        assert warc_bundles.read_record(data)["page_id"] == warc_bundles.page_of(r.record_id)
    for data in content.values():
        frames = warc_bundles.read_seek_table(data)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(size for _, _, size in frames)


def test_warc_of_no_pages_and_bad_input(spark):
    bundles, records = warc_bundles.archive(spark.createDataFrame([], PAGES))
    assert bundles.count() == records.count() == 0
    with pytest.raises(ValueError):
        warc_bundles.read_seek_table(b"no bundle" + struct.pack("<IBI", 0, 0, 1))


def water_fill(sizes, weights):
    """Targets by handing out the excess again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not full:
            for i in open_:
                target[i] = share[i]
            break
        for i in full:
            target[i] = 3.0 * sizes[i]
            rest -= target[i]
            open_.remove(i)
    return target


def test_targets_equal_repeated_sharing(spark):
    names = ["a", "b", "c", "d", "e", "Z", None]
    sizes = [5, 900, 100, 3, 400, 1, 700]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = {r.source: r.target for r in source_mix.source_targets(df).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    want = water_fill([sizes[names.index(n)] for n in order], [(5, 2, 1)[i % 3] for i in range(7)])
    assert [got[n] for n in order] == pytest.approx(want)


def test_mix_comes_near_targets_and_agrees(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{i % 3 if i % 2 else 0}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(docs).collect()
    again = source_mix.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for source in ("s0", "s1", "s2"):
        part = [r for r in got if rows[r.doc_id][2] == source]
        assert abs(sum(r.taken for r in part) - part[0].target) < 0.02 * part[0].target
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)


def test_duels_keep_mass_and_expectation():
    rng = np.random.default_rng(3)
    p = rng.random(50)
    kept = np.zeros(50)
    for seed in range(400):
        out, left = source_mix.duel(np.arange(50), p, seed)
        assert out.sum() == pytest.approx(p.sum())
        assert sum(1 for x in out if 1e-6 < x < 1 - 1e-6) <= 1
        kept += out
    assert np.abs(kept / 400 - p).max() < 0.12


def test_residuals_meet_level_by_level(spark):
    rows = [("s", False, i, float(i % 50), 0.3) for i in range(3000)]
    df = spark.createDataFrame(rows, "_source string, _null boolean, _key long, _order double, _fraction double")
    out = source_mix.round_fractions(df, block=16)
    assert out.count() == 3000
    assert abs(out.agg({"_copy": "sum"}).first()[0] - 900) <= 1


def test_mix_on_edge_rows(edges, nothing):
    rows = source_mix.mix(edges).collect()
    assert len(rows) == edges.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    mixed = source_mix.mixed_documents(edges)
    assert mixed.schema == edges.schema
    assert source_mix.mix(nothing).count() == source_mix.mixed_documents(nothing).count() == 0


def test_slices_hold_every_text_once():
    texts = [b"x" * n for n in (0, 10, 3_000_000, 5, 0)] + [None]
    found = list(slices(texts, 100))
    assert [i for a, b in found for i in range(a, b)] == list(range(6))
    assert all(b - a == 1 or sum(len(t or b"") for t in texts[a:b]) <= 100 for a, b in found)

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import common, media


def expected(rows):
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        m = b"P5\n24 %d\n255\n" % (len(p) // 24) + p
        out.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(p)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, media.columns(df).collect()), key=repr)


def test_awkward_rows(awkward, nothing):
    assert got(awkward) == expected([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert media.columns(nothing).count() == 0


def test_shared_chunks_are_stored_once(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = word(3000)
    rows = [(k, f"{word(200)} {shared} {word(200)}") for k in range(20)] + [(k + 100, shared) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored = media.store(df)
    whole = sum(len(t.encode()) for _, t in rows)
    assert stored.agg(F.sum(F.octet_length("bytes"))).first()[0] < 0.4 * whole
    assert got(df) == expected(rows)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "BITS", 64)
    rows = [(k, f"text {k % 7} " * (k * 20)) for k in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=30_000))
def test_chunks_rebuild_the_payload(raw):
    payload = media.padded(raw)
    parts = media.chunks(payload)
    assert b"".join(parts) == payload
    assert all(len(p) <= media.MOST for p in parts) and all(len(p) >= media.LEAST for p in parts[:-1])


def test_blocks_change_neither_cuts_nor_features(monkeypatch):
    payload = media.padded(np.random.default_rng(5).integers(0, 256, 70_000).astype(np.uint8).tobytes())
    x = np.frombuffer(payload, np.uint8).reshape(-1, 24, 24).astype(int)
    bins = "/".join(str(int(((x >> 5) == k).sum())) for k in range(8))
    want = f"images={len(x)};sum={x.sum()};distinct=256;bins={bins};steps={abs(np.diff(x, axis=2)).sum()}/{abs(np.diff(x, axis=1)).sum()}"
    whole = media.cuts(payload)
    monkeypatch.setattr(media, "BLOCK", 5000)
    assert media.cuts(payload) == whole and media.feature(payload) == want


def test_the_stored_bytes_are_the_graymap(spark):
    rows = [(k, f"text {k % 5} " * (k * 90)) for k in range(30)]
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = {}
    for r in stored:
        at = 0
        for name, size, own in zip(r["names"], r["sizes"], r["own"]):
            if own:
                held[bytes(name)] = bytes(r["bytes"][at : at + size])
                at += size
        assert at == len(r["bytes"])
    found = {r["media_id"]: bytes(r["head"]) + b"".join(held[bytes(n)] for n in r["names"]) for r in stored}
    want = {}
    for _, text in rows:
        p = media.padded(text.encode())
        want[hashlib.sha256(text.encode()).hexdigest()] = b"P5\n24 %d\n255\n" % (len(p) // 24) + p
    assert found == want


def test_a_wrong_header_is_noticed(spark):
    stored = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    with pytest.raises(Exception, match="header"):
        media.described(stored.withColumn("head", F.lit(b"P5\n24 48\n255\n"))).collect()


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()
    a, b = {media.digest(c) for c in media.chunks(raw)}, {media.digest(c) for c in media.chunks(b"inserted" + raw)}
    assert len(a & b) >= 0.8 * len(a)


def test_a_damaged_chunk_is_noticed(spark):
    stored = media.store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    with pytest.raises(Exception, match="differs"):
        media.described(stored.withColumn("bytes", F.lit(b"x" * 576))).collect()

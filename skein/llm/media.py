"""Media columns: payloads as 8-bit images, cut by content into chunks, stored once a chunk.

A payload is padded to whole images of ``SIDE`` x ``SIDE`` samples. Its stored form is a
binary portable graymap: a header, then one byte a sample. Chunks of the payload end where
a rolling gear hash (a window of 16 bytes) has its high bits zero. A chunk's digest
names it; Spark joins find the digests that occur more than once and make the
smallest payload that has such a chunk its owner. Stored rows hold the header, the ordered
chunk list and the bytes of the chunks they own, all others by reference.
Reading joins the references with their owners' bytes, puts header and chunks in order,
verifies the payload's SHA-256 and takes every figure from the bytes read.

Texts are read twice: once for their chunk lists, of which only digests are kept, and
once to be stored. A bitmap of fixed size of the payloads that share chunks is broadcast: a
payload that is certainly none of them is stored where it is read; the others (the
bitmap's few false positives among them) take the exact joins. A full bitmap only
sends more rows through the joins. Chunks that very many payloads use are joined in parts.

Defined cases: a null text is empty; an empty payload is padded to one image; equal
texts are one payload and give equal values; rows that repeat a doc_id each get a
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIDE = 24
UNIT = SIDE * SIDE
PAD = 255
#: A cut where the top 11 bits of the gear hash are zero: chunks of about 2 KB between these bounds.
MASK, LEAST, MOST = np.uint16(0xFFE0), 512, 8192
#: Payload bytes that one vectorised step looks at.
BLOCK = 1 << 20

_GEAR = np.array([int.from_bytes(hashlib.md5(bytes([i])).digest()[:2], "little") for i in range(256)], np.uint16)


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)


def _candidates(payload: bytes) -> np.ndarray:
    """Positions after which the gear hash lets a chunk end; the payload is hashed block by block."""
    found = []
    for lo in range(0, len(payload), BLOCK):
        begin = max(0, lo - 15)
        gear = _GEAR[np.frombuffer(payload, np.uint8, min(len(payload), lo + BLOCK) - begin, begin)]
        rolled = gear.copy()
        for j in range(1, min(16, len(gear))):
            rolled[j:] += gear[:-j] << np.uint16(j)
        at = np.flatnonzero((rolled & MASK) == 0) + begin
        found.append(at[at >= lo] + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks."""
    ends, begin = [], 0
    for at in _candidates(payload).tolist():
        while at - begin > MOST:
            begin += MOST
            ends.append(begin)
        if at - begin >= LEAST:
            ends.append(begin := at)
    while len(payload) - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < len(payload):
        ends.append(len(payload))
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def header(payload_bytes: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (SIDE, payload_bytes // SIDE)


def samples(media: bytes) -> bytes:
    """The samples of a stored graymap, whose header has to be the one that its size asks for."""
    end = 0
    for _ in range(3):
        end = media.index(b"\n", end) + 1
    if media[:end] != header(len(media) - end):
        raise ValueError(f"a header of {media[:end]!r} before {len(media) - end} samples")
    return media[end:]


def feature(payload: bytes) -> str:
    """Images, sum, distinct values, an eight-bin histogram, and steps along and down the rows."""
    counts, along, down = np.zeros(256, np.int64), 0, 0
    for lo in range(0, len(payload), BLOCK // UNIT * UNIT):
        x = np.frombuffer(payload, np.uint8, min(BLOCK // UNIT * UNIT, len(payload) - lo), lo)
        counts += np.bincount(x, minlength=256)
        x = x.reshape(-1, SIDE, SIDE).astype(np.int16)
        along += int(np.abs(np.diff(x, axis=2)).sum(dtype=np.int64))
        down += int(np.abs(np.diff(x, axis=1)).sum(dtype=np.int64))
    bins = counts.reshape(8, 32).sum(1)
    return f"images={len(payload) // UNIT};sum={int(counts @ np.arange(256))};distinct={np.count_nonzero(counts)};bins={'/'.join(map(str, bins))};steps={along}/{down}"


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], list(names))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("media_id"), text.alias("text"))


def _cut(text: str) -> tuple[int, bytes, list[int], list[bytes]]:
    """Unpadded bytes, payload, sizes and names of its chunks."""
    raw = text.encode()
    payload = padded(raw)
    ends = cuts(payload)
    begins = [0, *ends[:-1]]
    return len(raw), payload, [b - a for a, b in zip(begins, ends)], [digest(payload[a:b]) for a, b in zip(begins, ends)]


def listing(docs: DataFrame) -> DataFrame:
    """(doc_id, media_id, names): the chunk list of each document's payload; on shared files."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [_cut(text.as_py())[3] for text in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("media_id"), pa.array(names, pa.list_(pa.binary()))], ["doc_id", "media_id", "names"])

    return common.stored(common.map_batches(_texts(docs), step, "doc_id long, media_id string, names array<binary>", "text"), "chunk-lists")


def _uses(lists: DataFrame) -> DataFrame:
    """(media_id, foreign, lent) of the payloads that have a chunk met more than once: what each takes from others
    and what it owns for others. Only digests move."""
    every = lists.select("media_id", F.explode("names").alias("chunk"))
    shared = every.groupBy("chunk").agg(F.count("*").alias("n"), F.min("media_id").alias("owner")).where("n > 1")
    shared = common.stored(shared.select("chunk", "owner"), "shared-chunks")
    uses = common.salted_join(common.stored(every.distinct(), "chunk-uses"), shared, "chunk", ["media_id"])
    mine = F.col("owner") == F.col("media_id")
    return common.stored(uses.groupBy("media_id").agg(F.collect_set(F.when(~mine, F.col("chunk"))).alias("foreign"), F.collect_set(F.when(mine, F.col("chunk"))).alias("lent")), "uses")


_ROW = "media_id string, n_bytes long, head binary, names array<binary>, sizes array<int>, own array<boolean>, lent array<boolean>, bytes binary"


def store(docs: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """The stored media: one row a distinct payload with its header, chunk list and the bytes that it owns; on shared files."""
    uses = _uses(listing(docs) if lists is None else lists)
    words = common.stored(common.bit_words(uses.select(F.xxhash64("media_id").alias("key")), "key"), "sharing")
    marked = common.maybe_in(_texts(docs).drop("doc_id").withColumn("key", F.xxhash64("media_id")), "key", words, "sharing").drop("key")

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text in zip(batch.column("media_id").to_pylist(), batch.column("text")):
            n, payload, sizes, names = _cut(text.as_py())
            rows.append((i, n, header(len(payload)), names, sizes, [True] * len(names), [False] * len(names), payload))
        return _batch(rows, _ROW)

    def stripped(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text, foreign, lent in zip(batch.column("media_id").to_pylist(), batch.column("text"), batch.column("foreign").to_pylist(), batch.column("lent").to_pylist()):
            n, payload, sizes, names = _cut(text.as_py())
            others, given, seen, own, parts, at = set(foreign or ()), set(lent or ()), set(), [], [], 0
            for name, size in zip(names, sizes):
                own.append(name not in others and name not in seen)
                if own[-1]:
                    parts.append(payload[at : at + size])
                seen.add(name)
                at += size
            rows.append((i, n, header(len(payload)), names, sizes, own, [o and x in given for x, o in zip(names, own)], b"".join(parts)))
        return _batch(rows, _ROW)

    # Equal payloads are combined where they are read; the texts are shuffled once, to the join's key.
    once = marked.where("sharing").groupBy("media_id").agg(F.first("text").alias("text"))
    shared_rows = common.map_batches(once.join(uses, "media_id", "left"), stripped, _ROW, "text")
    alone = common.map_batches(marked.where("not sharing").select("media_id", "text"), whole, _ROW, "text")
    return common.stored(alone.unionByName(shared_rows), "media")


def _described(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Put the header and chunks of each row in order, verify them, and describe the media read."""
    rows = []
    others = batch.column("others").to_pylist() if "others" in batch.schema.names else [None] * batch.num_rows
    columns = (batch.column(c).to_pylist() for c in ("media_id", "n_bytes", "head", "names", "sizes", "own", "bytes"))
    for i, n_bytes, head, names, sizes, own, held, more in zip(*columns, others):
        known = {c["chunk"]: c["bytes"] for c in more or ()}
        parts, at = [head], 0
        for name, size, mine in zip(names, sizes, own):
            if mine:
                known[name] = held[at : at + size]
                at += size
            part = known[name]
            if digest(part) != name:
                raise ValueError(f"a chunk of {i} differs from its digest")
            parts.append(part)
        media = b"".join(parts)
        payload = samples(media)
        if hashlib.sha256(payload[:n_bytes]).hexdigest() != i:
            raise ValueError(f"payload {i} differs from what was stored")
        rows.append((i, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
    return _batch(rows, _DESCRIBED)


_DESCRIBED = "media_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(stored: DataFrame) -> DataFrame:
    """What the media read back from ``stored`` are, one row a distinct payload."""
    # A row refers to other rows where a chunk is neither its own nor given earlier in its list.
    own_names = "transform(filter(arrays_zip(names, own), x -> x.own), x -> x.names)"
    rows = stored.withColumn("wanted", F.expr(f"array_except(array_distinct(names), {own_names})"))
    whole = common.map_batches(rows.where("size(wanted) = 0").drop("wanted"), _described, _DESCRIBED, "bytes")
    wanted = common.stored(rows.where("size(wanted) > 0").select("media_id", F.explode("wanted").alias("chunk")), "wanted")

    def given(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, parts = [], []
        for every, sizes, own, lent, held in zip(*(batch.column(c).to_pylist() for c in ("names", "sizes", "own", "lent", "bytes"))):
            at = 0
            for name, size, mine, wanted in zip(every, sizes, own, lent):
                if wanted:
                    names.append(name)
                    parts.append(held[at : at + size])
                at += size if mine else 0
        return _batch(list(zip(names, parts)), "chunk binary, bytes binary")

    owners = stored.where("exists(lent, x -> x)").select("names", "sizes", "own", "lent", "bytes")
    found = common.map_batches(owners, given, "chunk binary, bytes binary", "bytes")
    others = common.salted_join(wanted, found, "chunk", ["media_id"]).groupBy("media_id").agg(F.collect_list(F.struct("chunk", "bytes")).alias("others"))
    joined = common.map_batches(rows.where("size(wanted) > 0").drop("wanted").join(others, "media_id"), _described, _DESCRIBED, "bytes")
    return whole.unionByName(joined)


def columns(docs: DataFrame) -> DataFrame:
    """doc_id and what its stored media are, for each row of ``docs``."""
    lists = listing(docs)
    known = common.stored(described(store(docs, lists)), "described")
    return common.salted_join(lists.select("doc_id", "media_id"), known, "media_id", ["doc_id"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

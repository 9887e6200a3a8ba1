"""WARC archives: writing records, and reading them back by boundary-chain verification.

*Writing.* Each page is one record, a response with its HTTP head and the html, or a
revisit that names the response with the same payload. Spark's text writer puts the
records in files on shared storage; its line separator is the record terminator, so
the files are plain archives. A file holds at most ``RECORDS`` records and about ``FILE_BYTES`` bytes, so that one
task can read it whole: pages so long that ``RECORDS`` of them could pass that go to files of their own, with as
many records as the longest allows.

*Reading.* Tasks look for the magic in each file and emit every candidate (offset,
offset of its successor by its own Content-Length), the false ones within payloads
too. The chain that begins at the file's start is then followed by pointer jumping:
in round k all records reached so far name those 2^k records ahead, and all
pointers double; after about log2(records a file) rounds the reached offsets are
the records, and candidates inside payloads are left behind.

Defined cases: null html is an empty payload; a null url gives the URI
``urn:page:<id>``; a null page_id is written as ``null`` and read back as null; blanks and
controls in urls are percent-coded; equal payloads with the same smallest page_id (repeated
rows) are all responses; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RECORDS = 2000
FILE_BYTES = 256 << 20
#: Room for a record's heads.
HEAD_BYTES = 1024
#: Names of the archives that the writer leaves.
PATTERN = "part-*"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
#: Fixed in every record, so that runs agree.
DATE = "2024-01-01T00:00:00Z"


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.stored(first, "payloads")
    hot = first.where(F.col("n") > common.HOT_ROWS).orderBy(F.desc("n"), "digest").limit(common.HOT_KEYS).select("digest", "n").collect()
    joined = common.salted_join(rows, first.drop("n"), "digest", ["page_id", "url"], "left", found=hot)
    return joined.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first", "digest")


def write(pages: DataFrame, path: str | None = None, records: int = RECORDS, least: int = 0) -> str:
    """Write a record for each page; gives the folder of the archives."""
    spark = pages.sparkSession
    path = path or common.shared_path(spark, "warc")

    @F.pandas_udf("string")
    def record(page_id, url, html, refers_to):
        import pandas as pd

        out = []
        for i, u, h, to in zip(page_id, url, html, refers_to):
            i, to = (None if pd.isna(x) else int(x) for x in (i, to))
            payload = h.encode()
            name = "null" if i is None else str(i)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u) if u else f"urn:page:{name}"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            block = http + (h if to is None else "")
            head = ["WARC/1.1", f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Payload-Digest: sha1:{digest}"]
            if to is not None:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{to}>"]
            head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
            out.append("\r\n".join(head) + "\r\n\r\n" + block)
        return pd.Series(out, dtype=object)

    # Longs with nulls would pass through pandas as floats; as text they stay exact.
    plan = planned(pages, least)
    # The two parts share no row: the filter reaches the pages before the join.
    size = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) * 3 + HEAD_BYTES
    limit = FILE_BYTES // records
    longest = pages.select(F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("url")).agg(F.max(F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) * 3 + HEAD_BYTES)).first()[0] or 0
    for few, part in ((records, plan.where(size <= limit)), (FILE_BYTES // max(1, longest), plan.where(size > limit))):
        if few == records or longest > limit:
            lines = part.select(record(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")).alias("value"))
            lines.write.mode("append").option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, few)).text(path)
    return path


def _headers(raw: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw.split(b"\r\n")[1:])}


def _page(value: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(found[1]) if found else None


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file and content of the archives, and their length."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "length")


def candidates(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Every place that looks like a record, with its successor's offset and what the record says; on shared files."""
    schema = "file string, at long, next long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"
    files = listed(spark, path, pattern).select("file", "content")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            data = content.as_buffer().to_pybytes() if content.is_valid else b""
            for m in MAGIC.finditer(data):
                at = m.start()
                end = data.find(END, at)
                if end < 0:
                    continue
                head = _headers(data[at:end])
                length = head.get(b"content-length", b"")
                if not length.isdigit():
                    continue
                begin, stop = end + 4, end + 4 + int(length)
                if data[stop : stop + 4] != END:
                    continue
                http, _, payload = data[begin:stop].partition(END)
                said = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                kind = head.get(b"warc-type", b"").decode("ascii", "replace")
                size = _headers(http).get(b"content-length", b"")
                size = int(size) if size.isdigit() else None
                digest, intact = said, True
                if kind == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    intact = digest == said and len(payload) == size
                    size = len(payload)
                rows.append((name, at, stop + 4, _page(head.get(b"warc-record-id")), kind, _page(head.get(b"warc-refers-to")), size, digest, intact))
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "at", "next", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"])

    return common.stored(common.map_batches(files, step, schema), "candidates")


def reachable(found: DataFrame) -> DataFrame:
    """Those candidates that the chain from their file's start reaches."""
    # Both sides grow with the archives and pack far smaller than they are: their file sizes must not lead to broadcasts.
    jump = found.select("file", "at", "next")
    reached = found.where("at = 0").select("file", "at")
    spark, count, rounds = found.sparkSession, 0, 0
    while True:
        ahead = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
        before, reached = reached, common.stored(reached.unionByName(ahead).distinct(), "reached")
        if rounds:
            common.forget(spark, before)
        if (now := reached.count()) == count:
            break
        count = now
        over = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        before, jump = jump, common.stored(jump.join(over.hint("merge"), ["file", "next"]).select("file", "at", F.col("further").alias("next")), "jumps")
        if rounds:
            common.forget(spark, before)
        rounds += 1
    return found.join(reached.hint("merge"), ["file", "at"], "left_semi")


def read(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and intact for each record of the archives.

    An archive whose chain ends before its last byte is an error that names it, and so is a folder in which no
    file has a name of ``pattern``.
    """
    sizes = listed(spark, path, pattern).select("file", "length")
    if sizes.isEmpty() and not listed(spark, path, "*").select("file").isEmpty():
        raise ValueError(f"{path} has no archives named {pattern}")
    records = common.stored(reachable(candidates(spark, path, pattern)), "records")
    ends = sizes.join(records.groupBy("file").agg(F.max("next").alias("end")), "file", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    if short := ends.where("end < length").orderBy("file").take(5):
        raise ValueError("records cannot be followed to the end: " + ", ".join(f"{r['file']} at byte {r['end']} of {r['length']}" for r in short))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")

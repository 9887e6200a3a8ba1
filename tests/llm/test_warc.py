import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from skein.llm import common, warc

PAGES = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(rows):
    first = {}
    for i, _, h in rows:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        revisit = i is not None and i > first[h or ""]
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None, True))
    return sorted(out, key=repr)


def got(spark, path):
    return sorted(map(tuple, warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=repr)


def test_awkward_pages(spark):
    rows = [(1, "http://a/b c", "x"), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", FAKE), (5, "u", FAKE + FAKE), (6, "u", "x"), (6, "u", "x"), (None, "u", "none"), (7, "u", "\r\n\r\n"), (8, "u", "é🙂" * 60_000), (9, "u", "WARC/1.1\r\n")]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash"))
    assert got(spark, warc.write(df, records=4)) == expected(rows)


def test_candidates_inside_payloads_are_seen_and_rejected(spark):
    rows = [(k, "u", FAKE * (k % 3)) for k in range(60)]
    path = warc.write(spark.createDataFrame(rows, PAGES).repartition(1), records=100)
    found = warc.candidates(spark, path)
    assert found.count() > 60
    assert warc.reachable(found).count() == 60
    assert got(spark, path) == expected(rows)


def test_long_pages_get_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 64_000)
    rows = [(k, "u", f"short {k}") for k in range(50)] + [(100 + k, "u", f"{k}" * 5000) for k in range(9)] + [(200, "u", "long" * 50_000)]
    path = warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), records=50)
    assert got(spark, path) == expected(rows)
    sizes = sorted(r["length"] for r in warc.listed(spark, path, "part-*").select("length").collect())
    assert sizes[-1] < 210_000 and len([n for n in sizes if n > 30_000]) == 1 or sizes[-2] <= 64_000


def test_a_very_common_payload_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(k, "u", "" if k % 3 else f"page {k % 40}") for k in range(300)] + [(7, None, None)]
    assert got(spark, warc.write(spark.createDataFrame(rows, PAGES))) == expected(rows)


def test_clashing_columns(spark, awkward):
    rows = [(1, "u", "x"), (2, "u", "x"), (None, None, None), (3, "u", "")]
    df = spark.createDataFrame(rows, PAGES)
    df = df.withColumns({c: F.lit("clash") for c in [*awkward.columns, "digest", "first", "refers_to", "payload_bytes", "payload_digest"] if c not in df.columns})
    assert got(spark, warc.write(df)) == expected(rows)


def test_no_pages(spark):
    assert warc.read(spark, warc.write(spark.createDataFrame([], PAGES))).count() == 0


def test_archives_of_other_names(spark, tmp_path):
    (tmp_path / "a.warc").write_text(FAKE + FAKE, newline="")
    assert [r["page_id"] for r in warc.read(spark, str(tmp_path), "*.warc").collect()] == [99, 99]
    with pytest.raises(ValueError, match="no archives"):
        warc.read(spark, str(tmp_path))


def test_a_damaged_record_is_reported(spark, tmp_path):
    (tmp_path / "part-0").write_text(FAKE + FAKE.replace("Length: 3", "Length: 4") + FAKE, newline="")
    (tmp_path / "part-1").write_text(FAKE, newline="")
    with pytest.raises(ValueError, match=f"part-0 at byte {len(FAKE)} of {3 * len(FAKE) }"):
        warc.read(spark, str(tmp_path))

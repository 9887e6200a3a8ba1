"""Overlays, scan spans, PC-relative pairs, coalescing and prefix joins against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import binaries, intervals, overlay, prefixes


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def plain_overlay(spans):
    """By address, one after the other."""
    best = {}
    for key, start, end, source in spans:
        for at in range(start, end):
            best[key, at] = min(source, best.get((key, at), source))
    return best


@pytest.mark.parametrize("parts", [1, 7])
def test_overlay_of_random_spans(spark, parts):
    rng = random.Random(parts)
    spans = []
    for _ in range(250):
        start = rng.randrange(400)
        spans.append((rng.choice("ab"), start, start + rng.randrange(0, 25), rng.randrange(3)))
    spans += [("c", 0, 10**12, 2), ("c", 5, 6, 0), ("a", 10, 5, 0)]
    df = spark.createDataFrame(spans, "key string, start long, end long, source int")
    found = rows(overlay.overlay(df, ["key"], 3, parts=parts), "key", "start", "end", "source")
    assert [f for f in found if f[0] == "c"] == [("c", 0, 5, 2), ("c", 5, 6, 0), ("c", 6, 10**12, 2)]
    got = {}
    for key, start, end, source in found:
        for at in range(start, end) if key != "c" else ():
            assert (key, at) not in got
            got[key, at] = source
    assert got == plain_overlay([s for s in spans if s[0] != "c"])


def test_one_long_image_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spans = spark.range(20_000).select(F.lit("one").alias("key"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 5).alias("end"), F.lit(0).alias("source")).unionByName(spark.createDataFrame([("one", 1 << 50, (1 << 50) + 1, 0)], "key string, start long, end long, source int"))
        pieces = overlay.overlay(spans, ["key"], 1, parts=16).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in pieces.groupBy("task").count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 0.5 * sum(sizes)
        islands = intervals.coalesced(spans, ["key"], parts=16)
        assert rows(islands, "start", "end", "n") == [(0, 60_002, 20_000), (1 << 50, (1 << 50) + 1, 1)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_mapped_pieces_keep_all_frames_of_the_winner(spark):
    spans = spark.createDataFrame([("a", 0, 100, 1, "outer"), ("a", 20, 40, 1, "inlined"), ("a", 30, 35, 0, "explicit"), ("a", 90, 120, 2, "symbol")], "key string, start long, end long, source int, what string")
    assert rows(overlay.mapped(spans, ["key"], 3), "start", "end", "source", "what") == [(0, 20, 1, "outer"), (20, 30, 1, "inlined"), (20, 30, 1, "outer"), (30, 35, 0, "explicit"), (35, 40, 1, "inlined"), (35, 40, 1, "outer"), (40, 90, 1, "outer"), (90, 100, 1, "outer"), (100, 120, 2, "symbol")]


SPAN = "artifact string, start long, end long, mode string"


def test_scan_spans(spark):
    selected = spark.createDataFrame([("a", 0, 100, None), ("a", 100, 150, "thumb"), ("b", 0, 10, None), ("b", 10, 10, None)], SPAN)
    marks = spark.createDataFrame([("a", 20, "thumb"), ("a", 40, "data"), ("a", 60, "arm"), ("a", 0, "arm"), ("a", 120, "data"), ("b", 500, "data"), ("c", 1, "data")], "artifact string, at long, mode string")
    assert rows(overlay.scan_spans(selected, marks, "none"), "artifact", "start", "end", "mode") == [("a", 0, 20, "arm"), ("a", 20, 40, "thumb"), ("a", 60, 100, "arm"), ("a", 100, 120, "thumb"), ("a", 120, 150, "thumb"), ("b", 0, 10, "none")]
    # A mark before the span does not reach into it.
    later = spark.createDataFrame([("a", 50, 60, None)], SPAN)
    assert rows(overlay.scan_spans(later, marks, "none"), "start", "end", "mode") == [(50, 60, "none")]


def test_selections_that_overlap_are_an_error(spark):
    marks = spark.createDataFrame([], "artifact string, at long, mode string")
    with pytest.raises(ValueError, match="overlap at 9"):
        overlay.scan_spans(spark.createDataFrame([("a", 0, 10, None), ("a", 9, 20, None)], SPAN), marks)


def test_ranges_on_one_axis(spark):
    ranges = spark.createDataFrame([("a", "va", 5000, 5010, None), ("a", "rva", 16, 32, "arm"), ("a", "file", 100, 300, None), ("z", "va", 0, 1, None)], "artifact string, kind string, start long, end long, mode string")
    artifacts = spark.createDataFrame([("a", 4096)], "id string, image_base long")
    segments = spark.createDataFrame([("a", 8192, 8342, 50), ("a", 9000, 9050, 200)], "artifact string, start long, end long, file_offset long")
    assert rows(overlay.on_one_axis(ranges, artifacts, segments), "artifact", "start", "end") == [("a", 4112, 4128), ("a", 5000, 5010), ("a", 8242, 8342), ("a", 9000, 9050)]


def word(value, order):
    return value.to_bytes(4, order).hex()


def test_pc_relative_pairs(spark):
    signed = lambda v, n: v & ((1 << n) - 1)
    data = []

    def pair(artifact, architecture, order, at, first, second, how="indirect", gap=4, size=4):
        data.append((artifact, architecture, order, at, size, word(first, order), "none", None))
        data.append((artifact, architecture, order, at + gap, 4, word(second, order), how, None))

    auipc = lambda imm, rd=1: signed(imm, 20) << 12 | rd << 7 | 0x17
    jalr = lambda imm, rs=1, rd=1: signed(imm, 12) << 20 | rs << 15 | rd << 7 | 0x67
    pcadd = lambda imm, rd=1: 0x1E000000 | signed(imm, 20) << 5 | rd
    jirl = lambda imm, rj=1, rd=1: 0x4C000000 | signed(imm, 16) << 10 | rj << 5 | rd
    pair("r", "riscv64", "little", 1000, auipc(3), jalr(-7))
    pair("r", "riscv64", "little", 2000_000, auipc(-2), jalr(5))
    pair("r", "riscv32", "big", 3000_000, auipc(1), jalr(8))
    pair("r", "riscv64", "little", 4000_000, auipc(1, 2), jalr(8, 3))  # other registers
    pair("r", "riscv64", "little", 4100_000, auipc(1, 0), jalr(8, 0))  # no register
    pair("r", "riscv64", "little", 4200_000, auipc(1), jalr(8), how="direct")
    pair("r", "riscv64", "little", 4300_000, auipc(1), jalr(8), gap=8)
    pair("r", "riscv64", "little", 4400_000, auipc(1), jalr(8), size=2)
    pair("l", "loongarch64", "little", 1 << 32, pcadd(-3), jirl(-9))
    pair("l", "loongarch64", "little", 5 << 32, pcadd(2), jirl(4))
    pair("l", "loongarch64", "little", 6 << 32, pcadd(2), jirl(4, 1, 0))  # no link
    pair("x", "x86_64", "little", 1000, auipc(3), jalr(-7))
    df = spark.createDataFrame(data, "artifact string, architecture string, byte_order string, address long, size int, bytes string, how string, target long")
    for parts in (1, 5, 24):
        out = binaries.pc_relative(df, parts)
        assert out.columns == df.columns and out.count() == len(data)
        assert rows(out.where("how = 'pc_relative'"), "artifact", "address", "target") == [
            ("l", (1 << 32) + 4, (1 << 32) - (3 << 18) - 36), ("l", (5 << 32) + 4, (5 << 32) + (2 << 18) + 16),
            ("r", 1004, (1000 + 3 * 4096 - 7) & ~1), ("r", 2000_004, (2000_000 - 2 * 4096 + 5) & ~1), ("r", 3000_004, 3000_000 + 4096 + 8),
        ]


def test_decoded_pairs_become_calls(spark):
    df = spark.createDataFrame([("r", "riscv64", "little", 16, 4, word(1 << 12 | 1 << 7 | 0x17, "little"), "none", None), ("r", "riscv64", "little", 20, 4, word(1 << 15 | 1 << 7 | 0x67, "little"), "indirect", None)], "artifact string, architecture string, byte_order string, address long, size int, bytes string, how string, target long")
    functions = spark.createDataFrame([("r", "f", 0, 64), ("r", "g", 4096, 5000)], "artifact string, node_id string, start long, end long")
    assert rows(binaries.calls_by_owner(binaries.pc_relative(df).where("how <> 'none'"), functions), "address", "src", "dst", "confidence") == [(20, "f", "g", "inferred")]


def test_gaps_between_functions(spark):
    functions = spark.createDataFrame([("a", 10, 20), ("a", 15, 30), ("a", 50, 60), ("a", 95, 120), ("b", 0, 5)], "artifact string, start long, end long")
    spans = spark.createDataFrame([("a", 0, 100), ("a", 200, 210)], "artifact string, s_start long, s_end long")
    assert rows(binaries.gaps(functions, spans), "artifact", "start", "end") == [("a", 0, 10), ("a", 30, 50), ("a", 60, 95), ("a", 200, 210)]


def test_longest_prefixes(spark):
    table = spark.createDataFrame([("/a", "1"), ("/a/b", "2"), ("/a/b", "2"), ("/x", "3"), ("/x", "4"), ("", "root")], "prefix string, value string")
    paths = spark.createDataFrame([(p,) for p in ("/a", "/a/c", "/a/b", "/a/b/c/d", "/ab", "/x/y", "a", None)], "path string")
    assert rows(prefixes.longest(paths, table), "path", "prefix", "value") == [("/a", "/a", "1"), ("/a/b", "/a/b", "2"), ("/a/b/c/d", "/a/b", "2"), ("/a/c", "/a", "1"), ("/ab", "", "root")]


def test_remapped_paths_and_source_lines(spark):
    moves = spark.createDataFrame([("C:\\build\\", "/src"), ("C:/build/gen", "/gen/"), ("/w", "/src")], "old string, new string")
    paths = ["C:\\build\\a.c", "C:/build/gen/b.c", "C:/builds/a.c", "/w/a.c", "/w", "other.c"]
    assert dict(rows(prefixes.remapped(spark.createDataFrame([(p,) for p in paths], "path string"), moves), "path", "to")) == {"C:\\build\\a.c": "/src/a.c", "C:/build/gen/b.c": "/gen/b.c", "C:/builds/a.c": "C:/builds/a.c", "/w/a.c": "/src/a.c", "/w": "/src", "other.c": "other.c"}
    nodes = spark.createDataFrame([("f", "/src/a.c", 1, 20), ("g", "/src/a.c", 5, 9), ("h1", "/src/a.c", 12, 14), ("h2", "/src/a.c", 12, 14), ("k", "other.c", 1, 2)], "id string, file_path string, start_line int, end_line int").withColumns({"origin": F.lit("source"), "kind": F.lit("function")})
    lines = spark.createDataFrame([("/w/a.c", 7), ("/w/a.c", 10), ("/w/a.c", 13), ("C:\\build\\a.c", 5), ("other.c", 2), ("other.c", 3), ("??", 1), ("/w/a.c", 0)], "path string, line int")
    assert rows(prefixes.source_lines(lines, nodes, moves), "path", "line", "node_id") == [("/w/a.c", 7, "g"), ("/w/a.c", 10, "f"), ("C:\\build\\a.c", 5, "g"), ("other.c", 2, "k")]
    roots = spark.createDataFrame([("/src",), ("/",), ("/src/deep/",)], "root string")
    files = spark.createDataFrame([("1", "/src/a.c"), ("2", "/src/deep/b.c"), ("3", "/srcs/c.c"), ("4", "rel.c")], "id string, file_path string")
    assert rows(prefixes.owning_roots(files, roots), "id", "root") == [("1", "/src"), ("2", "/src/deep/")]


def test_ranges_hold_as_many_rows_on_any_table(spark, monkeypatch):
    from skein.functions import storage

    monkeypatch.setattr(storage, "ROWS", 50)
    rng = random.Random(4)
    spans = [(k % 3, s, s + rng.randrange(1, 9)) for k in range(1200) for s in [rng.randrange(4000)]]
    df = spark.createDataFrame(spans, "key int, start int, end int")
    sizes = storage.ranged(df, ["key", "start"]).groupBy("block").count().collect()
    assert len(sizes) >= 20 and max(r["count"] for r in sizes) < 200
    want, last = [], None
    for key, a, b in sorted(spans):
        if last and last[0] == key and a <= last[2]:
            last[2], last[3] = max(last[2], b), last[3] + 1
        else:
            last = [key, a, b, 1]
            want.append(last)
    assert sorted(map(list, intervals.coalesced(df, ["key"]).collect())) == want


def test_spans_to_scan_are_not_looked_for_again(spark, monkeypatch):
    from skein.functions import storage

    monkeypatch.setattr(storage, "ROWS", 40)
    monkeypatch.setattr(intervals, "stab", None)
    rng = random.Random(5)
    spans = [(f"a{k % 2}", s, s + rng.randrange(1, 30), rng.choice([None, None, "own"])) for k in range(160) for s in [k * 25 + rng.randrange(3)] if k % 7]
    spans = [x for x in spans if x[0] == "a0" or x[1] % 2]
    marks = [(f"a{rng.randrange(2)}", rng.randrange(4200), rng.choice(["arm", "thumb", "data"])) for _ in range(300)]
    want = set()
    for a, s, e, own in spans:
        at = {}
        for x, p, mode in marks:
            if x == a and s <= p < e:
                at[p] = max(mode, at.get(p, ""))
        points, mode = sorted({s, *at}), "none"
        for p, q in zip(points, [*points[1:], e]):
            mode = at.get(p, mode)
            if (own or mode) != "data":
                want.add((a, p, q, own or mode))
    got = overlay.scan_spans(spark.createDataFrame(spans, "artifact string, start long, end long, mode string"), spark.createDataFrame(marks, "artifact string, at long, mode string"), "none")
    assert rows(got, "artifact", "start", "end", "mode") == sorted(want)


def test_pairs_of_instructions_across_small_ranges(spark, monkeypatch):
    from skein.functions import storage

    monkeypatch.setattr(storage, "ROWS", 5)
    words = [("a", "riscv64", "big", 4 * k, 4, f"{0x297 if k % 2 == 0 else 0x000280E7:08X}", "none" if k % 2 == 0 else "indirect", None) for k in range(64)]
    df = spark.createDataFrame(words, "artifact string, architecture string, byte_order string, address long, size int, bytes string, how string, target long")
    got = binaries.pc_relative(df)
    assert {(r["address"], r["target"]) for r in got.where("how = 'pc_relative'").collect()} == {(4 * k, 4 * k - 4) for k in range(1, 64, 2)}
    assert storage.ranged(df, ["artifact", "address"]).select("block").distinct().count() >= 8

"""The engine's methods over tables of references, exports and instructions."""

from skein.engine import QueryEngine
from skein.sources import ingest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_names_modules_and_exports(spark):
    engine = QueryEngine(ingest.parse_text(spark, {"a.py": ("python", "class A:\n    def f(self):\n        pass\ndef f():\n    pass\n"), "b.py": ("python", "def g():\n    pass\n")}))
    names = spark.createDataFrame([(1, "a:A", "f"), (2, "a", "f"), (3, "a:A", "g")], "ref_id int, scope string, name string")
    assert rows(engine.look_up(names), "ref_id", "node_id") == [(1, "a:A.f"), (2, "a:f")]
    assert rows(engine.visible_modules("a"), "module") == [("a",)]
    requests = spark.createDataFrame([("x", "h"), ("y", "g"), ("y", "none")], "module string, name string")
    aliases = spark.createDataFrame([("x", "h", "a", "f")], "module string, name string, to_module string, to_name string")
    stars = spark.createDataFrame([("y", "b"), ("y", "x")], "module string, to_module string")
    assert rows(engine.exported(requests, aliases, stars), "module", "name", "node_id") == [("x", "h", "a:f"), ("y", "g", "b:g"), ("y", "none", None)]
    assert rows(engine.source_at_lines(spark.createDataFrame([("/w/a.py", 3), ("a.py", 5)], "path string, line int"), spark.createDataFrame([("/w/a.py", "a.py")], "old string, new string")), "path", "node_id") == [("/w/a.py", "a:A.f"), ("a.py", "a:f")]


def test_instructions_become_calls(spark):
    import json

    engine = QueryEngine(ingest.parse_text(spark, {"m.c": ("c", "int f(void) { return 1; }\n")}))
    engine.augment_binary(json.dumps({"artifact": {"key": "fw", "hash": "ab"}, "functions": [{"id": str(k), "symbol": s, "address": a, "size": 16} for k, (s, a) in enumerate((("one", 0), ("two", 64), ("three", 100)))]}))
    kind = "artifact string, architecture string, byte_order string, address long, size int, bytes string, how string, target long"
    word = lambda v: v.to_bytes(4, "little").hex()
    artifact = engine.binary_artifacts().first()["id"]
    told = [(0, "none", word(0x97), None), (4, "indirect", word(66 << 20 | 1 << 15 | 0xE7), None), (8, "direct", "00000000", 100), (12, "jump", "00000000", 64), (64, "direct", "00000000", 5000), (68, "jump", "00000000", 70)]
    df = spark.createDataFrame([(artifact, "riscv64", "little", at, 4, code, how, target) for at, how, code, target in told], kind)
    for _ in range(2):
        engine.add_instructions(df)
        name = {r["id"]: r["name"] for r in engine.graph.nodes.collect()}
        made = [r for r in engine.graph.edges.where("attrs like '%callsite%'").collect() if "address" in r["attrs"] or "callsite" in r["attrs"]]
        got = sorted((name[r["src"]], name.get(r["dst"], r["dst"]), r["confidence"]) for r in made)
        assert got == [("one", "three", "certain"), ("one", "two", "inferred"), ("one", "two", "inferred"), ("two", f"address:{artifact}:5000", "uncertain")]
    spans = spark.createDataFrame([(artifact, 0, 120)], "artifact string, s_start long, s_end long")
    assert rows(engine.binary_gaps(spans), "start", "end") == [(16, 64), (80, 100), (116, 120)]


def test_merging_graphs_of_languages(spark):
    import pytest

    one = ingest.parse_text(spark, {"a.py": ("python", "def f():\n    gone()\n")})
    two = ingest.parse_text(spark, {"a.go": ("go", "package p\nfunc f() { gone() }\n")})
    with pytest.raises(ValueError, match="node id a"):
        one.merge(two, apart=True)
    other = ingest.parse_text(spark, {"b.go": ("go", "package p\nfunc g() { }\n")})
    merged = one.merge(other, apart=True)
    assert {"a:f", "b:g"} <= {r["id"] for r in merged.nodes.collect()}


def test_coverage_of_a_diff(spark, tmp_path):
    for k, files in enumerate((["a.py"], ["a.py", "b.py", "c.go"])):
        (tmp_path / str(k)).mkdir()
        for f in files:
            (tmp_path / str(k) / f).write_text("package p\n" if f.endswith("go") else "x = 1\n")
    before, after = (QueryEngine.from_directory(spark, str(tmp_path / str(k)), detect=False) for k in (0, 1))
    assert rows(after.diff_against(before)["source_coverage"], "language", "before", "after") == [("go", 0, 1), ("python", 1, 2)]

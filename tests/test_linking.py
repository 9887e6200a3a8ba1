"""Passes over whole graphs: what binds across files, and what must not."""

from pyspark.sql import functions as F

from skein.operators import diffing, linking
from skein.sources import ingest


def edges(graph, kind):
    return {(r["src"], r["dst"], r["confidence"]) for r in graph.edges.where(F.col("kind") == kind).collect()}


def test_names_bind_within_a_family_of_languages(spark):
    graph = ingest.parse_text(spark, {
        "a.py": ("python", "def shared():\n    pass\nclass Base:\n    pass\n"),
        "b.go": ("go", "package p\nfunc f() { shared(); alone() }\n"),
        "c.go": ("go", "package p\nfunc alone() {}\n"),
        "d.java": ("java", "class D extends Base { void f(Svc s) { s.run(); shared(); } }\n"),
        "e.kt": ("kotlin", "class Svc { fun run() { } }\nclass Base { }\n"),
        "f.ts": ("typescript", "import { go } from './lib/g';\nexport function f() { go(); twice(); }\n"),
        "lib/g.ts": ("typescript", "export function go() { }\nexport function twice() { }\n"),
        "h.js": ("javascript", "function twice() { }\n"),
    })
    calls = edges(graph, "calls")
    assert ("b:f", "c:alone", "inferred") in calls
    assert ("b:f", "proxy.unresolved:b:shared", "certain") in calls
    assert ("d:D.f", "e:Svc.run", "inferred") in calls
    assert ("f:f", "lib.g:go", "inferred") in calls
    assert [c for s, d, c in calls if s == "f:f" and "twice" in d] == ["uncertain"]
    assert edges(graph, "inherits") == {("d:D", "e:Base", "inferred")}


def test_an_empty_symbol_is_unknown(spark):
    rows = linking.proxy_ids(spark.createDataFrame([("",), (" ",), ("x",)], "symbol string")).collect()
    assert {r["id"].split("__")[0] for r in rows} == {"proxy.unresolved:unknown", "proxy.unresolved:x"} and len({r["id"] for r in rows}) == 3


def test_headers_are_owned_without_sources(spark):
    from skein.sources import languages

    owned = lambda names, wanted=None: {r["path"]: r["language"] for r in languages.owned(spark.createDataFrame([(n,) for n in names], "path string"), wanted).collect()}
    assert owned(["a.h"]) == {"a.h": "c"}
    assert owned(["a.h"], ["c"]) == {"a.h": "c"} and owned(["a.h"], ["objc"]) == {"a.h": "objc"}
    assert owned(["a.h", "b.cpp", "c.c"]) == {"a.h": "cpp", "b.cpp": "cpp", "c.c": "c"}
    assert owned(["a.h"], ["python"]) == {}


def test_the_outermost_ring_has_no_edges_of_its_own(spark):
    from skein.engine import QueryEngine

    graph = ingest.parse_text(spark, {"m.py": ("python", "def a():\n    b(); c()\ndef b():\n    c(); d()\ndef c():\n    pass\ndef d():\n    pass\n")})
    chart = QueryEngine(graph).diagram("call-graph", focus="m:a", depth=1)
    assert "m_a --> m_b" in chart and "m_a --> m_c" in chart and "m_b --> m_c" not in chart


def test_callables_given_as_values(spark):
    graph = ingest.parse_text(spark, {
        "a.py": ("python", "def cb():\n    pass\ndef reg(f):\n    f()\ndef main(cb2):\n    reg(cb)\n    reg(f=cb)\n    reg(cb2)\ndef own():\n    cb = 1\n    reg(cb)\n"),
        "b.js": ("javascript", "function cb() { }\nfunction main(x) { on('e', cb); on(x, other); }\n"),
    })
    assert {(s, d) for s, d, _ in edges(graph, "references")} == {("a:main", "a:cb"), ("b:main", "b:cb")}


def test_scripts_need_one_unit(spark):
    from skein.operators import entrypoints

    graph = ingest.parse_text(spark, {"pkg/m.py": ("python", "def go():\n    pass\n"), "x/twin.py": ("python", "def run():\n    pass\n"), "y/twin.py": ("python", "def run():\n    pass\n")})
    text = '[project.scripts]\na = "pkg.m:go"\nb = "m:go"\nc = "twin:run"\nd = "x.twin:run"\ne = "none:go"\n'
    assert entrypoints.script_units(graph.nodes, entrypoints.scripts(text)) == [("a", "pkg.m:go"), ("b", "pkg.m:go"), ("d", "x.twin:run")]
    assert {r["node_id"] for r in entrypoints.detect(graph, None, text).entrypoints.collect()} == {"pkg.m:go", "x.twin:run"}


def test_configuration_is_looked_for_upwards(tmp_path):
    from skein.operators import entrypoints

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "pyproject.toml").write_text("[project]\n")
    assert entrypoints.configuration(str(tmp_path / "a" / "b")) == (None, "[project]\n")
    (tmp_path / "a" / "b" / "entrypoints.toml").write_text("# none\n")
    assert entrypoints.configuration(str(tmp_path / "a" / "b")) == ("# none\n", None)


def test_explicit_mappings(spark):
    import json

    import pytest

    from skein.engine import QueryEngine

    engine = QueryEngine(ingest.parse_text(spark, {"m.c": ("c", "int f(void) { return 1; }\n")}))
    engine.augment_binary(json.dumps({"artifact": {"key": "fw", "hash": "ab"}, "functions": [{"id": "1", "symbol": "f", "address": 16, "size": 8}]}))
    one = {"source_node_id": "m:f", "start": "0x10", "end": 20}
    engine.augment_binary_mapping(json.dumps({"sha256": "ab", "mappings": [one]}))
    assert [(r["node_id"], r["source_path"], r["line"]) for r in engine.source_at_address("fw", 17).collect()] == [("m:f", "m.c", 1)]
    before = engine.graph
    for wrong in ({"sha256": "no", "mappings": [one]}, {"sha256": "ab", "mappings": [one | {"source_node_id": "m:g"}]}, {"sha256": "ab", "mappings": [one | {"end": 16}]}, {"sha256": "ab", "mappings": [one | {"address_kind": "x"}]}, {"sha256": "ab"}):
        with pytest.raises(ValueError):
            engine.augment_binary_mapping(json.dumps(wrong))
    assert engine.graph is before


def test_overloads_are_dealt_by_rows(spark, monkeypatch):
    from skein.functions import storage

    monkeypatch.setattr(storage, "ROWS", 20)
    units = [(f"f{k % 150}", k % 7, k) for k in range(600)]
    got = linking.overload_ids(spark.createDataFrame(units, "base string, start_line int, start_col int")).withColumn("task", F.spark_partition_id())
    last = {}
    for base, line, col in units:
        last[base] = max(last.get(base, (-1, -1)), (line, col))
    found = got.collect()
    assert sorted(r["id"] for r in found) == sorted(b if (x, y) == last[b] else f"{b}@{x}_{y}" for b, x, y in units)
    assert len({r["task"] for r in found}) > 15


def test_edge_differences_are_one_grouping(spark, capsys):
    kind = "src string, dst string, kind string, confidence string"
    a = [("a", "b", "calls", "certain"), ("a", "b", "calls", "certain"), ("a", None, "calls", None), ("a", "c", "calls", "certain")]
    b = [("a", "b", "calls", "certain"), ("a", None, "calls", None), ("a", "c", "calls", "inferred"), ("a", "c", "calls", "inferred"), (None, "d", None, "x")]
    got = diffing.edges(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind))
    assert {tuple(r) for r in got.collect()} == {("a", "c", "calls", "certain", "removed"), ("a", "c", "calls", "inferred", "added"), (None, "d", None, "x", "added")} and got.count() == 3
    got.explain()
    assert "Join" not in capsys.readouterr().out


def test_open_calls_are_found_once(spark, monkeypatch):
    from skein.bundle import GraphBundle

    stored = []
    real = linking.cut
    monkeypatch.setattr(linking, "cut", lambda df: stored.append(set(df.columns)) or real(df))
    nodes = spark.createDataFrame([("a:f", "f", "function", "go", "{}"), ("b:g", "g", "function", "go", "{}"), ("m:h", "h", "function", "go", None)], "id string, name string, kind string, language string, attrs string")
    edges = [(0, "a:f", "a:g", "calls", "certain", "{}"), (1, "a:f", "a:g", "calls", "certain", '{"binding_blocked":true}'), (2, "a:f", "m.h", "calls", "certain", None), (3, "a", "m", "imports", "certain", "{}"), (4, "b:g", "m.h", "calls", "certain", "{}")]
    out = linking.cross_file_calls(GraphBundle(spark, {"nodes": nodes, "edges": spark.createDataFrame(edges, "edge_seq long, src string, dst string, kind string, confidence string, attrs string")}))
    assert {(r["edge_seq"], r["dst"], r["confidence"]) for r in out.edges.collect()} == {(0, "b:g", "inferred"), (1, "a:g", "certain"), (2, "m:h", "inferred"), (3, "m", "certain"), (4, "m.h", "certain")}
    assert {"edge_seq", "src", "dst", "language", "file_path", "package"} in stored


def test_equal_type_names_are_looked_up_once(spark, monkeypatch):
    from skein.bundle import GraphBundle

    asked = []
    real = linking.tiered_matches
    monkeypatch.setattr(linking, "tiered_matches", lambda refs, index: asked.append(refs.count()) or real(refs, index))
    nodes = [(f"m:u{k}", f"u{k}", "function", "go") for k in range(60)] + [("n:T", "T", "class", "go"), ("x:T", "T", "class", "rust"), ("n:S", "S", "class", "go"), ("o:S", "S", "class", "go"), ("m:O", "O", "class", "go"), ("n:O", "O", "class", "go")]
    refs = [(f"m:u{k}", name, None) for k in range(60) for name in ("T", "S", "O")] + [("m:u1", "S", "o"), ("m:u1", "T", None), ("n:T", "T", None)]
    graph = GraphBundle(spark, {"nodes": spark.createDataFrame(nodes, "id string, name string, kind string, language string"), "edges": spark.createDataFrame([], "edge_seq long, src string, dst string, kind string, confidence string, attrs string"), "type_refs": spark.createDataFrame(refs, "node_id string, name string, module string")})
    got = sorted((r["src"], r["dst"]) for r in linking.type_uses(graph).edges.where("kind = 'type_uses'").collect())
    assert got == sorted([(f"m:u{k}", x) for k in range(60) for x in ("n:T", "m:O")] + [("m:u1", "o:S")])
    assert asked == [5]

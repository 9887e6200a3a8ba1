"""Sources in, answers out: frontends, linking, findings, entrypoints, diagrams, diff, storing."""

import json

import pytest
from pyspark.sql import functions as F

from skein import cli, render
from skein.bundle import GraphBundle
from skein.engine import QueryEngine
from skein.operators import diffing, entrypoints, imports, intervals, linking
from skein.sources import frontends, ingest, languages, policy, reports

PY = '''
from typing import Optional
class Base:
    def run(self, n: int) -> str:
        return self.help(n)
    def help(self, n):
        if n and n > 1:
            raise ValueError("x")
        return str(n)
class Child(Base):
    def __init__(self, b: Optional[Base] = None):
        super().__init__()
@app.route("/x")
def view(c: Child):
    c.run(1); other(2)
def main():
    view(Child())
'''
FILES = {
    "m.py": ("python", PY),
    "pkg/o.py": ("python", "def other(k):\n    for i in range(k):\n        print(i)\n"),
    "a.sol": ("solidity", "contract A { uint x; function f(uint a) public { if (a > 1) { g(a); } } function g(uint b) internal { x = b; } }\ncontract B is A { function h() external { f(2); } }\n"),
    "bad.py": ("python", "def (:\n"),
}


@pytest.fixture(scope="module")
def engine(spark):
    return QueryEngine(entrypoints.detect(ingest.parse_text(spark, FILES)))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def edges(engine, kind):
    return {(r["src"], r["dst"], r["confidence"]) for r in engine.graph.edges.where(F.col("kind") == kind).collect()}


def test_python_facts(engine):
    nodes = {r["id"]: r for r in engine.graph.nodes.collect()}
    assert nodes["m:Base.help"]["cc"] == 3 and nodes["m:Base.help"]["exception_types"] == ["ValueError"]
    assert [(p["name"], p["type"], p["default"]) for p in nodes["m:Child.__init__"]["parameters"]] == [("b", "Optional[Base]", "None")]
    assert nodes["m:view"]["kind"] == "function" and nodes["m:Base.run"]["kind"] == "method"


def test_links(engine):
    calls = edges(engine, "calls")
    assert ("m:Base.run", "m:Base.help", "certain") in calls
    assert ("m:view", "pkg.o:other", "inferred") in calls
    assert ("m:view", "proxy.unresolved:c.run", "inferred") in calls
    assert edges(engine, "inherits") == {("m:Child", "m:Base", "inferred"), ("a:B", "a:A", "inferred")}
    assert ("m:view", "m:Child", "inferred") in edges(engine, "type_uses")


def test_queries(engine):
    assert ids(engine.callers_of("other")) == ["m:view"]
    assert ids(engine.callees_of("m:main")) == ["m:Child", "m:view"]
    assert "pkg.o:other" in ids(engine.reachable_from("m:main"))
    assert ids(engine.ancestors_of("other")) == ["m:main", "m:view"]
    assert [tuple(r["path"]) for r in engine.paths_between("m:main", "other").collect()] == [("m:main", "m:view", "pkg.o:other")]
    assert ids(engine.functions_that_raise("ValueError")) == ["m:Base.help"]
    assert engine.callers_of("nobody").count() == 0
    assert [r["name"] for r in engine.type_references("m:view").collect()] == ["Child"]
    assert engine.parse_diagnostics().count() == 1
    report, by_callee = engine.call_resolution()
    row = report.first()
    assert row["call_sites"] == row["resolved"] + row["unresolved"] and by_callee.agg(F.sum("sites")).first()[0] == row["unresolved"]


def test_entrypoints(engine):
    got = {r["node_id"]: r["trust_level"] for r in engine.attack_surface().collect()}
    assert got == {"a:A.f": "untrusted_external", "a:B.h": "untrusted_external", "m:main": "trusted_internal", "m:view": "untrusted_external"}
    assert engine.entrypoint_candidates().count() == 0
    text = '[[entrypoint]]\nname_regex = "^other$"\nkind = "database"\n[[entrypoint]]\nnode = 5\n[[entrypoint]]\nname_regex = "x"\nkind = "wrong"\n'
    more = entrypoints.detect(engine.graph, text, '[project.scripts]\ntool = "m:view"\n')
    got = {r["node_id"]: r["kind"] for r in more.entrypoints.collect()}
    assert got["pkg.o:other"] == "database" and got["m:view"] == "user_input"


def test_proxies_are_idempotent(engine):
    again = linking.materialise_proxies(engine.graph)
    assert ids(again.nodes) == ids(engine.graph.nodes)
    key = ["src", "dst", "kind", "attrs"]
    assert again.edges.select(key).exceptAll(engine.graph.edges.select(key)).count() == 0


def test_proxy_ids_keep_apart_what_escaping_joins(spark):
    rows = linking.proxy_ids(spark.createDataFrame([("a b",), ("a\tb",), ("c",)], "symbol string")).collect()
    assert len({r["id"] for r in rows}) == 3 and "proxy.unresolved:c" in {r["id"] for r in rows}


def test_preanalysis_twice_is_the_same(engine):
    own = QueryEngine(engine.graph)
    own.preanalysis(2)
    first = sorted(map(tuple, own.graph.annotations.select("node_id", "kind", "description").collect()))
    own.preanalysis(2)
    assert sorted(map(tuple, own.graph.annotations.select("node_id", "kind", "description").collect())) == first
    assert {"entrypoints", "tainted", "high_blast_radius"} <= {r["name"] for r in own.subgraph_names().collect()}
    assert ids(own.subgraph("entrypoints")) == ["a:A.f", "a:B.h", "m:main", "m:view"]


def test_annotations(engine):
    own = QueryEngine(engine.graph)
    assert own.annotate("other", "invariant", "k >= 0") and not own.annotate("nobody", "invariant", "x")
    assert [r["description"] for r in own.annotations_of("other").collect()] == ["k >= 0"]
    assert own.clear_annotations("other") and own.annotations_of("other").count() == 0
    with pytest.raises(ValueError):
        own.annotate("other", "wrong", "x")
    with pytest.raises(ValueError):
        own.add_subgraph("s", ["nobody"])
    own.add_subgraph("s", ["m:view", "pkg.o:other"])
    assert own.subgraph_edges("s").count() == 1


SARIF = {"runs": [{"tool": {"driver": {"name": "T"}}, "originalUriBaseIds": {"R": {"uri": "file:///src/"}}, "artifacts": [{"location": {"uri": "m.py"}}], "results": [
    {"level": "error", "ruleId": "R1", "message": {"text": "bad"}, "locations": [{"physicalLocation": {"artifactLocation": {"index": 0}, "region": {"startLine": 8}}}]},
    {"message": {"text": "far"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "none.py"}, "region": {"startLine": 1}}}]},
]}]}


def test_sarif_and_weaudit(engine):
    own = QueryEngine(engine.graph)
    assert own.augment_sarif(json.dumps(SARIF)) == {"matched": 1, "unmatched": 1}
    assert ids(own.findings()) == ["m", "m:Base", "m:Base.help"]
    assert own.augment_sarif(json.dumps(SARIF)) == {"matched": 1, "unmatched": 1}
    assert own.graph.annotations.where("source = 'sarif:T'").count() == 3
    audit = {"clientRemote": "me", "treeEntries": [{"label": "look", "entryType": 1, "details": {"severity": "High", "type": "Access"}, "locations": [{"path": "pkg/o.py", "startLine": 1, "endLine": 1}]}]}
    assert own.augment_weaudit(json.dumps(audit))["matched"] == 1
    before = own.graph
    with pytest.raises(ValueError):
        own.augment_sarif("{}")
    assert own.graph is before


def test_uris():
    assert reports.local_path("file:///src/a%20b.py", "/src") == "a b.py"
    assert reports.local_path("https://x/y") is None and reports.local_path("../x") is None
    assert reports.sarif_uri({"uri": "a", "uriBaseId": "X"}, {"originalUriBaseIds": {"X": {"uri": "lib/", "uriBaseId": "Y"}, "Y": {"uri": "file:///r/"}}}) == "file:///r/lib/a"


def test_declared_links(engine, spark):
    text = '[[link]]\nsource = "m:main"\ntarget = "outside thing"\ntarget_external = true\n'
    out = imports.link(engine.graph, reports.declared_links(spark, text))
    assert ("m:main", "proxy.external:outside_thing") in {(r["src"], r["dst"]) for r in out.edges.collect()}
    with pytest.raises(ValueError):
        imports.link(engine.graph, reports.declared_links(spark, '[[link]]\nsource = "m:main"\ntarget = "nowhere"\n'))
    with pytest.raises(ValueError):
        reports.declared_links(spark, '[[link]]\nsource = "a"\ntarget = "b"\nkind = "x"\n')


def test_binary_graph(engine):
    own = QueryEngine(engine.graph)
    data = {"artifact": {"key": "fw", "hash": "ab"}, "functions": [{"id": "1", "symbol": "other", "address": "0x10", "size": 8}, {"id": "2", "symbol": "twin", "address": 32}, {"id": "3", "symbol": "twin", "address": 48}], "calls": [{"source": "1", "target": "2"}, {"source": "2", "target": "twin"}, {"source": "3", "target": "puts"}]}
    own.augment_binary(json.dumps(data))
    got = {(r["src"], r["dst"], r["confidence"]) for r in own.graph.edges.where("src like 'bin.%'").collect()}
    assert ("bin.fw:other", "pkg.o:other", "inferred") in got
    assert any(b == "proxy.external:puts" and c == "uncertain" for _, b, c in got)
    assert any(b == "proxy.external:twin" for _, b, c in got)
    assert own.binary_ranges("bin.fw:other").count() == 1 and own.binary_artifacts().count() == 1
    with pytest.raises(ValueError):
        own.augment_binary(json.dumps(data | {"artifact": {"key": "fw", "hash": "other"}}))


def test_diagrams(engine):
    assert engine.diagram("call-graph", focus="view", depth=1).splitlines()[0] == "flowchart TD"
    assert "m_Base <|-- m_Child" in engine.diagram("class-hierarchy")
    assert "+run() str" in engine.diagram("containment")
    assert ":::low" in engine.diagram("complexity", threshold=2)
    assert "m_view -.-> pkg_o_other" in engine.diagram("data-flow", focus="other")
    assert "No import edges found" in engine.diagram("module-deps")
    assert len(set(render.chart_names(["a.b", "a:b", "a_b"]).values())) == 3
    with pytest.raises(ValueError):
        engine.diagram("pie")


def test_json_and_parquet(engine, spark, tmp_path):
    doc = json.loads(engine.to_json())
    assert doc["schema_version"] == 1 and doc["nodes"]["m:view"]["cyclomatic_complexity"] == 1
    engine.graph.save(str(tmp_path / "g"))
    again = GraphBundle.load(spark, str(tmp_path / "g"))
    assert json.loads(QueryEngine(again).to_json()) == doc


def test_diff(engine, spark):
    changed = dict(FILES) | {"pkg/o.py": ("python", "def other(k):\n    return k\ndef extra():\n    pass\n")}
    after = QueryEngine(ingest.parse_text(spark, changed))
    status = {(r["id"], r["status"]) for r in diffing.nodes(engine.graph, after.graph).collect()}
    assert ("pkg.o:other", "modified") in status and ("pkg.o:extra", "added") in status and ("proxy.unresolved:pkg.o:range", "removed") in status
    assert diffing.report(engine.graph, engine.graph) == "no differences\n"
    assert "nodes added: 1" in diffing.report(engine.graph, after.graph)


def test_merge(engine, spark):
    other = ingest.parse_text(spark, {"z.py": ("python", "def z():\n    pass\n")})
    both = engine.graph.merge(other)
    assert both.nodes.count() == engine.graph.nodes.count() + other.nodes.count()
    assert both.edges.count() == engine.graph.edges.count() + other.edges.count()
    assert other.merge(other).nodes.count() == other.nodes.count()


def test_directory_and_cli(spark, tmp_path, capsys):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "m.py").write_text(PY)
    (tmp_path / "pkg" / "o.py").write_text(FILES["pkg/o.py"][1])
    (tmp_path / "node_modules" / "x.js").write_text("function a() {}")
    (tmp_path / "h.h").write_text("int add(int a, int b) { return a + b; }\n")
    (tmp_path / "c.c").write_text("int main(void) { return add(1, 2); }\n")
    assert ingest.detect_languages(spark, str(tmp_path)) == ["python", "c"]
    assert cli.main(["analyze", str(tmp_path)], spark) == 0
    assert json.loads(capsys.readouterr().out)["functions"] == 8
    assert cli.main(["diagram", str(tmp_path), "--type", "complexity", "--threshold", "2"], spark) == 0
    assert "flowchart" in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "pkg" / "none")], spark) == 2
    assert cli.main(["version"]) == 0


def test_policy(spark, tmp_path):
    for name in ("a.py", "gen/b.py", ".git/c.py", "dist/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    rows = {r["path"]: r["reason"] for r in policy.SourcePolicy((str(tmp_path),), exclude=("gen",)).discover(spark).collect()}
    assert rows == {"a.py": "selected", "gen": "excluded_pattern", ".git": "vcs_directory", "dist": "default_directory"}
    assert policy.matches("a/b/c.py", ("**/*.py",)) and policy.matches("x/gen/y.py", ("gen",)) and not policy.matches("a/b.py", ("*.js",))


SAMPLES = {
    "java": ("class A extends B { int f(int x) { if (x > 0 && g(x)) return 1; return 0; } boolean g(int y) { return y > 1; } }", "t:A.f", 3),
    "go": ("package p\nfunc f(x int) int {\n\tfor x > 0 { g() }\n\treturn x\n}\nfunc g() {}\n", "t:f", 2),
    "rust": ("struct S; impl S { }\nfn f(x: u8) -> u8 { if x > 1 { g() } else { 0 } }\nfn g() -> u8 { 1 }\n", "t:f", 2),
    "javascript": ("class C { run(a) { return a ? f(a) : 0; } }\nfunction f(x) { while (x) { x--; } }\nconst h = (y) => f(y);\n", "t:f", 2),
    "ruby": ("class C\n  def run(a)\n    if a\n      go(a)\n    end\n  end\nend\n", "t:C.run", 2),
    "c": ("/* f() */ static int f(int a) { return a ? 1 : 2; }\nint g(void) { return f(3); }\n", "t:f", 2),
    "haskell": ("main :: IO ()\nmain = print 1\nadd :: Int -> Int\nadd x = x\n", "t:main", None),
    "php": ("<?php\nclass A { function f($x) { if ($x) { $this->g(); } } function g() {} }\n", "t:A.f", 2),
    "kotlin": ("class A { fun f(x: Int): Int { return when (x) { 1 -> 2 else -> 3 } } }\n", "t:A.f", 2),
    "bash": ("deploy() {\n  if true; then echo hi; fi\n}\n", "t:deploy", 2),
    "lua": ("function m.f(x)\n  if x then g() end\nend\n", "t:f", 2),
    "move": ("module a::b { public entry fun f(x: u64) { if (x > 1) { g() } } fun g() {} }\n", "t:a::b.f", None),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_scanned_languages(language):
    text, node, cc = SAMPLES[language]
    rows = [r for t, r in frontends.facts("t.x", language, text) if t == "nodes"]
    found = {r["id"]: r for r in rows}
    assert node in found, sorted(found)
    if cc is not None:
        assert found[node]["cc"] == cc


@pytest.mark.parametrize("language", languages.supported_languages())
def test_no_frontend_fails(language):
    for text in ("", "\x00{{{((( ''' \"\"\" /* ", "class A { f(", "x" * 5000, "{" * 2000):
        assert frontends.facts("t.x", language, text)[0][0] == "nodes"


def test_python_redefinitions_and_depth():
    rows = [r for t, r in frontends.facts("a/__init__.py", "python", "def f():\n    pass\ndef f():\n    pass\n") if t == "nodes"]
    assert [r["id"] for r in rows] == ["a", "a:f@1_0", "a:f"]
    deep = "".join("  " * k + f"def f{k}():\n" for k in range(60)) + "  " * 60 + "pass\n"
    assert len([1 for t, _ in frontends.facts("d.py", "python", deep) if t == "nodes"]) == 61
    assert frontends.module_id("a.b/c.py") == "a\\.b.c"


def test_intervals(spark):
    import random

    rng = random.Random(1)
    spans = [(k, s := rng.randint(0, 300), s + rng.randint(0, 90)) for k in range(60)]
    points = [(k, rng.randint(0, 400)) for k in range(100)]
    a, b = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "k long, start long, end long")
    got = {(r["p"], r["k"]) for r in intervals.stab(a, b, width=16).collect()}
    assert got == {(p, k) for p, at in points for k, s, e in spans if s <= at < e}
    # Spans of any length are a few rows, and meet what they should.
    wide = b.unionByName(spark.createDataFrame([(100, -5, 1 << 50), (101, 200, 70_000)], "k long, start long, end long"))
    assert intervals.bucketed(wide, 16).groupBy("k").count().agg(F.max("count")).first()[0] <= 64
    spans += [(100, -5, 1 << 50), (101, 200, 70_000)]
    b = wide
    assert {(r["p"], r["k"]) for r in intervals.stab(a, b, width=16).collect()} == {(p, k) for p, at in points for k, s, e in spans if s <= at < e}
    # Coalesced block by block as over all spans at once, whatever the number of blocks, gaps and long spans.
    keyed = [("x" if k % 3 else None, s, e) for k, s, e in spans if e > s] * 3 + [("y", 10 * k, 10 * k + 5) for k in range(40)] * 4
    df = spark.createDataFrame(keyed, "g string, start long, end long")
    for gap in (0, 3):
        want = []
        for g in ("x", None, "y"):
            for s, e in sorted((s, e) for h, s, e in keyed if h == g):
                if want and want[-1][0] == g and s <= want[-1][2] + gap:
                    want[-1] = (g, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
                else:
                    want.append((g, s, e, 1))
        for parts in (1, 7, 1000):
            assert sorted(map(tuple, intervals.coalesced(df, ["g"], gap=gap, parts=parts).collect()), key=str) == sorted(want, key=str)
    left = b.select(F.col("k").alias("l"), F.lit(1).alias("f"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = b.select(F.col("k").alias("r"), F.lit(1).alias("f"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hits = [(r["l"], r["r"]) for r in intervals.overlaps(left, right, ["f"], 16).collect()]
    assert len(hits) == len(set(hits)) and set(hits) == {(x, y) for x, s, e in spans for y, t, u in spans if s <= u and t <= e}


def test_streaming(spark, tmp_path, sf):
    from skein.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("def f():\n    g()\n")
    stream = arrivals.parsed_arrivals(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("facts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.awaitTermination(60)
    assert {r["table"] for r in spark.table("facts").select("table").distinct().collect()} == {"nodes", "edges"}
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert arrivals.event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_solidity_state():
    text = "contract C { uint public total; uint constant K = 1; mapping(address => uint) held; function add(uint v) public { total += v; held[msg.sender] = v; } function get() public view returns (uint) { return total; } function hide(uint total) public { total = 2; } }"
    rows = frontends.facts("c.sol", "solidity", text)
    assert {r["id"] for t, r in rows if t == "nodes" and r["kind"] == "state_variable"} == {"c:C.total", "c:C.held"}
    got = {(r["src"], r["kind"], r["dst"]) for t, r in rows if t == "edges" and r["kind"] in ("reads", "writes")}
    assert {("c:C.add", "writes", "c:C.total"), ("c:C.add", "writes", "c:C.held"), ("c:C.get", "reads", "c:C.total")} <= got
    assert not any(a == "c:C.hide" for a, _, _ in got) and ("c:C.get", "writes", "c:C.total") not in got


def test_module_ids_that_clash():
    assert frontends.module_ids([("a.py", "python"), ("a.js", "javascript"), ("b.py", "python")]) == {"a.py": "a\\.py", "a.js": "a\\.js", "b.py": "b"}


def test_declarative_candidates(engine, spark):
    from skein.operators import candidates
    from skein.sources import literals

    files = spark.createDataFrame([("conf.yaml", 'handler: m:view\nname: "view"\nother: pkg/o.other\n'), ("x.json", '{"a": "m:Base.help", "b": "nothing.here"}')], "path string, content string")
    table = literals.literal_table(files)
    assert ("x.json", 1, "m:Base.help") in {tuple(r) for r in table.collect()}
    once = candidates.discover(engine.graph, table)
    got = {(r["src"], r["dst"]) for r in once.edges.where("kind = 'references'").collect()}
    assert got == {("@source:conf.yaml", "m:view"), ("@source:conf.yaml", "pkg.o:other"), ("@source:x.json", "m:Base.help")}
    twice = candidates.discover(once, table)
    assert twice.edges.count() == once.edges.count() and twice.evidence.count() == once.evidence.count()
    assert QueryEngine(once).entrypoint_candidates("pkg.o:other").count() == 1


def test_git_snapshots(tmp_path):
    import subprocess

    from skein.sources import snapshots

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "a.py")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    with snapshots.at_reference(str(tmp_path), "HEAD") as tree:
        with open(f"{tree}/a.py") as f:
            assert f.read() == "x = 1\n"
    for wrong in ("nowhere", "--help"):
        with pytest.raises(ValueError):
            with snapshots.at_reference(str(tmp_path), wrong):
                pass


def shapes(language, text, name="t.x"):
    rows = frontends.facts(name, language, text)
    nodes = {r["id"]: r["kind"] for t, r in rows if t == "nodes"}
    return nodes, {(r["src"], r["kind"], r["dst"]) for t, r in rows if t == "edges" and r["kind"] != "contains"}


def test_sql_schema():
    nodes, edges = shapes("sql", "CREATE SCHEMA a;\nCREATE TABLE a.e (id int);\nCREATE VIEW a.v AS SELECT id FROM a.e;\nCREATE FUNCTION a.n() RETURNS int LANGUAGE SQL\nAS $$ SELECT 1 FROM a.e JOIN e USING (id) $$;\n")
    assert nodes == {"t": "module", "t:a": "schema", "t:a.e": "table", "t:a.v": "view", "t:a.n": "function"}
    assert edges == {("t:a.v", "corresponds_to", "t:a.e"), ("t:a.n", "corresponds_to", "t:a.e")}


def test_proto_and_thrift_schema():
    nodes, edges = shapes("proto", 'syntax = "proto3";\npackage ex.auth;\nimport "c.proto";\nservice S {\n  rpc Login (In) returns (Out);\n}\nmessage In { string token = 1; message Inner { int32 x = 1; } Inner i = 2; }\nmessage Out { bool ok = 1; }\n')
    assert nodes == {"ex.auth": "module", "ex.auth:S": "interface", "ex.auth:S.Login": "method", "ex.auth:In": "struct", "ex.auth:In.Inner": "struct", "ex.auth:In.Inner.x": "method", "ex.auth:In.token": "method", "ex.auth:In.i": "method", "ex.auth:Out": "struct", "ex.auth:Out.ok": "method"}
    assert {("ex.auth", "imports", "c.proto"), ("ex.auth:S.Login", "type_uses", "ex.auth:In"), ("ex.auth:S.Login", "type_uses", "ex.auth:Out")} <= edges
    nodes, edges = shapes("thrift", 'namespace py ex\ninclude "c.thrift"\nstruct In {\n  1: required string token\n}\nservice S {\n  bool login(1: In request),\n}\n')
    assert nodes == {"t": "module", "t:In": "struct", "t:In.token": "method", "t:S": "interface", "t:S.login": "method"}
    assert edges == {("t", "imports", "c.thrift"), ("t:S.login", "type_uses", "t:In")}


def test_graphql_schema(spark):
    text = "schema { query: Root }\ntype Root {\n  user(id: ID!): User\n}\ntype User implements Node {\n  id: ID!\n}\ninterface Node { id: ID! }\nenum E { A }\n"
    nodes, edges = shapes("graphql", text)
    assert nodes == {"t": "module", "t:Root": "interface", "t:Root.user": "method", "t:User": "interface", "t:User.id": "method", "t:Node": "interface", "t:Node.id": "method", "t:E": "enum"}
    assert {("t:Root.user", "type_uses", "t:User"), ("t:User", "implements", "t:Node")} <= edges
    tagged = entrypoints.detect(ingest.parse_text(spark, {"s.graphql": ("graphql", text)})).entrypoints
    assert [r["node_id"] for r in tagged.collect()] == ["s:Root.user"]


def test_clashing_modules_are_named_apart(spark):
    files = {"a.py": ("python", "def f():\n    pass\n"), "a.js": ("javascript", "function f() {}\n"), "x/b.py": ("python", "y = 1\n")}
    graph = ingest.parse_text(spark, files)
    assert ids(graph.nodes) == ["a\\.js", "a\\.js:f", "a\\.py", "a\\.py:f", "x.b"]


RULE_SAMPLES = {
    "h.go": ("go", "package p\nfunc Serve(w http.ResponseWriter, r *http.Request) {\n}\n", "h:Serve"),
    "W.java": ("java", "class W { void doGet(R r) { } }\n", "W:W.doGet"),
    "j.rb": ("ruby", "class J\n  def perform(x)\n  end\nend\n", "j:J.perform"),
    "k.fc": ("func", "() recv_internal(int a) impure {\n}\n", "k:recv_internal"),
    "r.rs": ("rust", "#[no_mangle]\npub fn go_in() {}\n", "r:go_in"),
    "p.rego": ("rego", "allow if {\n  input.x\n}\n", "p:allow"),
}


def test_rules_by_language(spark):
    graph = ingest.parse_text(spark, {k: v[:2] for k, v in RULE_SAMPLES.items()})
    tagged = {r["node_id"] for r in entrypoints.detect(graph).entrypoints.collect()}
    assert tagged == {v[2] for v in RULE_SAMPLES.values()}

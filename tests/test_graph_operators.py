"""Operators against slow, obvious versions on small random multigraphs, many graphs to a Spark job."""

import random

import pytest
from pyspark.sql import functions as F

from skein.bundle import GraphBundle
from skein.operators import lookup, preanalysis, traverse, views

EDGES = "edge_seq long, src string, dst string, kind string, confidence string, file_path string, start_line int, attrs string"


def random_graph(rng, g):
    n = rng.randint(1, 6)
    ids = [f"{g}/n{k}" for k in range(n)]
    ends = ids + [f"{g}/gone"]
    edges = [(rng.choice(ends), rng.choice(ends), rng.choice(["calls", "reads", "contains"])) for _ in range(rng.randint(0, 14))]
    return ids, edges


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)
    graphs = [random_graph(rng, g) for g in range(80)]
    nodes = spark.createDataFrame([(k, i, i, "function", "source") for k, i in enumerate(i for ids, _ in graphs for i in ids)], "node_seq long, id string, name string, kind string, origin string")
    rows = [(k, a, b, kind, "certain", None, None, "{}") for k, (a, b, kind) in enumerate(e for _, es in graphs for e in es)]
    return graphs, GraphBundle(spark, {"nodes": nodes, "edges": spark.createDataFrame(rows, EDGES)})


def links(graph, kinds):
    ids, edges = graph
    return {(a, b) for a, b, k in edges if k in kinds and a in ids and b in ids}


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen - {start}


@pytest.mark.parametrize("kinds", [None, ["reads", "contains"], []])
def test_projection(many, kinds):
    graphs, bundle = many
    want = {p for g in graphs for p in links(g, ["calls"] if kinds is None else kinds)}
    assert {tuple(r) for r in views.projected(bundle, kinds).collect()} == want


def test_closure_from_all_nodes(many):
    graphs, bundle = many
    roots = bundle.nodes.select(F.col("id").alias("root"), F.col("id").alias("node"))
    got = {(r["root"], r["node"]) for r in traverse.closure(views.projected(bundle), roots).collect()}
    assert got == {(i, x) for g in graphs for i in g[0] for x in reach(links(g, ["calls"]), i)}
    back = {(r["root"], r["node"]) for r in traverse.closure(traverse.reversed_edges(views.projected(bundle)), roots).collect()}
    assert back == {(b, a) for a, b in got}


def simple_paths(pairs, src, dst, depth):
    out, todo = set(), [(src,)]
    while todo:
        p = todo.pop()
        if p[-1] == dst and len(p) > 1:
            out.add(p)
            continue
        if len(p) <= depth:
            todo += [(*p, b) for a, b in pairs if a == p[-1] and b not in p]
    return out


@pytest.mark.parametrize("depth", [1, 2, 20])
def test_simple_paths(many, spark, depth):
    graphs, bundle = many
    ends = [(g[0][0], g[0][-1]) for g in graphs]
    got = {tuple(r["path"]) for r in traverse.paths(views.projected(bundle), spark.createDataFrame(ends, "src string, dst string"), depth).collect()}
    assert got == {p for g, (a, b) in zip(graphs, ends) if a != b for p in simple_paths(links(g, ["calls"]), a, b, depth)}


def test_path_depth_is_checked(many, spark):
    with pytest.raises(ValueError):
        traverse.paths_between(views.projected(many[1]), "a", "b", 0)


def test_ball_has_shortest_hops(many):
    graphs, bundle = many
    for g in graphs[:3]:
        pairs = {(a, b) for a, b, k in g[1] if k == "calls" and a in g[0] and b in g[0]}
        both = pairs | {(b, a) for a, b in pairs}
        level, hops = {g[0][0]}, {g[0][0]: 0}
        for d in (1, 2):
            level = {b for a, b in both if a in level} - hops.keys()
            hops |= dict.fromkeys(level, d)
        got = {r["node"]: r["hops"] for r in traverse.ball(views.projected(bundle), g[0][0], 2).collect()}
        assert got == hops


def test_blast_radius_counts(many):
    graphs, bundle = many
    got = {r["node"]: (r["downstream"], r["upstream"]) for r in preanalysis.blast_radius(views.projected(bundle), bundle.nodes).collect()}
    for g in graphs:
        pairs = links(g, ["calls"])
        for i in g[0]:
            assert got[i] == (len(reach(pairs, i)), len(reach({(b, a) for a, b in pairs}, i)))
    with pytest.raises(ValueError):
        preanalysis.blast_radius(views.projected(bundle), bundle.nodes, limit=5)


def test_all_pairs_in_blocks_equal_one_block(many):
    _, bundle = many
    proj, nodes = views.projected(bundle), bundle.nodes.where("node_seq < 60").withColumn("cc", F.col("node_seq") % 5)
    size = nodes.count() // 3 + 1
    for f in (preanalysis.blast_radius, preanalysis.critical):
        one, more = (sorted(map(tuple, f(proj, nodes, block=n).collect())) for n in (10**9, size))
        assert one == more and one


def test_preanalysis_has_no_limit_of_nodes(spark):
    n = 20_050
    ids = lambda k: F.concat(F.lit("n"), k)
    nodes = spark.range(n).select(ids(F.col("id")).alias("id"), F.lit(1).alias("cc"))
    proj = spark.range(n // 2).select(ids(F.col("id") * 2).alias("src"), ids(F.col("id") * 2 + 1).alias("dst"))
    assert preanalysis.blast_radius(proj, nodes).agg(F.count("*"), F.sum("downstream"), F.sum("upstream")).first() == (n, n // 2, n // 2)
    assert preanalysis.critical(proj, nodes).count() == n // 2


def test_unknown_kinds_are_refused(many):
    with pytest.raises(ValueError):
        views.projected(many[1], ["cals"])


NODES = [("m:f", "f", "function", "source"), ("proxy.unresolved:f", "f", "proxy", "proxy"), ("m:C.f", "g", "method", "source"), ("m:C.h@3_4", "h@3_4", "method", "source"), ("x:m:k", "k2", "function", "source"), ("a.k", "k3", "function", "source"), ("proxy.unresolved:only", "only", "proxy", "proxy"), ("m:dup", "dup", "function", "source"), ("n:dup", "dup", "function", "source")]


def plain_lookup(ref):
    import re

    base = lambda s: re.sub(r"@\d+_\d+$", "", s)
    best = None
    for k, (i, name, kind, origin) in enumerate(NODES):
        if i == ref:
            return i
        rank = 0 if ref in (name, base(name)) else 1 if base(i) == ref or base(i).endswith(":" + ref) else 2 if base(i).endswith("." + ref) else None
        if rank is not None:
            best = min(x for x in (best, (kind == "proxy" or origin == "proxy", rank, k, i)) if x)
    return best and best[3]


def test_ranked_lookup(spark):
    nodes = spark.createDataFrame([(k, *n) for k, n in enumerate(NODES)], "node_seq long, id string, name string, kind string, origin string")
    refs = ["f", "m:f", "g", "h", "C.h", "m:C.h", "k", "only", "dup", "n:dup", "missing", "C.f", "proxy.unresolved:f", "k2", "h@3_4"]
    for r in refs:
        row = lookup.resolve(nodes, r).first()
        assert (row and row["id"]) == plain_lookup(r), r
    got = {r["ref"]: r["node_id"] for r in lookup.resolve_all(nodes, spark.createDataFrame([(r,) for r in refs], "ref string")).collect()}
    assert got == {r: plain_lookup(r) for r in refs if plain_lookup(r)}


def test_binary_sets(spark):
    from skein.operators import binaries

    funcs = spark.createDataFrame([("a", "f", "f", ".text", 0, None), ("a", "g", "g", ".text", 16, 20), ("a", "c", "g.cold", ".text", 32, 40)], "artifact string, node_id string, name string, section string, start long, end long")
    ended = binaries.function_ends(funcs)
    assert {(r["node_id"], r["end"]) for r in ended.collect()} == {("f", 16), ("g", 20), ("c", 40)}
    spans = spark.createDataFrame([("a", 8, 36), ("a", 38, 50)], "artifact string, s_start long, s_end long")
    assert {(r["start"], r["end"]) for r in binaries.gaps(ended, spans).collect()} == {(20, 32), (40, 50)}
    jumps = spark.createDataFrame([("a", 3, 16), ("a", 4, 32), ("a", 5, 0), ("a", 17, 18)], "artifact string, address long, target long")
    assert [tuple(r) for r in binaries.tail_calls(jumps, ended).collect()] == [("a", 3, "f", "g")]
    calls = {(r["address"], r["src"], r["dst"], r["confidence"]) for r in binaries.calls_by_owner(jumps.withColumn("how", F.lit("direct")), ended).collect()}
    assert (4, "f", "c", "certain") in calls and (17, "g", "g", "certain") in calls
    stubs = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "z")], "stub string, symbol string")
    exports = spark.createDataFrame([("x", "n1"), ("y", "n1"), ("y", "n2")], "symbol string, node_id string")
    assert {tuple(r) for r in binaries.stub_links(stubs, exports).collect()} == {("s1", "n1", "inferred"), ("s2", None, "uncertain"), ("s3", None, "uncertain")}
    names = spark.createDataFrame([("1", "_run"), ("2", "ns::C::go(int)"), ("3", "twin")], "id string, symbol string")
    sources = spark.createDataFrame([("run", "m:run"), ("go", "m:go"), ("twin", "a:twin"), ("twin", "b:twin")], "name string, to string")
    assert {tuple(r) for r in binaries.aliased(names, sources).collect()} == {("1", "m:run"), ("2", "m:go")}
    arts, nodes = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("f",)], "id string")
    ranges = spark.createDataFrame([("a", "f", 0, 8), ("b", "f", 0, 8), ("a", "q", 4, 4)], "artifact string, node_id string, start long, end long")
    maps = spark.createDataFrame([("a", "f", 2, 4), ("a", "f", 6, 12)], "artifact string, node_id string, start long, end long")
    assert binaries.violations(arts, ranges, maps, nodes).count() == 4


def test_blocks_do_not_grow_with_the_graph(spark, monkeypatch):
    nodes = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("cc"))
    proj = spark.range(30).select(F.col("id").cast("string").alias("src"), (F.col("id") + 10).cast("string").alias("dst"))
    walks, plain = [], traverse.closure
    monkeypatch.setattr(traverse, "closure", lambda *a, **k: walks.append(1) or plain(*a, **k))
    found = preanalysis.blast_radius(proj, nodes, block=1)
    assert len(walks) <= preanalysis.BLOCKS < 40
    assert {(r["node"], r["downstream"], r["upstream"]) for r in found.collect()} == {(str(n), 3 - n // 10, n // 10) for n in range(40)}


def test_critical_takes_no_pairs(spark, monkeypatch):
    nodes = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("cc"))
    proj = spark.range(30).select(F.col("id").cast("string").alias("src"), (F.col("id") + 10).cast("string").alias("dst"))
    monkeypatch.setattr(traverse, "closure", lambda *a, **k: pytest.fail("pairs were made"))
    found = {(r["root"], r["node"], r["place"]) for r in preanalysis.critical(proj, nodes, 2).collect()}
    assert found == {(str(n), str(n % 10 + 30 - 10 * k), k + 1) for n in range(30) for k in range(2) if n % 10 + 30 - 10 * k > n}


def test_lists_of_roots_reach_what_a_walk_reaches(spark):
    """Also through what does not exist, over circles, from roots that do not exist, and with lists of a node in several batches."""
    rng = random.Random(3)
    names = [f"n{k}" for k in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(90)] + [(n, "hub") for n in names] + [("hub", "gone"), ("gone", "after"), ("hub", "end")]
    there = [*names[:50], "hub", "after", "end"]
    roots = [(f"r{k % 40}", rng.choice(names)) for k in range(70)]
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    want = set()
    for root, node in roots:
        todo = [node] if node in there else []
        while todo:
            at = todo.pop()
            if (root, at) not in want:
                want.add((root, at))
                todo += [b for b in ahead.get(at, ()) if b in there]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        numbers, found = traverse.sets(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(roots, "root string, node string"), spark.createDataFrame([(n,) for n in there], "id string"))
        got = [tuple(r) for r in traverse.members(found).join(numbers, "n").select("root", "node").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(set(got)) and set(got) == want
    assert found.groupBy("node").count().agg({"count": "max"}).first()[0] < 40  # lists, not a row a pair


def test_walks_of_one_root_stay_within_the_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "gone"), ("gone", "d"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "id string")
    assert {r["node"] for r in traverse.reachable_from(edges, "a", nodes).collect()} == {"b", "c"}
    assert {(r["node"], r["hops"]) for r in traverse.ball(edges, "b", 1, nodes=nodes).collect()} == {("b", 0), ("a", 1), ("c", 1)}
    assert traverse.ball(edges, "gone", 2, nodes=nodes).count() == 0
    starts = spark.createDataFrame([("a",), ("d",), ("gone",)], "node_id string")
    found = traverse.paths_to(edges, starts, spark.createDataFrame([("c",), ("e",)], "node_id string"), 4, nodes)
    assert sorted("".join(r["path"]) for r in found.collect()) == ["abc", "de"]


def test_lists_do_not_split_with_the_tasks_that_number(spark):
    """A node's roots are in as few rows as they fill, however many tasks numbered them; no row grows without bound."""
    edges = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("hub").alias("dst")).unionByName(spark.createDataFrame([("hub", "end"), ("hub", "end")], "src string, dst string"))
    roots = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("root"), F.concat(F.lit("n"), "id").alias("node"))
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers, found = traverse.sets(edges, roots, nodes)
        rows = {(r["node"], r["n"], r["total"], r["largest"]) for r in found.where("node in ('hub', 'end')").groupBy("node").agg(F.count("*").alias("n"), F.sum(F.size("roots")).alias("total"), F.max(F.size("roots")).alias("largest")).collect()}
        pairs = traverse.members(found).join(numbers, "n").where("node = 'end'")
        assert pairs.select("root").distinct().count() == pairs.count() == 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows == {(node, -(-3000 // traverse.LONG), 3000, traverse.LONG) for node in ("hub", "end")}


def test_blast_radius_takes_no_pairs(spark, monkeypatch):
    """Counts over lists of any block; edges that lead outside and loops of one node count only where nodes are not asked for alone."""
    monkeypatch.setattr(traverse, "closure", lambda *a, **k: pytest.fail("pairs were made"))
    nodes = spark.range(40).select(F.col("id").cast("string").alias("id"))
    proj = spark.range(30).select(F.col("id").cast("string").alias("src"), (F.col("id") + 10).cast("string").alias("dst"))
    proj = proj.unionByName(proj).unionByName(spark.createDataFrame([("39", "gone"), ("gone", "0"), ("5", "5")], "src string, dst string"))
    found = preanalysis.blast_radius(proj, nodes, block=3, within=True)
    assert {(r["node"], r["downstream"], r["upstream"]) for r in found.collect()} == {(str(n), 3 - n // 10, n // 10) for n in range(40)}

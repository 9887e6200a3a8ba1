"""The registered graph queries over the projected tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..engine import QueryEngine
from ..functions.storage import cut, tasks
from ..functions.text import escaped
from ..operators import binaries, diffing, exports, formal, inheritance, intervals, linking, lookup, metrics, overlay, preanalysis, prefixes, scopes, traverse, valueflow, views, visibility
from . import projection as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _path(column: str = "path"):
    return F.array_join(column, ">")


@query
def g_summary(spark, d):
    return metrics.summary(P.graph(spark, d))


@query
def g_kind_counts(spark, d):
    return metrics.kind_counts(P.graph(spark, d))


@query
def g_callees(spark, d):
    return views.neighbours(P.graph(spark, d), "customer:1", "calls", True).select("id", "name", "cc")


@query
def g_callers(spark, d):
    return views.neighbours(P.graph(spark, d), "part:1", "calls", False).select("id", "name", "cc")


@query
def g_degrees(spark, d):
    return views.degrees(P.graph(spark, d, complexity=False))


@query
def g_state_read_by(spark, d):
    return views.neighbours(P.graph(spark, d), "order:2", "reads", True).select("id", "name")


@query
def g_state_written_by(spark, d):
    return views.neighbours(P.graph(spark, d), "order:3", "writes", True).select("id", "name")


@query
def g_readers_of(spark, d):
    return views.neighbours(P.graph(spark, d), "part:2", "reads", False).select("id")


@query
def g_writers_of(spark, d):
    return views.neighbours(P.graph(spark, d), "part:1", "writes", False).select("id")


@query
def g_kind_projection(spark, d):
    return views.projected(P.graph(spark, d), ["reads", "contains"])


@query
def g_weakest_confidence(spark, d):
    return views.weakest_confidence(P.graph(spark, d).edges.where("kind = 'calls'"))


@query
def g_lookup_batch(spark, d):
    refs = P.table(spark, d, "nation").select(F.col("n_name").alias("ref")).unionByName(P.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"))).unionByName(P.table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("ref")))
    return lookup.resolve_all(P.graph(spark, d).nodes, refs)


@query
def g_lookup_one(spark, d):
    return lookup.resolve(P.graph(spark, d).nodes, "7").select("id", "name", "kind")


@query
def g_reachable_trade(spark, d):
    return traverse.reachable_from(views.projected(P.trade(spark, d)), "nation:0")


@query
def g_ancestors_trade(spark, d):
    return traverse.ancestors_of(views.projected(P.trade(spark, d)), "nation:0")


@query
def g_reachable_calls(spark, d):
    g = P.graph(spark, d, complexity=False)
    return traverse.reachable_from(views.raw_calls(g), "customer:1", g.nodes)


@query
def g_reachable_events(spark, d):
    return traverse.closure(P.flows(spark, d), P.flows(spark, d).select(F.col("src").alias("root"), F.col("src").alias("node"))).select("root", "node")


@query
def g_paths_trade_d3(spark, d):
    return traverse.paths_between(views.projected(P.trade(spark, d)), "nation:0", "nation:5", 3).select(_path().alias("path"))


@query
def g_paths_events_d4(spark, d):
    flows = cut(P.flows(spark, d))
    starts, goals = flows.select(F.col("src").alias("node_id")), flows.select(F.col("dst").alias("node_id"))
    return traverse.paths_to(flows, starts, goals, 4).select("src", "dst", _path().alias("path"))


@query
def g_entrypoint_paths(spark, d):
    g = P.graph(spark, d, complexity=False)
    return traverse.entrypoint_paths(views.raw_calls(g), g.entrypoints, "supplier:1", 3, g.nodes).select(_path().alias("path"))


@query
def g_connect_subgraphs(spark, d):
    g = P.trade(spark, d)
    side = lambda r: g.nodes.where(F.col("node_seq") % 5 == r).select(F.col("id").alias("node_id"))
    left = side(0).unionByName(side(1))
    return traverse.connect(views.projected(g), left, side(1), 2).select(_path().alias("path"))


@query
def g_bfs_ball(spark, d):
    return traverse.ball(views.projected(P.trade(spark, d)), "nation:3", 2)


@query
def g_blast_radius_trade(spark, d):
    g = P.trade(spark, d)
    return preanalysis.blast_radius(views.projected(g), g.nodes)


@query
def g_top_critical(spark, d):
    g = P.trade(spark, d)
    return preanalysis.critical(views.projected(g), g.nodes)


@query
def g_entrypoint_reach(spark, d):
    return preanalysis.entrypoint_reach(P.graph(spark, d, complexity=False)).groupBy("label").agg(F.count("*").alias("n"))


@query
def g_privilege_boundary(spark, d):
    return preanalysis.privilege_boundaries(P.trade(spark, d)).groupBy("src", "dst", "src_trust", "dst_trust").agg(F.count("*").alias("n"))


@query
def g_taint(spark, d):
    return preanalysis.taint(P.trade(spark, d))


@query
def g_unresolved_links(spark, d):
    out = views.unresolved_calls(linking.materialise_proxies(P.web(spark, d)))
    return out.groupBy(F.col("raw_target").alias("dst")).agg(F.count("*").alias("sites"), F.count_distinct("src").alias("sources"))


@query
def g_call_resolution(spark, d):
    return metrics.call_resolution(linking.materialise_proxies(P.web(spark, d)))


@query
def g_unresolved_by_callee(spark, d):
    return metrics.unresolved_by_callee(linking.materialise_proxies(P.web(spark, d)))


@query
def g_resolution_by_target(spark, d):
    out = metrics.by_target(P.graph(spark, d).edges.where("kind = 'calls' and dst like 'supplier:%'"))
    return out.select("dst", "sites", "sources", "name")


@query
def g_proxy_materialise(spark, d):
    return linking.proxy_ids(P.links(spark, d).select(F.col("dst").alias("symbol")))


@query
def g_unique_match_link(spark, d):
    parts = P.table(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"))
    refs = P.table(spark, d, "part").select(F.col("p_name").alias("ref"), F.col("p_partkey"))
    return linking.unique_matches(refs, parts).select("p_partkey", "node_id", "confidence")


@query
def g_tiered_match(spark, d):
    n = P.table(spark, d, "nation")
    index = n.select(F.col("n_name").alias("name"), F.col("n_name").alias("id")).unionByName(n.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("name"), F.col("n_name").alias("id")))
    refs = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ref_id"), F.array(F.array(F.concat(F.lit("r"), F.col("s_suppkey") % 40)), F.array(F.element_at(F.split("s_name", "#"), -1), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 30))).alias("tiers"))
    return linking.tiered_matches(refs, index)


@query
def g_complexity_hotspots(spark, d):
    return metrics.hotspots(P.graph(spark, d).nodes, 10).select("id", "cc")


@query
def g_complexity_bands(spark, d):
    return P.graph(spark, d).nodes.where("cc is not null").groupBy("kind", metrics.band(F.col("cc")).alias("band")).agg(F.count("*").alias("n"))


@query
def g_interval_stab(spark, d):
    spans = cut(P.address_space(spark, d))
    total = spans.agg(F.max("end").alias("total"))
    probes = P.table(spark, d, "events").select("event_id").join(total).select("event_id", (F.col("event_id") * 997 % F.col("total")).alias("at"))
    return intervals.stab(probes, spans).select("event_id", "doc_id")


def _spans(spark, d):
    """Lines of an order as closed spans of 'source lines' in the supplier's file."""
    return P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 5000).alias("s"), (F.col("l_partkey") % 5000 + F.col("l_quantity").cast("long")).alias("e"))


def _found_in_all_files(spark, d):
    """Events dealt over the files of all suppliers."""
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    return P.table(spark, d, "events").join(files).select("event_id", (F.col("user_id") % F.col("files")).alias("file"), (F.col("event_id") % 5000).alias("at"))


def _overlaps(spark, d):
    found = _found_in_all_files(spark, d).select("event_id", "file", F.col("at").alias("l_start"), (F.col("at") + 3).alias("l_end"))
    units = _spans(spark, d).select("file", "key", "line", F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    return intervals.overlaps(found, units, ["file"])


@query
def g_interval_overlap(spark, d):
    return _overlaps(spark, d).select("event_id", "key", "line")


@query
def g_interval_overlap_whole(spark, d):
    return _overlaps(spark, d).groupBy("event_id").agg(F.count("*").alias("n"))


@query
def g_tightest_owner(spark, d):
    units = _spans(spark, d).select("file", F.concat_ws("/", "key", "line").alias("unit"), F.col("s").alias("start"), (F.col("e") + 1).alias("end"))
    hits = intervals.stab(_found_in_all_files(spark, d), units, on=["file"], width=64)
    return intervals.tightest(hits, ["event_id"], F.col("end") - F.col("start"), [F.col("unit")], "unit")


@query
def g_coalesce_spans(spark, d):
    spans = P.address_space(spark, d).join(P.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return intervals.coalesced(spans, ["lang"])


@query
def g_diff_nodes(spark, d):
    n = P.graph(spark, d).nodes.where("kind = 'function' and id like 'order:%'")
    o = P.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), "o_orderdate", "o_orderpriority")
    n = n.join(o, "id")
    later = n.where("o_orderdate >= '1996-01-01'").withColumn("cc", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("cc") + 1).otherwise(F.col("cc")))
    return diffing.rows(n.where("o_orderdate < '1998-01-01'"), later, "id", ["name", "kind", "cc"])


@query
def g_diff_edges(spark, d):
    e = P.graph(spark, d).edges.where("kind = 'calls' and src like 'order:%'")
    o = P.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("src"), "o_orderdate")
    # Dealt by rows: the grouping of both sides lies as the join does.
    e = e.repartition(tasks(P.table(spark, d, "lineitem")), "src").join(o, "src")
    return diffing.edges(e.where("o_orderdate < '1998-01-01'"), e.where("o_orderdate >= '1996-01-01'"))


@query
def g_diff_entrypoints(spark, d):
    e = P.graph(spark, d).entrypoints
    after = e.where("description <> 'AUTOMOBILE'").withColumn("asset_value", F.when(F.col("asset_value") == "low", "medium").otherwise(F.col("asset_value")))
    return diffing.entrypoints(e, after)


@query
def g_subgraph_induced(spark, d):
    members = P.graph(spark, d).nodes.where("kind = 'function' and cc >= 6").select(F.col("id").alias("node_id"))
    return views.induced(P.graph(spark, d).edges, members, ["calls", "reads"]).groupBy("kind", "confidence").agg(F.count("*").alias("n"))


@query
def g_entrypoint_rules(spark, d):
    from ..operators import entrypoints

    rules = [
        {"layer": 0, "when": "kind = 'function' and cc >= 3", "kind": "user_input", "trust": "trusted_internal", "asset": "low"},
        {"layer": 1, "when": "kind = 'class'", "kind": "api", "trust": "untrusted_external", "asset": "high"},
        {"layer": 1, "when": "id like 'supplier:%'", "kind": "third_party", "trust": "semi_trusted_external", "asset": "medium"},
        {"layer": 3, "when": "name rlike '7$'", "kind": "user_input", "trust": "untrusted_external", "asset": "medium"},
    ]
    return entrypoints.tagged(P.graph(spark, d).nodes, rules).select("node_id", "kind", "trust_level", "asset_value")


@query
def g_annotations_findings(spark, d):
    from ..operators import findings

    li = P.table(spark, d, "lineitem")
    notes = li.where("l_quantity >= 45").select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("node_id"), F.col("l_linenumber").cast("long").alias("seq"), F.when(F.col("l_returnflag") == "R", "finding").otherwise("audit_note").alias("kind"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("description"), F.lit("import").alias("source"))
    return findings.by_node(P.graph(spark, d).having(annotations=notes), None).select("id", "n", "listed")


@query
def g_module_deps(spark, d):
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]*)", 1)
    out = P.links(spark, d).select(host("src").alias("src"), F.when(F.col("dst").startswith("http"), host("dst")).otherwise(host("src")).alias("dst"))
    return views.dependencies(out.withColumn("kind", F.lit("imports")))


@query
def g_containment(spark, d):
    return views.members(P.graph(spark, d).edges)


@query
def g_inherit_closure(spark, d):
    e = P.graph(spark, d).edges.where("kind = 'contains'")
    return traverse.closure(traverse.reversed_edges(e), P.table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("root"), F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("node"))).select("root", "node", F.col("hops").cast("long").alias("hops"))


@query
def g_nearest_owner(spark, d):
    g = P.graph(spark, d)
    return traverse.nearest_owner(g.edges.where("kind = 'contains'"), g.nodes.where("kind = 'namespace'").select("id"))


@query
def g_attack_surface(spark, d):
    out = QueryEngine(P.graph(spark, d)).attack_surface()
    return out.select("node_id", "name", F.col("kind").alias("node_kind"), F.col("entry_kind").alias("kind"), "trust_level", "asset_value")


@query
def g_merge_last_wins(spark, d):
    from ..bundle import last_wins

    n = P.graph(spark, d).nodes.where("id like 'part:%'")
    newer = n.where("cc % 3 = 0").withColumn("cc", F.col("cc") + 100)
    return last_wins(n, newer, "id").select("id", "cc")


@query
def g_overload_ids(spark, d):
    units = P.table(spark, d, "lineitem").select(F.concat(F.lit("m:f"), F.col("l_partkey")).alias("base"), F.col("l_orderkey").alias("start_line"), F.col("l_linenumber").alias("start_col"))
    ids = linking.overload_ids(units).select("id")
    return ids.repartition(tasks(units), "id").groupBy("id").agg(F.count("*").alias("n"))


@query
def g_escaped_symbols(spark, d):
    return P.links(spark, d).select(escaped(F.col("dst")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def _all_functions(spark, d):
    """Parts of a supplier as functions of an image: stretches of the supplier's address space."""
    li = P.table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("artifact"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("node_id"), (F.col("l_orderkey") * 40).alias("start"), (F.col("l_orderkey") * 40 + F.col("l_quantity").cast("long")).alias("end"))


@query
def g_binary_gaps(spark, d):
    functions = _all_functions(spark, d)
    spans = functions.groupBy("artifact").agg(F.lit(0).cast("long").alias("s_start"), F.max("end").alias("s_end"))
    return binaries.gaps(functions, spans)


def _binary_calls(spark, d):
    """Events dealt over all suppliers and the whole address range; of those at one address the first is the instruction."""
    functions = _all_functions(spark, d)
    sizes = P.table(spark, d, "supplier").agg(F.count("*").alias("files")).join(functions.agg(F.max("end").alias("space")))
    found = P.table(spark, d, "events").join(sizes).select("event_id", "event_type", (F.col("user_id") % F.col("files")).alias("artifact"), (F.col("event_id") * 7919 % F.col("space")).alias("address"), (F.col("event_id") * 104_729 % F.col("space")).alias("target"))
    how = F.when(F.col("event_type") == "click", "direct").otherwise("tail")
    found = found.groupBy("artifact", "address").agg(F.min_by("target", "event_id").alias("target"), F.min_by(how, "event_id").alias("how"))
    return binaries.calls_by_owner(found, functions, 64)


@query
def g_binary_calls(spark, d):
    return _binary_calls(spark, d)


@query
def g_binary_calls_whole(spark, d):
    return _binary_calls(spark, d).groupBy("artifact").agg(F.count("*").alias("n"), F.count("dst").alias("resolved"), F.count_distinct("src").alias("callers"))


@query
def g_mapped_spans(spark, d):
    li = P.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey")
    li = li.repartition(tasks(li), "l_suppkey", "l_partkey", "l_linenumber").groupBy("l_suppkey", "l_partkey", "l_linenumber").agg(F.min("l_orderkey").alias("k"))
    none = F.lit(None).cast("int")
    rows = li.select(F.col("l_suppkey").alias("artifact"), F.lit("n").alias("node_id"), F.lit("f").alias("source_path"), (F.col("l_partkey") % 3).cast("int").alias("line"), none.alias("col"), F.lit("g").alias("function"), F.lit(0).alias("inline_depth"), (F.col("k") * 4).alias("start"), (F.col("k") * 4 + 4).alias("end"))
    return binaries.mapped_spans(rows).select("artifact", "line", "start", "end")


@query
def g_diff_fields(spark, d):
    """Which of the compared fields of orders as functions differ once urgent ones gain a branch and open ones are renamed."""
    n = P.graph(spark, d).nodes.where("kind = 'function' and id like 'order:%'")
    o = P.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), "o_orderstatus", "o_orderpriority")
    after = n.join(o, "id").withColumn("cc", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("cc") + 1).otherwise(F.col("cc"))).withColumn("name", F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("open "), "name")).otherwise(F.col("name")))
    return diffing.nodes(GraphBundle(spark, {"nodes": n}), GraphBundle(spark, {"nodes": after})).groupBy("status", "changed").agg(F.count("*").alias("n"))


@query
def g_taint_whole(spark, d):
    """How many low entrypoints reach each supplier, over the whole call graph."""
    return preanalysis.taint_counts(P.graph(spark, d, complexity=False)).where("node like 'supplier:%'")


@query
def g_privilege_boundary_whole(spark, d):
    return preanalysis.privilege_boundaries(P.graph(spark, d, complexity=False)).select("src", "dst", "src_trust", "dst_trust")


@query
def g_bfs_ball_whole(spark, d):
    g = P.graph(spark, d, complexity=False)
    return traverse.ball(views.raw_calls(g), "supplier:1", 2, nodes=g.nodes)


def _program(spark, d):
    """Parts as free functions and suppliers as types of three languages; lines call parts by name, orders name suppliers."""
    speech = lambda key: F.element_at(F.array(F.lit("go"), F.lit("java"), F.lit("kotlin")), (F.col(key) % 3 + 1).cast("int"))
    part, order, supplier = (P.table(spark, d, t) for t in ("part", "orders", "supplier"))
    unit = lambda df, kind, key, name, what: df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.col(name).cast("string").alias("name"), F.lit(what).alias("kind"), speech(key).alias("language"), F.lit("{}").alias("attrs"), F.col(key).cast("long").alias("node_seq"))
    nodes = unit(part, "part", "p_partkey", "p_name", "function").unionByName(unit(order, "order", "o_orderkey", "o_orderkey", "function")).unionByName(unit(supplier, "supplier", "s_suppkey", "s_name", "class"))
    lines = P.table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    # A third of the lines name a part alone, a third through an imported module, a third through some receiver.
    target = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("order:"), F.col("p_name"))).when(F.col("l_linenumber") % 3 == 2, F.concat(F.lit("lib."), F.col("p_name"))).otherwise(F.concat(F.lit("part."), F.col("l_partkey")))
    grade = F.when(F.col("l_returnflag") == "R", "uncertain").otherwise("certain")
    calls = lines.select(F.monotonically_increasing_id().alias("edge_seq"), F.concat(F.lit("order:"), F.col("l_orderkey")).alias("src"), target.alias("dst"), F.lit("calls").alias("kind"), grade.alias("confidence"))
    bases = supplier.select((-F.col("s_suppkey") - 1).alias("edge_seq"), F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("Supplier#"), F.format_string("%09d", F.col("s_suppkey") + 3)).alias("dst"), F.lit("inherits").alias("kind"), F.lit("inferred").alias("confidence"))
    refs = lines.select(F.concat(F.lit("order:"), F.col("l_orderkey")).alias("node_id"), F.lit(0).alias("role"), F.col("l_linenumber").alias("ordinal"), F.concat_ws(".", "l_partkey", "l_suppkey").alias("path"), F.concat(F.lit("Supplier#"), F.format_string("%09d", F.col("l_suppkey"))).alias("name"), F.lit(None).cast("string").alias("module"))
    imports = spark.createDataFrame([(-1 << 40, "order", "part", "imports", "certain")], calls.schema)
    edges = calls.unionByName(bases).unionByName(imports).withColumn("attrs", F.lit("{}"))
    return GraphBundle(spark, {"nodes": nodes, "edges": cut(edges), "type_refs": refs})


@query
def g_cross_file_calls(spark, d):
    return linking.cross_file_calls(_program(spark, d)).edges.where("kind = 'calls'").groupBy("src", "dst", "confidence").agg(F.count("*").alias("n"))


@query
def g_inherit_links(spark, d):
    return linking.inheritance_links(_program(spark, d)).edges.where("kind = 'inherits'").select("src", "dst", "confidence")


@query
def g_type_uses(spark, d):
    return linking.type_uses(_program(spark, d)).edges.where("kind = 'type_uses'").select("src", "dst")


@query
def g_deferred_calls(spark, d):
    """Orders as callables nested in customers; those that the customer calls already get no edge."""
    o = P.table(spark, d, "orders")
    customer, order = F.concat(F.lit("customer:"), F.col("o_custkey")), F.concat(F.lit("order:"), F.col("o_orderkey"))
    nodes = o.select(order.alias("id")).unionByName(o.select(customer.alias("id")).distinct()).select("id", F.col("id").alias("name"), F.lit("function").alias("kind"), F.lit("{}").alias("attrs"))
    held = o.select(customer.alias("src"), order.alias("dst"), F.lit("contains").alias("kind"), F.lit("certain").alias("confidence"), F.col("o_orderkey").alias("edge_seq"))
    called = o.where("o_orderstatus = 'F'").select(customer.alias("src"), order.alias("dst"), F.lit("calls").alias("kind"), F.lit("certain").alias("confidence"), (-F.col("o_orderkey") - 1).alias("edge_seq"))
    out = linking.deferred_calls(GraphBundle(spark, {"nodes": nodes, "edges": held.unionByName(called)}))
    return out.edges.where("kind = 'calls' and confidence = 'uncertain'").select("src", "dst")


@query
def g_tail_calls(spark, d):
    """Jumps from events to the starts of lines, seen as functions of one image a supplier."""
    functions = _all_functions(spark, d).groupBy("artifact", "start").agg(F.min("node_id").alias("node_id"), F.max("end").alias("end")).withColumn("name", F.concat(F.when(F.col("start") % 7 == 0, "part.cold.").otherwise("f."), "node_id"))
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    top = P.table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    jumps = P.table(spark, d, "events").join(files).join(top).select("event_id", (F.col("user_id") % F.col("files")).alias("artifact"), (F.col("event_id") * 7919 % F.col("top") * 40).alias("address"), (F.col("event_id") * 13 % F.col("top") * 40).alias("target"))
    return binaries.tail_calls(jumps, functions).select("artifact", "address", "src", "dst")


@query
def g_stub_links(spark, d):
    """Suppliers' parts as import stubs, parts as the definitions of their names."""
    parts = P.table(spark, d, "part")
    exports = parts.select(F.col("p_name").alias("symbol"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("node_id"))
    stubs = parts.select(F.concat(F.lit("stub:"), F.col("p_partkey")).alias("stub"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name")).alias("symbol"))
    return binaries.stub_links(stubs, exports)


@query
def g_shipped_rules(spark, d):
    """The shipped entrypoint rules over facts made of the lines' columns."""
    from ..operators import entrypoints

    li = P.table(spark, d, "lineitem")
    language = F.element_at(F.array(*[F.lit(x) for x in ("python", "c_sharp", "erlang", "zig")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    mark = F.when(F.col("l_returnflag") == "A", "@app.get('/x')").when(F.col("l_returnflag") == "R", "[HttpPost]").otherwise("")
    head = F.when(F.col("l_linestatus") == "O", "pub export fn f()").otherwise("fn f()")
    exported = F.when(F.col("l_suppkey") % 2 == 0, "true").otherwise("")
    nodes = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_quantity") >= 49, "main").otherwise("f").alias("name"), F.lit("function").alias("kind"), language.alias("language"), F.lit("x/y.z").alias("file_path"), F.to_json(F.struct(mark.alias("decorators"), head.alias("signature"), exported.alias("exported"))).alias("attrs"))
    return entrypoints.tagged(nodes, entrypoints.RULES).select("node_id", "rule", "kind", "trust_level", "asset_value")


@query
def g_scope_lookup(spark, d):
    """Orders look names up outwards: in the customer that holds them, its nation, its region."""
    t = lambda name: P.table(spark, d, name)
    own = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key))
    held = lambda df, kind, key, outer, outer_key: df.select(own(kind, key).alias("node"), own(outer, outer_key).alias("up"))
    parents = held(t("orders"), "order", "o_orderkey", "customer", "o_custkey").unionByName(held(t("customer"), "customer", "c_custkey", "nation", "c_nationkey")).unionByName(held(t("nation"), "nation", "n_nationkey", "region", "n_regionkey"))
    says = lambda df, scope, key, unit: df.select(scope.alias("scope"), F.concat(F.lit("s"), F.col(key) % 40).alias("name"), own(unit, key).alias("id"))
    declared = says(t("customer").where("c_custkey % 3 = 0"), own("customer", "c_custkey"), "c_custkey", "customer")
    declared = declared.unionByName(says(t("supplier"), own("nation", "s_nationkey"), "s_suppkey", "supplier")).unionByName(says(t("nation"), own("region", "n_regionkey"), "n_nationkey", "nation"))
    refs = t("orders").select(F.col("o_orderkey").alias("ref_id"), own("order", "o_orderkey").alias("scope"), F.concat(F.lit("s"), F.col("o_orderkey") % 40).alias("name"))
    return scopes.lookup(refs, parents, declared)


@query
def g_visible_calls(spark, d):
    """Lines call units of suppliers by name; units of internal linkage are seen through imports, which run in cycles."""
    li = P.table(spark, d, "lineitem")
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    module = F.concat(F.lit("supplier:"), F.col("l_suppkey"))
    imports = li.where("l_quantity >= 47 and l_linenumber = 1 and l_returnflag <> 'N'").join(files).select(module.alias("src"), F.concat(F.lit("supplier:"), F.col("l_orderkey") % F.col("files")).alias("dst"))
    units = li.select(module.alias("module"), F.concat(F.lit("f"), F.col("l_partkey") % 400).alias("name"), F.concat(module, F.lit("/f"), F.col("l_partkey") % 400).alias("id"), (F.col("l_partkey") % 400 >= 20).alias("internal")).distinct()
    refs = li.select(module.alias("module"), F.concat(F.lit("f"), F.col("l_orderkey") * 7 % 400).alias("name")).distinct().withColumn("ref_id", F.concat_ws(">", "module", "name"))
    return visibility.matches(refs, units, imports)


@query
def g_module_sight(spark, d):
    """How many suppliers each supplier sees over the same imports, by components."""
    li = P.table(spark, d, "lineitem")
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    module = F.concat(F.lit("supplier:"), F.col("l_suppkey"))
    imports = li.where("l_quantity >= 47 and l_linenumber = 1 and l_returnflag <> 'N'").join(files).select(module.alias("src"), F.concat(F.lit("supplier:"), F.col("l_orderkey") % F.col("files")).alias("dst"))
    seen = visibility.sight(imports, P.table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("module")))
    sizes = seen.member.groupBy(F.col("component").alias("target")).agg(F.count("*").alias("size"))
    return seen.member.where("module like 'supplier:%'").join(seen.pairs, "component").join(sizes, "target").groupBy("module", "component").agg(F.sum("size").alias("n"))


@query
def g_export_tables(spark, d):
    """Names of parts exported by suppliers: declared, passed on under other names, or re-exported whole."""
    li, part = P.table(spark, d, "lineitem"), P.table(spark, d, "part")
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    called = lambda key: F.concat(F.lit("p"), key % 50)
    place = lambda key: F.concat(F.lit("m"), key % F.col("files"))
    declared = part.where("p_size > 44").join(files).select(place(F.col("p_partkey")).alias("module"), called(F.col("p_partkey") * 3).alias("name"), F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"))
    aliases = li.where("l_linenumber = 2 and l_quantity >= 45").join(files).select(place(F.col("l_suppkey")).alias("module"), called(F.col("l_partkey")).alias("name"), place(F.col("l_orderkey")).alias("to_module"), called(F.col("l_orderkey") * 11).alias("to_name"))
    supplier = P.table(spark, d, "supplier").join(files)
    stars = supplier.where("s_suppkey % 3 <> 0").select(place(F.col("s_suppkey")).alias("module"), place(F.col("s_suppkey") * 7 + 1).alias("to_module")).unionByName(supplier.where("s_suppkey % 4 = 0").select(place(F.col("s_suppkey")).alias("module"), place(F.col("s_suppkey") * 5 + 2).alias("to_module")))
    requests = li.join(files).select(place(F.col("l_suppkey")).alias("module"), called(F.col("l_partkey")).alias("name")).distinct()
    return exports.resolved(requests, declared, aliases, stars)


@query
def g_nearest_declaration(spark, d):
    """Customers derive from two others each, which makes diamonds; their orders declare names with signatures."""
    own = lambda key: F.concat(F.lit("customer:"), key)
    c, o = P.table(spark, d, "customer"), P.table(spark, d, "orders")
    parents = F.explode(F.array_distinct(F.array(F.floor(F.col("c_custkey") / 2).cast("long"), F.floor(F.col("c_custkey") / 3).cast("long"))))
    bases = c.where("c_custkey > 3").select(own(F.col("c_custkey")).alias("src"), parents.alias("up")).select("src", own(F.col("up")).alias("dst"))
    called = lambda key: F.concat(F.lit("n"), key % 5)
    methods = o.where("o_orderkey % 4 = 0").select(own(F.col("o_custkey")).alias("type"), called(F.col("o_orderkey") / 4).alias("name"), F.col("o_orderpriority").alias("signature"), F.concat(F.lit("order:"), F.col("o_orderkey")).alias("id"), (F.col("o_orderstatus") != "F").alias("inheritable"))
    methods = methods.withColumn("name", F.regexp_replace("name", r"\.0$", ""))
    asked = o.where("o_orderkey % 3 = 0").select(own(F.col("o_custkey")).alias("type"), called(F.col("o_orderkey")).alias("name")).distinct()
    states = c.where("c_custkey % 97 = 5").select(own(F.col("c_custkey")).alias("type"), called(F.col("c_custkey")).alias("name"))
    known = c.where("c_custkey % 89 <> 3").select(own(F.col("c_custkey")).alias("type"))
    return inheritance.nearest(asked, bases, methods, states, known)


@query
def g_mapping_overlay(spark, d):
    """Lines as mappings of their suppliers' images from three sources; every address belongs to the first source that has it."""
    start = (F.col("l_partkey") * 13 + F.col("l_orderkey")) % 50_000
    source = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    spans = P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("artifact"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 3).alias("end"), source.alias("source"))
    return overlay.overlay(spans, ["artifact"], 3)


@query
def g_scan_spans(spark, d):
    """Lines as selected spans, cut where other columns of the lines mark a change of mode."""
    li = P.table(spark, d, "lineitem")
    base = F.col("l_orderkey") * 100
    spans = li.groupBy("l_suppkey", "l_orderkey").agg(F.min(F.col("l_quantity").cast("long")).alias("q")).select(F.col("l_suppkey").alias("artifact"), base.alias("start"), (base + 40 + F.col("q")).alias("end"), F.when(F.col("l_orderkey") % 7 == 0, "thumb").alias("mode"))
    marks = li.select(F.col("l_suppkey").alias("artifact"), (base + F.col("l_partkey") % 60).alias("at"), F.when(F.col("l_returnflag") == "R", "data").when(F.col("l_returnflag") == "N", "thumb").otherwise("arm").alias("mode"))
    return overlay.scan_spans(spans, marks, "arm")


@query
def g_pc_relative(spark, d):
    """Words made of lines: those of odd numbers add to the program counter, the next ones jump."""
    li = P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.repartition(tasks(li), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    artifact, odd = F.col("l_orderkey") % 7, F.col("l_linenumber") % 2 == 1
    register = F.col("l_orderkey") % 32
    wide, low = F.col("l_partkey") * 7919 % (1 << 20), F.col("l_partkey") * 31 % 4096
    risc = F.when(odd, F.shiftleft(wide, 12) + F.shiftleft(register, 7) + 0x17).otherwise(F.shiftleft(low, 20) + F.shiftleft(F.when(F.col("l_suppkey") % 9 == 0, 3).otherwise(register).cast("long"), 15) + F.lit(0x67 + 128))
    loong = F.when(odd, F.lit(0x1E000000) + F.shiftleft(wide, 5) + register).otherwise(F.lit(0x4C000000) + F.shiftleft(low * 16, 10) + F.shiftleft(register, 5) + 1)
    word = F.lpad(F.hex(F.when(artifact % 2 == 0, risc).otherwise(loong).cast("long")), 8, "0")
    little = artifact % 3 != 0
    swapped = F.concat(*[F.substring(word, k, 2) for k in (7, 5, 3, 1)])
    none = F.lit(None).cast("long")
    rows = li.select(artifact.alias("artifact"), F.when(artifact % 2 == 0, "riscv64").otherwise("loongarch64").alias("architecture"), F.when(little, "little").otherwise("big").alias("byte_order"), (F.col("l_orderkey") * 32 + F.col("l_linenumber") * 4).alias("address"), F.when(F.col("l_quantity") == 7, 2).otherwise(4).alias("size"), F.when(little, swapped).otherwise(word).alias("bytes"), F.when(odd, "none").otherwise("indirect").alias("how"), none.alias("target"))
    return binaries.pc_relative(rows).where("how = 'pc_relative'").select("artifact", "address", "target")


@query
def g_longest_prefix(spark, d):
    """Links of pages under the longest of many prefixes of pages; a prefix with two values gives none."""
    pages = P.table(spark, d, "pages")
    host = F.regexp_extract("url", r"^(https?://[^/]*)", 1)
    folder = F.regexp_replace("url", r"/[^/]*$", "")
    value = F.concat(F.lit("v"), F.col("page_id") % 3)
    table = pages.where("page_id % 17 = 0").select(host.alias("prefix"), F.lit("host").alias("value")).unionByName(pages.where("page_id % 3 = 0").select(folder.alias("prefix"), value.alias("value"))).unionByName(pages.where("page_id % 5 = 0").select(F.col("url").alias("prefix"), value.alias("value")))
    paths = P.links(spark, d).select(F.concat("src", F.when(F.col("dst").startswith("/"), F.col("dst")).otherwise(F.concat(F.lit("/"), "dst"))).alias("path"))
    return prefixes.longest(paths, table)


def _certain(spark, d, complexity=True):
    """The whole graph with the calls that are certain."""
    g = P.graph(spark, d, complexity)
    return g.having(edges=g.edges.where("confidence = 'certain'"))


@query
def g_blast_radius_whole(spark, d):
    """What each node reaches, and is reached by, over all certain calls."""
    g = _certain(spark, d, complexity=False)
    return preanalysis.blast_radius(views.raw_calls(g), g.nodes, within=True)


@query
def g_top_critical_whole(spark, d):
    """Of what each class reaches over all certain calls the five most complex."""
    g = _certain(spark, d)
    return preanalysis.critical(views.projected(g), g.nodes).where("root like 'customer:%'")


@query
def g_value_flow(spark, d):
    """Orders bind three names of their customers (and one of nations) to parts, to each other, or to something unknown; lines use them."""
    o, li, c = P.table(spark, d, "orders"), P.table(spark, d, "lineitem"), P.table(spark, d, "customer")
    name = lambda key: F.concat(F.lit("v"), key % 4)
    holder = F.concat(F.lit("customer:"), F.col("o_custkey"))
    kind = F.when(F.col("o_orderkey") % 5 < 2, "callable").when(F.col("o_orderkey") % 5 < 4, "name").otherwise("other")
    value = F.when(kind == "callable", F.concat(F.lit("part:"), F.col("o_orderkey") % 7)).otherwise(name(F.col("o_orderkey") * 3 + 1))
    bound = o.select(holder.alias("scope"), F.col("o_orderkey").alias("position"), name(F.col("o_orderkey")).alias("name"), kind.alias("kind"), value.alias("value"), (F.col("o_orderpriority") != "1-URGENT").alias("always")).where("name <> 'v3'")
    outer = c.where("c_custkey % 29 = 0").select(F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("scope"), F.col("c_custkey").alias("position"), F.lit("v3").alias("name"), F.lit("callable").alias("kind"), F.concat(F.lit("part:"), F.col("c_custkey") % 3).alias("value"), (F.col("c_custkey") % 2 == 0).alias("always"))
    parents = c.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("node"), F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("up"))
    # Grouped by the columns of the key: lines are dealt once, for the join.
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(F.min("o_custkey").alias("o_custkey"), F.min(F.col("l_partkey") % 4).alias("k"))
    uses = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("use_id"), holder.alias("scope"), F.col("l_orderkey").alias("position"), F.concat(F.lit("v"), "k").alias("name"))
    return valueflow.arriving(bound.unionByName(outer), uses, parents)


@query
def g_formal_links(spark, d):
    """Lines refer from their part to symbols that parts declare in modules, in two tiers; each line stands in an argument of the one before it."""
    li, part = P.table(spark, d, "lineitem"), P.table(spark, d, "part")
    files = P.table(spark, d, "supplier").agg(F.count("*").alias("files"))
    module = lambda key: F.concat(F.lit("supplier:"), key % F.col("files"))
    called = lambda key: F.concat(F.lit("s"), key)
    imports = li.where("l_quantity >= 49 and l_linenumber = 1 and l_returnflag <> 'N'").join(files).select(module(F.col("l_suppkey")).alias("src"), module(F.col("l_orderkey")).alias("dst"))
    own = F.concat(F.lit("part:"), F.col("p_partkey")).alias("id")
    ghosts = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("a1"))).otherwise(F.array().cast("array<string>"))
    symbols = part.join(files).select(own, module(F.col("p_partkey")).alias("module"), called(F.col("p_partkey") * 7 % 300).alias("name"), (F.col("p_size") % 3 == 0).alias("signature"), (F.col("p_size") % 5 == 0).alias("private"), (F.col("p_size") % 7 != 0).alias("executable"), ghosts.alias("ghosts"))
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("flag")).join(files)
    key = lambda k: F.concat_ws("/", "l_orderkey", k)
    before = key(F.col("l_linenumber") - 1)
    tiers = F.array(F.array(called(F.col("l_orderkey") % 450), called(F.col("s") * 3 % 450)), F.array(called(F.col("l_orderkey") * 7 % 300)))
    context = F.when(F.col("flag") == "A", "body").when(F.col("flag") == "N", "argument").otherwise("proof")
    refs = lines.select(key("l_linenumber").alias("ref_id"), F.concat(F.lit("part:"), F.col("p")).alias("src"), module(F.col("p")).alias("module"), tiers.alias("tiers"), (F.col("p") % 11 != 0).alias("application"), context.alias("context"), before.alias("enclosing"))
    arguments = lines.select(key("l_linenumber").alias("scope"), before.alias("up"), key("l_linenumber").alias("callee"), F.concat(F.lit("a"), F.col("l_linenumber") % 2).alias("argument"))
    return formal.linked(refs, symbols, imports, arguments, lenient=True)

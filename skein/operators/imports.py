"""Adding declared links and binary call graphs to a bundle."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from ..functions.text import digest, escaped, identifier
from . import binaries, intervals

EXTERNAL = "proxy.external:"


def link(graph: GraphBundle, links: DataFrame) -> GraphBundle:
    """Declared links as edges. An end is an id, or else a name (or suffix after ':' or '.') that one node has.

    An end that none has is an error unless it is declared external (then a proxy);
    one that several have is an error. Either all links are added or none.
    """
    links = cut(links.withColumn("n", F.monotonically_increasing_id()))
    ends = links.select("n", F.lit("src").alias("side"), F.col("source").alias("ref"), F.col("source_external").alias("external")).unionByName(links.select("n", F.lit("dst").alias("side"), F.col("target").alias("ref"), F.col("target_external").alias("external")))
    keys = graph.nodes.where("kind <> 'proxy'").select("id", F.explode(F.array_distinct(F.array(F.col("name"), F.element_at(F.split("id", ":"), -1), F.element_at(F.split("id", r"\."), -1)))).alias("ref"))
    exact = ends.join(graph.nodes.select("id", F.col("id").alias("ref")), "ref").select("n", "side", "id")
    loose = ends.join(keys, "ref").groupBy("n", "side").agg(F.count_distinct("id").alias("hits"), F.min("id").alias("loose"))
    found = cut(ends.join(exact, ["n", "side"], "left").join(loose, ["n", "side"], "left"))
    wrong = found.where("id is null and ((hits is null and not external) or hits > 1)").limit(1).collect()
    if wrong:
        raise ValueError(f"link end {wrong[0]['ref']!r} is " + ("ambiguous" if wrong[0]["hits"] else "unknown"))
    proxy = F.concat(F.lit(EXTERNAL), escaped(F.col("ref")))
    bound = found.select("n", "side", "ref", F.coalesce("id", "loose", proxy).alias("end"), (F.col("id").isNull() & F.col("loose").isNull()).alias("new"))
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    high = nodes.agg(F.max("node_seq")).first()[0] or 0
    made = bound.where("new").groupBy(F.col("end").alias("id")).agg(F.min("ref").alias("name")).join(nodes.select("id"), "id", "left_anti")
    made = made.select("id", "name", F.lit("proxy").alias("kind"), F.lit("proxy").alias("origin"), (F.lit(high + 1) + F.monotonically_increasing_id()).alias("node_seq"), F.to_json(F.struct(F.lit("external").alias("proxy_kind"), F.col("name").alias("raw_symbol"))).alias("attrs"))
    sides = bound.groupBy("n").pivot("side", ["src", "dst"]).agg(F.first("end"))
    fresh = links.join(sides, "n").select("src", "dst", "kind", "confidence", F.to_json(F.struct(F.lit(True).alias("declared"), "description")).alias("attrs")).distinct()
    fresh = fresh.join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    top = edges.agg(F.max("edge_seq")).first()[0] or 0
    fresh = fresh.withColumn("edge_seq", F.lit(top + 1) + F.monotonically_increasing_id())
    return graph.having(nodes=nodes.unionByName(GraphBundle.conform(cut(made), "nodes")), edges=edges.unionByName(GraphBundle.conform(cut(fresh), "edges")))


def binary(graph: GraphBundle, text: str, connect: bool = True) -> GraphBundle:
    """Add a call graph of a binary (artifact, functions, calls), and connect functions with their sources."""
    data = json.loads(text)
    if not isinstance(data, dict) or not isinstance(data.get("functions"), list):
        raise ValueError("not a binary call graph: functions is missing")
    spark, artifact = graph.spark, data.get("artifact") or {}
    key = artifact.get("key") or artifact.get("name") or "binary"
    number = lambda v: None if v is None else Decimal(int(v, 0) if isinstance(v, str) else int(v))
    rows = []
    for k, f in enumerate(data["functions"]):
        address, source = number(f.get("address")), f.get("source") or {}
        rows.append((k, str(f.get("id") or f.get("symbol") or f.get("name") or k), f.get("symbol") or f.get("name"), address, number(f.get("size")), f.get("section"), source.get("node_id"), source.get("symbol"), source.get("file"), source.get("line")))
    functions = spark.createDataFrame(rows, "n long, ref string, symbol string, address decimal(20,0), size decimal(20,0), section string, node_id string, source_symbol string, source_file string, source_line int")
    name = F.coalesce(identifier(F.col("symbol")), F.concat(F.lit("sub_"), F.lower(F.conv(F.col("address").cast("string"), 10, 16))), F.col("ref"))
    functions = functions.withColumn("plain", F.concat(F.lit(f"bin.{key}:"), name))
    twice = F.count("*").over(Window.partitionBy("plain")) > 1
    functions = cut(functions.withColumn("id", F.when(twice, F.concat("plain", F.lit("__"), digest(F.col("ref"), 8))).otherwise(F.col("plain"))))
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    high, top = nodes.agg(F.max("node_seq")).first()[0] or 0, edges.agg(F.max("edge_seq")).first()[0] or 0
    made = functions.select("id", F.coalesce("symbol", "ref").alias("name"), F.lit("function").alias("kind"), F.lit("binary").alias("origin"), (F.lit(high + 1) + F.col("n")).alias("node_seq"), F.to_json(F.struct(F.lit(key).alias("artifact"), F.col("address").cast("string").alias("address"))).alias("attrs"))
    calls = spark.createDataFrame([(k, str(c.get("source")), str(c.get("target")), c.get("confidence") or "certain", c.get("kind") or "direct") for k, c in enumerate(data.get("calls") or [])], "n long, source string, target string, confidence string, how string")
    # A reference that several functions answer to stays unresolved.
    keys = functions.select("id", F.explode(F.array_distinct(F.array_compact(F.array("ref", "symbol", F.col("address").cast("string"))))).alias("k")).groupBy("k").agg(F.count_distinct("id").alias("c"), F.min("id").alias("id")).where("c = 1").select("k", "id")
    bound = calls.join(keys.select(F.col("k").alias("source"), F.col("id").alias("src")), "source").join(keys.select(F.col("k").alias("target"), F.col("id").alias("to")), "target", "left")
    bound = bound.withColumn("dst", F.coalesce("to", F.concat(F.lit(EXTERNAL), escaped(F.col("target"))))).withColumn("confidence", F.when(F.col("to").isNull(), "uncertain").otherwise(F.col("confidence")))
    outside = bound.where("to is null").select(F.col("dst").alias("id"), F.col("target").alias("name")).groupBy("id").agg(F.min("name").alias("name")).join(nodes.select("id"), "id", "left_anti")
    outside = outside.select("id", "name", F.lit("proxy").alias("kind"), F.lit("proxy").alias("origin"), (F.lit(high + 1 + len(rows)) + F.monotonically_increasing_id()).alias("node_seq"), F.lit('{"proxy_kind":"external"}').alias("attrs"))
    added = bound.select("src", "dst", F.lit("calls").alias("kind"), "confidence", (F.lit(top + 1) + F.col("n")).alias("edge_seq"), F.to_json(F.struct(F.lit(key).alias("artifact"), "how")).alias("attrs"))
    if connect:
        pairs = corresponding(functions, nodes).withColumns({"kind": F.lit("corresponds_to"), "confidence": F.lit("inferred"), "edge_seq": F.lit(top + 1 + len(data.get("calls") or [])) + F.monotonically_increasing_id()})
        added = GraphBundle.conform(added, "edges").unionByName(GraphBundle.conform(pairs, "edges"))
    base = int(number(artifact.get("image_base")) or 0)
    ranges = functions.where("address is not null").select(F.lit(key).alias("artifact"), F.col("id").alias("node_id"), F.col("address").alias("start"), (F.col("address") + F.coalesce("size", F.lit(1))).alias("end"), (F.col("address") - F.lit(base).cast("decimal(20,0)")).alias("rva"), "section")
    info = spark.createDataFrame([(key, artifact.get("name"), artifact.get("architecture"), artifact.get("hash"), artifact.get("path"))], "id string, name string, architecture string, sha256 string, path string")
    more = GraphBundle(spark, {"binary_artifacts": GraphBundle.conform(info, "binary_artifacts")})
    if not graph.binary_artifacts.where((F.col("id") == key) & ~F.col("sha256").eqNullSafe(F.lit(artifact.get("hash")))).isEmpty():
        raise ValueError(f"binary artifact {key} is there already and differs")
    fresh = GraphBundle.conform(made, "nodes").unionByName(GraphBundle.conform(outside, "nodes")).join(nodes.select("id"), "id", "left_anti")
    known = GraphBundle.conform(graph.binary_artifacts, "binary_artifacts").unionByName(more.binary_artifacts)
    wrong = binaries.violations(known, GraphBundle.conform(ranges, "binary_ranges"), graph.binary_mappings.where("false"), nodes.select("id").unionByName(fresh.select("id"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['what']}: {wrong[0]['key']}")
    return graph.having(
        nodes=cut(nodes.unionByName(GraphBundle.conform(fresh, "nodes"))), edges=cut(edges.unionByName(GraphBundle.conform(added, "edges"))),
        binary_artifacts=GraphBundle.conform(graph.binary_artifacts, "binary_artifacts").unionByName(more.binary_artifacts).dropDuplicates(["id"]),
        binary_ranges=GraphBundle.conform(graph.binary_ranges, "binary_ranges").unionByName(GraphBundle.conform(ranges, "binary_ranges")).distinct(),
    )


def mapping(graph: GraphBundle, text: str) -> GraphBundle:
    """Add explicit mappings (sha256, mappings: source_node_id, start, end, address_kind) of the artifact with that digest.

    Each becomes a range and a mapping of its source unit; an unknown artifact or unit, an empty span or an unknown
    kind of address is an error, and nothing is added then.
    """
    data = json.loads(text)
    spans = data.get("mappings") if isinstance(data, dict) else None
    if not isinstance(spans, list):
        raise ValueError("not a mapping: mappings is missing")
    artifact = graph.binary_artifacts.where(F.col("sha256") == data.get("sha256")).select("id", "image_base").first() if not graph.binary_artifacts.isEmpty() else None
    if artifact is None:
        raise ValueError(f"no artifact has the digest {data.get('sha256')}")
    base, rows = int(artifact["image_base"] or 0), []
    for s in spans:
        kind = s.get("address_kind", "va")
        if kind not in ("va", "rva"):
            raise ValueError(f"unknown address kind {kind}")
        start, end = (int(x, 0) if isinstance(x, str) else int(x) for x in (s["start"], s["end"]))
        shift = base if kind == "rva" else 0
        rows.append((artifact["id"], s["source_node_id"], Decimal(start + shift), Decimal(end + shift), Decimal(start + shift - base)))
    found = graph.spark.createDataFrame(rows, "artifact string, node_id string, start decimal(20,0), end decimal(20,0), rva decimal(20,0)")
    units = GraphBundle.conform(graph.nodes, "nodes").select(F.col("id").alias("node_id"), F.col("file_path").alias("source_path"), F.col("start_line").alias("line"), F.col("name").alias("function"))
    ranges = GraphBundle.conform(graph.binary_ranges, "binary_ranges").unionByName(GraphBundle.conform(found, "binary_ranges")).distinct()
    fresh = GraphBundle.conform(found.join(units, "node_id", "left").withColumn("inline_depth", F.lit(0)), "binary_mappings")
    wrong = binaries.violations(graph.binary_artifacts, GraphBundle.conform(found, "binary_ranges"), fresh, graph.nodes).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['what']}: {wrong[0]['key']}")
    return graph.having(binary_ranges=cut(ranges), binary_mappings=cut(GraphBundle.conform(graph.binary_mappings, "binary_mappings").unionByName(fresh).distinct()))


def corresponding(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): each function's source: by id, by unique symbol, or by the tightest unit at its file and line."""
    units = nodes.where("origin = 'source'")
    by_id = functions.join(units.select(F.col("id").alias("node_id")), "node_id").select("id", F.col("node_id").alias("to"), F.lit(0).alias("rank"))
    keys = units.select(F.col("id").alias("to"), F.explode(F.array_distinct(F.array(F.col("name"), F.col("id"), F.element_at(F.split("id", ":"), -1)))).alias("k"))
    wanted = F.coalesce("source_symbol", "symbol")
    by_name = functions.select("id", wanted.alias("k")).join(keys, "k").groupBy("id").agg(F.count_distinct("to").alias("c"), F.min("to").alias("to")).where("c = 1").select("id", "to", F.lit(1).alias("rank"))
    points = functions.where("source_line is not null").select("id", F.col("source_file").alias("file"), F.col("source_line").cast("long").alias("at"))
    spans = units.where("start_line is not null and kind in ('function', 'method')").select(F.col("file_path").alias("file"), F.col("id").alias("to"), F.col("start_line").cast("long").alias("start"), (F.col("end_line") + 1).cast("long").alias("end"))
    by_line = intervals.tightest(intervals.stab(points, spans, on=["file"], width=64), ["id"], F.col("end") - F.col("start"), [F.col("to")], "to").select("id", "to", F.lit(2).alias("rank"))
    best = by_id.unionByName(by_name).unionByName(by_line).groupBy("id").agg(F.min_by("to", "rank").alias("to"))
    return best.select(F.col("id").alias("src"), F.col("to").alias("dst"))


def source_at(graph: GraphBundle, artifact: str, address: int, kind: str = "va") -> DataFrame:
    """Mappings (or else ranges) of an artifact at an address; an ambiguous file offset is an error."""
    columns = {"va": "start", "rva": "rva", "file_offset": "file_offset"}
    if kind not in columns:
        raise ValueError(f"unknown address kind {kind}")
    begin = F.col(columns[kind])
    at = F.lit(address).cast("decimal(20,0)")
    own = graph.binary_mappings.where((F.col("artifact") == artifact) & (begin <= at) & (at < begin + F.col("end") - F.col("start")))
    if kind == "file_offset" and own.select("start").distinct().count() > 1:
        raise ValueError(f"file offset {address} is ambiguous")
    return own.orderBy("start", "inline_depth", "source_path", "line")


def coalesced_ranges(graph: GraphBundle, node_id: str, artifact: str | None = None, line: int | None = None) -> DataFrame:
    """Ranges of a node; with a line the touching mapped spans of that line as one."""
    if line is None:
        out = graph.binary_ranges.where(F.col("node_id") == node_id)
        return out if artifact is None else out.where(F.col("artifact") == artifact)
    own = graph.binary_mappings.where((F.col("node_id") == node_id) & (F.col("line") == line))
    own = own if artifact is None else own.where(F.col("artifact") == artifact)
    return intervals.coalesced(own.select("artifact", "source_path", "start", "end"), ["artifact", "source_path"])

"""Places that may start code: references from declarative files and from callables passed as values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from . import intervals


def _normal(column):
    return F.regexp_replace(column, r"::|:|\\\\|/", ".")


def qualified_index(nodes: DataFrame) -> DataFrame:
    """(key, id): the normalised id of each callable or type and all its suffixes of two parts or more; never a bare name."""
    parts = F.split(_normal(F.col("id")), r"\.")
    own = nodes.where("origin = 'source' and kind in ('function', 'method', 'class')").select("id", parts.alias("p")).where(F.size("p") >= 2)
    keys = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", k, F.size("p")), "."))
    return own.select("id", F.explode(keys).alias("key"))


def discover(graph: GraphBundle, literals: DataFrame) -> GraphBundle:
    """Evidence and ``references`` edges for ``literals`` (file, line, literal) that name code; no node is tagged.

    A literal that one node answers to gives a resolved reference and an edge from the file's node; one
    that several answer to is evidence without a node. Running it again changes nothing.
    """
    named = literals.withColumn("key", _normal(F.col("literal"))).where("key like '%.%'")
    hits = named.join(qualified_index(graph.nodes), "key").groupBy("file", "line", "literal").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    found = cut(hits.withColumn("node_id", F.when(F.col("n") == 1, F.col("only"))))
    source = F.concat(F.lit("@source:"), F.col("file"))
    evidence = found.select(
        F.concat(F.lit("entrypoint:"), F.substring(F.sha2(F.to_json(F.struct("file", "line", "literal")), 256), 1, 24)).alias("evidence_id"), "node_id", F.lit("reference").alias("basis"), F.lit("declarative-reference").alias("rule"),
        F.col("file").alias("file_path"), F.col("line").alias("start_line"), source.alias("source_id"), F.col("literal").alias("symbol"), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("binding"),
    )
    known = graph.evidence.select("evidence_id")
    fresh = GraphBundle.conform(evidence.join(known, "evidence_id", "left_anti"), "evidence")
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    bound = found.where("node_id is not null").withColumn("src", source)
    top, high = edges.agg(F.max("edge_seq")).first()[0] or 0, nodes.agg(F.max("node_seq")).first()[0] or 0
    links = bound.select("src", F.col("node_id").alias("dst"), F.lit("references").alias("kind"), F.lit("inferred").alias("confidence"), F.col("file").alias("file_path"), F.col("line").alias("start_line"))
    links = links.join(edges.select("src", "dst", "kind", "start_line"), ["src", "dst", "kind", "start_line"], "left_anti").withColumn("edge_seq", F.lit(top + 1) + F.monotonically_increasing_id())
    files = bound.select(F.col("src").alias("id"), F.col("file").alias("name"), F.col("file").alias("file_path")).distinct().join(nodes.select("id"), "id", "left_anti")
    files = files.withColumns({"kind": F.lit("module"), "origin": F.lit("synthetic"), "node_seq": F.lit(high + 1) + F.monotonically_increasing_id(), "attrs": F.lit("{}")})
    return graph.having(nodes=cut(nodes.unionByName(GraphBundle.conform(files, "nodes"))), edges=cut(edges.unionByName(GraphBundle.conform(links, "edges"))), evidence=cut(GraphBundle.conform(graph.evidence, "evidence").unionByName(fresh)))


def tightest_owners(literals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, line, literal, id): the smallest source unit that holds each literal's line."""
    units = nodes.where("origin = 'source' and start_line is not null").select(F.col("file_path").alias("file"), "id", F.col("start_line").cast("long").alias("start"), (F.col("end_line") + 1).cast("long").alias("end"))
    hits = intervals.stab(literals.withColumn("at", F.col("line").cast("long")), units, on=["file"], width=64)
    return intervals.tightest(hits, ["file", "line", "literal"], F.col("end") - F.col("start"), [F.col("id")], "id")


def value_references(graph: GraphBundle, values: DataFrame) -> GraphBundle:
    """``references`` edges for callables passed as values: ``values`` (src, name); several of a name in reach give none."""
    index = graph.nodes.where("kind in ('function', 'method')").select("name", "id")
    hits = values.join(index, "name").groupBy("src", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1 and src <> dst")
    edges = GraphBundle.conform(graph.edges, "edges")
    top = edges.agg(F.max("edge_seq")).first()[0] or 0
    made = hits.select("src", "dst").distinct().join(edges.where("kind = 'references'").select("src", "dst"), ["src", "dst"], "left_anti")
    made = made.withColumns({"kind": F.lit("references"), "confidence": F.lit("inferred"), "edge_seq": F.lit(top + 1) + F.monotonically_increasing_id()})
    return graph.having(edges=edges.unionByName(GraphBundle.conform(cut(made), "edges")))

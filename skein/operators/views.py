"""Projections of the edges by kind, and one-hop neighbours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..schema import checked_kinds


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids.withColumnRenamed("id", "id_"), F.col("dst") == F.col("id_"), "left_semi")


def projected(graph: GraphBundle, kinds: Iterable[str] | None = None) -> DataFrame:
    """Distinct (src, dst) of the kinds, both ends existing; no kinds named means calls, an empty list no edges. Self-loops stay."""
    wanted = ("calls",) if kinds is None else checked_kinds(kinds)
    chosen = graph.edges.where(F.col("kind").isin(*wanted) if wanted else F.lit(False))
    # Distinct last: rows are then dealt by one end already.
    return linked(chosen.select("src", "dst"), graph.nodes).distinct()


def call_edges(graph: GraphBundle) -> DataFrame:
    return linked(graph.edges.where("kind = 'calls'"), graph.nodes)


def raw_calls(graph: GraphBundle) -> DataFrame:
    """(src, dst) of all calls as they are stored, for walks that look whether what they reach exists."""
    return graph.edges.where("kind = 'calls'").select("src", "dst")


def neighbours(graph: GraphBundle, node_id: str, kind: str, forward: bool) -> DataFrame:
    """Distinct nodes one edge of a kind away (the node itself on a self-loop)."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    hits = graph.edges.where((F.col("kind") == kind) & (F.col(near) == node_id)).select(F.col(far).alias("id"))
    return graph.nodes.join(hits, "id", "left_semi")


def degrees(graph: GraphBundle, kinds: Iterable[str] | None = None) -> DataFrame:
    """(id, n_out, n_in) of distinct neighbours, for all nodes at once."""
    proj = projected(graph, kinds)
    both = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = proj.select(F.explode(both).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def weakest_confidence(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence): of parallel edges the least certain."""
    rank = F.when(F.col("confidence") == "certain", 0).when(F.col("confidence") == "inferred", 1).otherwise(2)
    out = edges.groupBy("src", "dst", "kind").agg(F.max(rank).alias("rank"))
    return out.select("src", "dst", "kind", F.element_at(F.array(F.lit("certain"), F.lit("inferred"), F.lit("uncertain")), F.col("rank") + 1).alias("confidence"))


def induced(edges: DataFrame, members: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Edges with both ends among ``members`` (node_id), parallel ones kept; no kinds named means all."""
    chosen = edges if kinds is None else edges.where(F.col("kind").isin(*checked_kinds(kinds)) if list(kinds) else F.lit(False))
    ids = members.select("node_id").distinct()
    return chosen.join(ids, chosen.src == ids.node_id, "left_semi").join(ids.withColumnRenamed("node_id", "n"), F.col("dst") == F.col("n"), "left_semi")


def dependencies(edges: DataFrame) -> DataFrame:
    """(src, dst, n): import edges between modules and how many they are."""
    return edges.where("kind = 'imports'").groupBy("src", "dst").agg(F.count("*").alias("n"))


def members(edges: DataFrame) -> DataFrame:
    """(src, n, members): what each unit contains, how many edges say so and the members' ids sorted and joined by ','."""
    held = edges.where("kind = 'contains'").groupBy("src").agg(F.count("*").alias("n"), F.collect_set("dst").alias("members"))
    return held.withColumn("members", F.array_join(F.array_sort("members"), ","))


def unresolved_calls(graph: GraphBundle) -> DataFrame:
    """Calls to proxies that stand for unresolved symbols: src, dst, raw_target, callee, file_path, start_line."""
    from ..functions.text import last_segment

    proxies = graph.nodes.where((F.col("kind") == "proxy") & (F.get_json_object("attrs", "$.proxy_kind") == "unresolved")).select(F.col("id").alias("dst"), F.get_json_object("attrs", "$.raw_symbol").alias("symbol"))
    calls = graph.edges.where("kind = 'calls'").join(proxies, "dst")
    raw = F.coalesce(F.get_json_object("attrs", "$.raw_target"), F.col("symbol"), F.col("dst"))
    return calls.withColumn("raw_target", raw).select("src", "dst", "raw_target", last_segment(F.col("raw_target")).alias("callee"), "confidence", "file_path", "start_line", "edge_seq")

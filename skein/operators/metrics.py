"""Counts and reports over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.text import last_segment
from . import views


def summary(graph: GraphBundle) -> DataFrame:
    """One row: nodes by group, raw call edges, entrypoints."""
    n = graph.nodes.agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
        F.count_if(F.col("kind") == "class").alias("classes"),
        F.count_if(F.col("kind") == "proxy").alias("proxies"),
    )
    e = graph.edges.where("kind = 'calls'").agg(F.count("*").alias("call_edges"))
    t = graph.entrypoints.agg(F.count("*").alias("entrypoints"))
    return n.join(e).join(t)  # three tables of one row


def full_summary(graph: GraphBundle) -> DataFrame:
    """:func:`summary` with languages, dependencies in their order, source files by language, and syntax diagnostics."""
    nodes, files = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.source_files, "source_files").where("language is not null")
    languages = nodes.agg(F.array_sort(F.collect_set("language")).alias("languages"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda d: d["name"])
    dependencies = graph.dependencies.agg(named.alias("dependencies"))
    by = files.groupBy("language").agg(F.count("*").alias("n"))
    counts = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("source_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("source_file_counts"))
    wrong = graph.diagnostics.agg(F.count("*").alias("parse_diagnostics"))
    return summary(graph).join(languages).join(dependencies).join(counts).join(wrong)  # tables of one row


def kind_counts(graph: GraphBundle) -> DataFrame:
    nodes = graph.nodes.groupBy("kind").count().select(F.lit("node").alias("element"), "kind", F.col("count").alias("n"))
    return nodes.unionByName(graph.edges.groupBy("kind").count().select(F.lit("edge").alias("element"), "kind", F.col("count").alias("n")))


def hotspots(nodes: DataFrame, threshold: int = 10) -> DataFrame:
    """Nodes at least so complex, the most complex first."""
    return nodes.where(F.col("cc") >= threshold).orderBy(F.desc("cc"), "node_seq")


def band(cc: Column) -> Column:
    return F.when(cc > 10, "high").when(cc >= 5, "medium").otherwise("low")


def call_resolution(graph: GraphBundle) -> DataFrame:
    """One row: call sites, resolved ones, unresolved ones, distinct unresolved targets and callers."""
    sites = views.call_edges(graph).agg(F.count("*").alias("call_sites"))
    open_ = views.unresolved_calls(graph).agg(F.count("*").alias("unresolved"), F.count_distinct("raw_target").alias("unresolved_targets"), F.count_distinct("src").alias("unresolved_callers"))
    return sites.join(open_).select("call_sites", (F.col("call_sites") - F.col("unresolved")).alias("resolved"), "unresolved", "unresolved_targets", "unresolved_callers")


def unresolved_by_callee(graph: GraphBundle) -> DataFrame:
    return views.unresolved_calls(graph).groupBy("callee").agg(F.count("*").alias("sites"), F.count_distinct("src").alias("callers")).orderBy(F.desc("sites"), "callee")


def by_target(edges: DataFrame) -> DataFrame:
    """(target, sites, sources, name): how often each target is used, by the last segment of its id."""
    return edges.groupBy("dst").agg(F.count("*").alias("sites"), F.count_distinct("src").alias("sources")).withColumn("name", last_segment(F.col("dst")))

"""Annotations, and findings of other tools matched to nodes by file and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from ..schema import ANNOTATION_KINDS, checked_kinds
from . import intervals


def annotate(graph: GraphBundle, node_id: str, kind: str, description: str, source: str = "manual") -> tuple[GraphBundle, bool]:
    """The graph with one annotation more; False (and no change) if there is no such node."""
    checked_kinds([kind], ANNOTATION_KINDS)
    if graph.nodes.where(F.col("id") == node_id).isEmpty():
        return graph, False
    seq = (graph.annotations.where(F.col("node_id") == node_id).agg(F.max("seq")).first()[0] or 0) + 1
    row = graph.spark.createDataFrame([(node_id, seq, kind, description, source)], graph.annotations.schema)
    return graph.having(annotations=graph.annotations.unionByName(row)), True


def clear(graph: GraphBundle, node_id: str, kind: str | None = None) -> tuple[GraphBundle, bool]:
    there = not graph.nodes.where(F.col("id") == node_id).isEmpty()
    gone = (F.col("node_id") == node_id) & (F.lit(True) if kind is None else F.col("kind") == kind)
    return graph.having(annotations=graph.annotations.where(~gone)), there


def by_node(graph: GraphBundle, kind: str | None = None) -> DataFrame:
    """(id, n, listed): nodes with findings or audit notes, which are listed in order."""
    wanted = graph.annotations.where(F.col("kind").isin("finding", "audit_note") if kind is None else F.col("kind") == kind)
    listed = wanted.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "description"))), lambda a: F.concat_ws(": ", a["kind"], a["description"])), "; ").alias("listed"))
    return graph.nodes.join(listed, "id").select("id", "name", "n", "listed")


def imported(graph: GraphBundle, results: DataFrame, prefix: str, replace: bool = True) -> tuple[GraphBundle, dict[str, int]]:
    """Annotate the nodes that overlap each result's lines.

    ``results``: result_id, file, start, end, kind, description, source, groups (array of subgraph names).
    Earlier annotations whose source begins with the prefix, and subgraphs named
    'prefix:...', are dropped first if ``replace``. Gives the counts of matched and unmatched results.
    """
    notes, groups = graph.annotations, graph.subgraphs
    if replace:
        notes, groups = notes.where(~F.col("source").startswith(prefix)), groups.where(~F.col("name").startswith(f"{prefix}:"))
    units = graph.nodes.where("origin = 'source' and start_line is not null").select(F.col("file_path").alias("file"), F.col("id").alias("node_id"), F.col("start_line").cast("long").alias("r_start"), F.col("end_line").cast("long").alias("r_end"))
    spans = results.withColumnsRenamed({"start": "l_start", "end": "l_end"})
    hits = cut(intervals.overlaps(spans, units, ["file"]).dropDuplicates(["result_id", "node_id"]))
    base = notes.groupBy("node_id").agg(F.max("seq").alias("top"))
    order = Window.partitionBy("node_id").orderBy("result_id")
    added = hits.join(base, "node_id", "left").withColumn("seq", (F.coalesce("top", F.lit(0)) + F.row_number().over(order)).cast("long"))
    notes = notes.unionByName(added.select("node_id", "seq", "kind", "description", "source"))
    groups = groups.unionByName(hits.select(F.explode("groups").alias("name"), "node_id")).distinct()
    total, matched = results.select("result_id").distinct().count(), hits.select("result_id").distinct().count()
    return graph.having(annotations=cut(notes), subgraphs=cut(groups)), {"matched": matched, "unmatched": total - matched}

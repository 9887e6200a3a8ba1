"""Differences between two snapshots of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.text import line_span
from . import metrics


def rows(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): added, removed and modified rows, with the changed fields' names joined by ','."""
    a = before.select(F.col(key), F.struct(*fields).alias("x"))
    b = after.select(F.col(key), F.struct(*fields).alias("y"))
    both = a.join(b, key, "full_outer")
    changed = F.concat_ws(",", *[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields])
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(changed != "", "modified")
    return both.select(key, status.alias("status"), F.when(status == "modified", changed).otherwise("").alias("changed")).where("status is not null")


NODE_FIELDS = ["name", "kind", "origin", "cc", "parameters", "return_type", "exception_types", "type_parameters", "attrs", "events", "lines"]


def nodes(before: GraphBundle, after: GraphBundle) -> DataFrame:
    """Node changes; moved but equally long nodes, and events that only moved, count as unchanged."""

    def compared(graph: GraphBundle) -> DataFrame:
        full = GraphBundle.conform(graph.nodes, "nodes")
        still = F.transform("exception_events", lambda e: F.to_json(F.struct(e["kind"], e["syntax"], e["expression"], e["types"], e["region"], e["confidence"])))
        as_text = {c: F.to_json(c) for c in ("parameters", "type_parameters")}
        return full.withColumns(as_text).withColumn("events", F.array_sort(still)).withColumn("lines", line_span(F.col("start_line"), F.col("end_line")))

    return rows(compared(before), compared(after), "id", NODE_FIELDS)


def edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence, status): set difference both ways, in one grouping of both sides."""
    columns = ["src", "dst", "kind", "confidence"]
    side = lambda df, old: df.select(*columns, F.lit(old).alias("old"))
    both = side(before, True).unionByName(side(after, False)).groupBy(*columns).agg(F.min("old").alias("all_old"), F.max("old").alias("any_old"))
    return both.where(F.col("all_old") == F.col("any_old")).select(*columns, F.when(F.col("all_old"), "removed").otherwise("added").alias("status"))


def entrypoints(before: DataFrame, after: DataFrame) -> DataFrame:
    return rows(before, after, "node_id", ["kind", "trust_level", "asset_value", "description"])


def summaries(before: GraphBundle, after: GraphBundle) -> DataFrame:
    """(measure, before, after, delta) of the counts that differ."""
    flat = lambda g, name: metrics.summary(g).selectExpr("stack(6, 'total_nodes', total_nodes, 'functions', functions, 'classes', classes, 'proxies', proxies, 'call_edges', call_edges, 'entrypoints', entrypoints) as (measure, n)").withColumnRenamed("n", name)
    both = flat(before, "before").join(flat(after, "after"), "measure")
    return both.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def coverage(before: GraphBundle, after: GraphBundle) -> DataFrame:
    """(language, before, after): how many files of each language either graph was read from."""
    counted = lambda g, name: g.source_files.where("language is not null").groupBy("language").agg(F.count("*").alias(name))
    both = counted(before, "before").join(counted(after, "after"), "language", "full")
    return both.select("language", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def report(before: GraphBundle, after: GraphBundle, cap: int = 20) -> str:
    """A text report; each section names at most ``cap`` items and counts the rest."""
    lines = []
    for r in summaries(before, after).orderBy("measure").collect():
        lines.append(f"{r['measure']}: {r['before']} -> {r['after']} ({r['delta']:+d})")
    found = {"nodes": (nodes(before, after), ["id"]), "edges": (edges(before.edges, after.edges), ["src", "dst", "kind", "confidence"]), "entrypoints": (entrypoints(before.entrypoints, after.entrypoints), ["node_id"])}
    for title, (table, keys) in found.items():
        for status in ("added", "removed", "modified"):
            own = table.where(F.col("status") == status)
            if n := own.count():
                lines.append(f"{title} {status}: {n}")
                lines += ["  " + " ".join(str(r[k]) for k in keys) + (f" [{r['changed']}]" if status == "modified" else "") for r in own.orderBy(*keys).limit(cap).collect()]
                if n > cap:
                    lines.append(f"  ... {n - cap} more")
    return "\n".join(lines) + "\n" if lines else "no differences\n"

"""Longest-prefix matches as equal joins.

A path is matched against a table of prefixes without comparing each with each: its own
prefixes, one a part, are the keys of an equal join, and the longest hit wins. A path of
n parts has n keys; the table is as large as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import intervals


def slashed(path: Column) -> Column:
    """A path with "/" for backslashes and without one at its end."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"(?<=.)/+$", "")


def longest(paths: DataFrame, prefixes: DataFrame, separator: str = "/") -> DataFrame:
    """(path, prefix, value) of the ``paths`` (path) that lie at or below some of ``prefixes`` (prefix, value): the longest of them.

    A prefix ends where a part ends. One that has several values gives none.
    """
    parts = F.split("path", separator)
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), separator))
    own = paths.select("path").where("path is not null").distinct().select("path", F.posexplode(keys).alias("depth", "prefix"))
    table = prefixes.groupBy("prefix").agg(F.count_distinct("value").alias("k"), F.min("value").alias("value"))
    best = own.join(table, "prefix").groupBy("path").agg(F.max_by(F.struct("prefix", "value", "k"), "depth").alias("b"))
    return best.select("path", "b.prefix", F.when(F.col("b.k") == 1, F.col("b.value")).alias("value")).where("value is not null")


def remapped(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, to): each of ``paths`` with its longest prefix replaced; ``prefixes`` has (old, new). Paths that none fits stay."""
    table = prefixes.select(slashed(F.col("old")).alias("prefix"), F.regexp_replace("new", r"[/\\]+$", "").alias("value"))
    rows = paths.select("path").distinct().withColumn("plain", F.regexp_replace("path", r"\\", "/"))
    hits = longest(rows.select(F.col("plain").alias("path")), table).withColumnRenamed("path", "plain")
    out = rows.join(hits, "plain", "left")
    return out.select("path", F.when(F.col("prefix").isNotNull(), F.concat("value", F.expr("substring(plain, length(prefix) + 1)"))).otherwise(F.col("plain")).alias("to"))


def source_lines(lines: DataFrame, nodes: DataFrame, prefixes: DataFrame, width: int = 64) -> DataFrame:
    """(path, line, node_id): the smallest function or method that holds each of ``lines`` (path, line) once its path is remapped; two of one size give none."""
    units = nodes.where("origin = 'source' and kind in ('function', 'method') and start_line is not null").select(F.regexp_replace("file_path", r"\\", "/").alias("file"), "id", F.col("start_line").cast("long").alias("start"), (F.col("end_line") + 1).cast("long").alias("end"))
    asked = cut(lines.where("line > 0 and path not in ('', '??')").select("path", "line").distinct())
    placed = asked.join(remapped(asked, prefixes), "path").select("path", "line", F.col("to").alias("file"), F.col("line").cast("long").alias("at"))
    hits = intervals.stab(placed, units, on=["file"], width=width)
    sized = hits.groupBy("path", "line", (F.col("end") - F.col("start")).alias("size")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    best = sized.groupBy("path", "line").agg(F.min_by(F.struct("n", "id"), "size").alias("b"))
    return best.where("b.n = 1").select("path", "line", F.col("b.id").alias("node_id"))


def owning_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root): the deepest of ``roots`` (root) above the file of each of ``nodes`` (id, file_path): whose rules hold for it."""
    table = roots.select(slashed(F.col("root")).alias("prefix"), F.col("root").alias("value"))
    files = nodes.where("file_path is not null").select("id", F.regexp_replace("file_path", r"\\", "/").alias("path"))
    return files.join(longest(files.select("path"), table), "path").select("id", F.col("value").alias("root"))

"""Strongly connected components, and reach through the graph that they condense to.

Components are found by colouring: what has no edge in or none out is trimmed, the
largest name that reaches a node becomes its colour, and what reaches the bearer of a
colour back within that colour is its component. Each of these is a loop of joins over
the edges left; a round's tables are written to the shared folder. Edges between
colours are dropped at once, since no cycle crosses them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import traverse

#: Rounds of trimming, each from both ends, before each colouring.
TRIMS = 2


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); a component is named by its smallest node."""
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = cut(pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct())
    named = untrimmed(pairs)
    if named is None:
        return nodes.select("node", F.col("node").alias("component"))
    return cut(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def untrimmed(pairs: DataFrame) -> DataFrame | None:
    """(node, component), as :func:`strong_components` has it, of a few nodes of ``pairs`` (src, dst; stored), among them all on cycles; None if trimming alone shows that there are no cycles."""
    left, found = pairs.where("src <> dst"), []
    while True:
        for _ in range(TRIMS):
            # Stored each time: what is left is read twice by the next join.
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
            left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.isEmpty():
                break
        if left.isEmpty():
            break
        colours = _colours(left)
        paint = lambda df, end: df.join(colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")), end)  # noqa: E731, B023
        left = cut(paint(paint(left, "src"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        roots = colours.where("node = colour").select(F.col("colour").alias("root"), "node")
        members = cut(traverse.closure(traverse.reversed_edges(left), roots, with_roots=True).select("node", F.col("root").alias("colour")))
        found.append(members)
        done = members.select("node")
        left = cut(left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not found:
        return None
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    names = members.groupBy("colour").agg(F.min("node").alias("component"))
    return members.join(names, "colour").select("node", "component")


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the largest node that reaches it over ``edges``, itself included."""
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    known = cut(both.select("node", F.col("node").alias("colour")))
    fresh = known
    while True:
        ahead = fresh.withColumnRenamed("node", "src").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        after = cut(known.join(ahead, "node", "left").select("node", F.greatest("colour", "offer").alias("colour"), (F.coalesce("offer", "colour") > F.col("colour")).alias("changed")))
        fresh = after.where("changed").select("node", "colour")
        known = after.select("node", "colour")
        if fresh.isEmpty():
            return known


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst): the edges between different components."""
    name = lambda end: members.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    both = edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst")
    return both.where("src_in <> dst_in").select(F.col("src_in").alias("src"), F.col("dst_in").alias("dst")).distinct()


def reach(edges: DataFrame, members: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(component, target): the components that each component reaches, itself included; only from those of ``seeds`` (component) if given."""
    start = (members.select("component") if seeds is None else seeds.select("component")).distinct()
    roots = start.select(F.col("component").alias("root"), F.col("component").alias("node"))
    return traverse.closure(cut(condensed(edges, members)), roots, with_roots=True).select(F.col("root").alias("component"), F.col("node").alias("target"))


def least(edges: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(component, name, value): for each component and name the ``k`` least distinct values of ``own`` (component, name, value) in what it reaches over ``edges`` (src, dst), itself included.

    Lists of bounded length pass from component to component until none changes, so that no pairs of components are made:
    the work grows as edges times names.
    """
    place = F.row_number().over(Window.partitionBy("component", "name").orderBy("value"))
    known = fresh = cut(own.select("component", "name", "value").distinct().withColumn("place", place).where(F.col("place") <= k).drop("place"))
    back = cut(edges.select(F.col("src").alias("to"), F.col("dst").alias("component")))
    while True:
        ahead = cut(fresh.join(back, "component").select(F.col("to").alias("component"), "name", "value").distinct())
        # Only lists that something came to are gone over.
        touched = ahead.select("component", "name").distinct()
        some = known.join(touched, ["component", "name"], "left_semi").withColumn("new", F.lit(False)).unionByName(ahead.withColumn("new", F.lit(True)))
        some = some.groupBy("component", "name", "value").agg(F.min("new").alias("new"))
        some = cut(some.withColumn("place", place).where(F.col("place") <= k).drop("place"))
        fresh = some.where("new").drop("new")
        if fresh.isEmpty():
            return known
        known = cut(known.join(touched, ["component", "name"], "left_anti").unionByName(some.drop("new")))

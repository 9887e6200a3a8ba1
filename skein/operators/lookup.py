"""Ranked lookup of nodes by reference.

An exact id wins outright. Otherwise real nodes go before proxies, then rank 0 is the
name (or the name without its position suffix), rank 1 the id without position or an
id that ends in ':reference', rank 2 an id that ends in '.reference'; ties go to the
node that came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_position


def is_proxy() -> Column:
    return (F.col("kind") == "proxy") | (F.coalesce(F.col("origin"), F.lit("")) == "proxy")


def rank(ref: Column) -> Column:
    """The rank of a node for a reference; null if it does not match."""
    base = without_position(F.col("id"))
    return (
        F.when(F.col("id") == ref, -1)
        .when((F.col("name") == ref) | (without_position(F.col("name")) == ref), 0)
        .when((base == ref) | base.endswith(F.concat(F.lit(":"), ref)), 1)
        .when(base.endswith(F.concat(F.lit("."), ref)), 2)
    )


def resolve(nodes: DataFrame, ref: str) -> DataFrame:
    """The one node (or none) that ``ref`` stands for."""
    ranked = nodes.withColumn("__rank", rank(F.lit(ref))).where("__rank is not null")
    order = (F.col("__rank") != -1, is_proxy(), F.col("__rank"), F.col("node_seq"))
    return ranked.orderBy(*order).limit(1).drop("__rank")


def _keys() -> Column:
    """All references that a node answers to, with their ranks, so that a batch lookup is an equi-join."""
    base = without_position(F.col("id"))
    pair = lambda k, r: F.struct(k.alias("ref"), F.lit(r).alias("rank"))
    cut_after = lambda sign, r: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(base), F.lit(1))), lambda i: F.substring(base, i, F.lit(1)) == sign),
        lambda i: F.struct(F.substring(base, i + 1, F.length(base)).alias("ref"), F.lit(r).alias("rank")),
    )
    return F.concat(F.array(pair(F.col("id"), -1), pair(F.col("name"), 0), pair(without_position(F.col("name")), 0), pair(base, 1)), cut_after(":", 1), cut_after(".", 2))


def resolve_all(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, node_id) for each distinct ``ref`` that matches, by one equi-join for all of them."""
    keyed = nodes.select("id", "node_seq", is_proxy().alias("proxy"), F.explode(_keys()).alias("k")).select("id", "node_seq", "proxy", "k.ref", "k.rank")
    hits = refs.select("ref").distinct().join(keyed, "ref")
    best = hits.groupBy("ref").agg(F.min_by("id", F.struct(F.col("rank") != -1, "proxy", "rank", "node_seq")).alias("node_id"))
    return best

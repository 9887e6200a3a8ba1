"""Lookup of names outwards through enclosing scopes.

A reference is bound by the nearest scope around it that declares its name. The chain
of scopes of each reference is found by pointer doubling: after k rounds the table has
all ancestors nearer than 2^k, and the jumps of 2^k are composed of two of half the
length. So the rounds grow as the logarithm of the depth, and no round walks a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut


def _jumps(parents: DataFrame) -> DataFrame:
    return cut(parents.where("up is not null").groupBy("node").agg(F.min("up").alias("up")))


def ancestors(parents: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(scope, ancestor, distance) for each of ``seeds`` (scope), all nodes of ``parents`` if left out; each is its own ancestor at distance 0.

    ``parents`` has (node, up); of several parents the smallest counts. A cycle ends where it began.
    """
    return _ancestors(_jumps(parents), seeds)


def _ancestors(jump: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """:func:`ancestors` over stored steps (node, up), one a node."""
    if seeds is None:
        seeds = jump.select(F.col("node").alias("scope")).unionByName(jump.select(F.col("up").alias("scope")))
    known = cut(seeds.select("scope").where("scope is not null").distinct().select("scope", F.col("scope").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    step = 1
    while True:
        ahead = known.join(jump.withColumnRenamed("node", "ancestor"), "ancestor").select("scope", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        fresh = cut(ahead.join(known.select("scope", "ancestor"), ["scope", "ancestor"], "left_anti").groupBy("scope", "ancestor").agg(F.min("distance").alias("distance")))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))
        jump = cut(jump.select("node", F.col("up").alias("via")).join(jump.select(F.col("node").alias("via"), "up"), "via").select("node", "up"))
        step *= 2


def lookup(refs: DataFrame, parents: DataFrame, declared: DataFrame) -> DataFrame:
    """(ref_id, node_id, n, distance) of the ``refs`` (ref_id, scope, name) that some scope around them answers to.

    ``declared`` has (scope, name, id). The nearest scope with the name decides, even if it declares it more than
    once: then ``node_id`` is null. Equal references of one scope are looked up once.
    """
    index = cut(declared.where("scope is not null").groupBy("scope", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")))
    kind = dict(declared.dtypes)["id"]
    if index.isEmpty():
        return refs.select("ref_id", F.lit(None).cast(kind).alias("node_id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("distance")).where("false")
    known, jump = index.select("name").distinct(), _jumps(parents)
    # References of scopes that declare nothing begin in the next scope, which many may share.
    asked = refs.where("scope is not null").select("ref_id", "scope", "name").join(known, "name", "left_semi")
    silent = jump.join(index.select(F.col("scope").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("scope"), "up")
    asked = asked.join(silent, "scope", "left").select("ref_id", F.coalesce("up", "scope").alias("scope"), "name", F.when(F.col("up").isNull(), 0).otherwise(1).alias("lift"))
    asked = cut(asked)
    pairs = cut(asked.select("scope", "name").distinct())
    around = _ancestors(jump, pairs.select("scope"))
    hits = pairs.join(around, "scope").join(index.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"])
    best = hits.groupBy("scope", "name").agg(F.min_by(F.struct("n", "only", "distance"), "distance").alias("b"))
    return asked.join(best, ["scope", "name"]).select("ref_id", F.when(F.col("b.n") == 1, F.col("b.only")).alias("node_id"), F.col("b.n").alias("n"), (F.col("b.distance") + F.col("lift")).alias("distance"))


def tree(contains: DataFrame) -> DataFrame:
    """(node, up) from ``contains`` edges (src holds dst)."""
    return contains.select(F.col("dst").alias("node"), F.col("src").alias("up"))

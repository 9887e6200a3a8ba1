"""What exported names stand for, through aliases and re-exports.

The key of an export is (module, name). A module has it in one of three ways, in this
order: it declares the name; it names another module's export for it (an alias, under
any name); it re-exports all of some module (a star). A key means what all ways from
it lead to: chains of aliases have one successor a key and are followed by pointer
doubling; stars fan out and are followed round by round from the keys asked for, each key
once; then what is found goes back over them, so that no pairs of requests and keys are
made. A key on a cycle leads nowhere by it. Two ends make a name ambiguous.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import traverse


def explicit(declared: DataFrame, aliases: DataFrame) -> DataFrame:
    """(module, name, id, to_module, to_name): one row a key that a module names itself.

    A declared name wins over an alias; what is declared or aliased in several ways has neither id nor successor.
    """
    own = declared.groupBy("module", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    alias = aliases.groupBy("module", "name").agg(F.count_distinct("to_module", "to_name").alias("k"), F.min(F.struct("to_module", "to_name")).alias("to"))
    both = own.join(alias, ["module", "name"], "full")
    follow = F.col("n").isNull() & (F.col("k") == 1)
    return both.select("module", "name", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.when(follow, F.col("to.to_module")).alias("to_module"), F.when(follow, F.col("to.to_name")).alias("to_name"))


def chains(keys: DataFrame) -> DataFrame:
    """(module, name, end_module, end_name): where the alias chain of each key of ``keys`` (see :func:`explicit`) ends; keys on or before a cycle are left out.

    Each round doubles the jumps; a jump that has reached its end stays.
    """
    at = cut(keys.where("to_module is not null").select("module", "name", F.col("to_module").alias("end_module"), F.col("to_name").alias("end_name")))
    size = at.count()
    rounds = 0
    while True:
        ahead = at.select(F.col("module").alias("end_module"), F.col("name").alias("end_name"), F.col("end_module").alias("m"), F.col("end_name").alias("x"))
        after = cut(at.join(ahead, ["end_module", "end_name"], "left").select("module", "name", F.coalesce("m", "end_module").alias("end_module"), F.coalesce("x", "end_name").alias("end_name"), F.col("m").isNotNull().alias("moved")))
        at, rounds = after.drop("moved"), rounds + 1
        moving = after.where("moved").select("module", "name")
        if moving.isEmpty():
            return at
        if 2 ** (rounds - 1) >= size:  # every chain had ended before this round: what still moves is on a cycle or leads to one
            return at.join(moving, ["module", "name"], "left_anti")


def resolved(requests: DataFrame, declared: DataFrame, aliases: DataFrame, stars: DataFrame, default: str = "$default") -> DataFrame:
    """(module, name, node_id, n) of the ``requests`` (module, name): n ends were found, ``node_id`` is the only one; n is 0 for a missing name.

    ``declared`` (module, name, id), ``aliases`` (module, name, to_module, to_name), ``stars`` (module, to_module).
    Stars never pass the default export on.
    """
    wanted = cut(requests.select("module", "name").distinct())
    keys = cut(explicit(declared, aliases))
    ends = cut(chains(keys))
    named = keys.select("module", "name", "id", F.lit(True).alias("named"))
    fan = cut(stars.select("module", "to_module").where("module <> to_module").distinct())

    def settle(rows: DataFrame) -> DataFrame:
        """``rows`` (module, name and others) with the ``key`` (module, name) where their alias chains end."""
        return rows.join(ends, ["module", "name"], "left").withColumn("key", F.struct(F.coalesce("end_module", "module").alias("module"), F.coalesce("end_name", "name").alias("name"))).drop("end_module", "end_name")

    start = cut(settle(wanted))
    # Each key that any request leads to is looked at once, however many lead to it.
    at, seen, steps, holding = start.select("key").distinct(), None, [], []
    while True:
        at = cut(at.select("key", "key.*").join(named, ["module", "name"], "left").select("key", "id", "named"))
        holding.append(at.where("id is not null").select("key", "id"))
        seen = at.select("key") if seen is None else cut(seen.unionByName(at.select("key")))
        # A key that its module does not name itself is looked for in what the module re-exports whole.
        open_ = at.where("named is null").select(F.col("key").alias("from"), "key.*").where(F.col("name") != default)
        steps.append(cut(settle(open_.join(fan, "module").select("from", F.col("to_module").alias("module"), "name")).select("from", "key").distinct()))
        at = steps[-1].select("key").distinct().join(seen, "key", "left_anti")
        if at.isEmpty():
            break
    together = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    # What the keys stand for goes back from key to key, each end once a key.
    back = together(steps).select(F.col("key").alias("src"), F.col("from").alias("dst"))
    found = traverse.closure(back, together(holding).select(F.col("id").alias("root"), F.col("key").alias("node")), with_roots=True)
    by = found.groupBy(F.col("node").alias("key")).agg(F.count("*").alias("n"), F.min("root").alias("only"))
    return start.join(by, "key", "left").select("module", "name", F.when(F.col("n") == 1, F.col("only")).alias("node_id"), F.coalesce("n", F.lit(0)).alias("n"))

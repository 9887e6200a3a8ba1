"""Binding of references in proof and specification languages.

A reference carries tiers of names; the first tier that answers decides, even if it
answers twice. Within a tier the module's own definitions come before its own
signatures, then signatures of modules that it sees, then their definitions; private
symbols answer in their own module alone. A signature corresponds to the one definition
of its name. An applied symbol is a call where it is evaluated at run time: in a body,
or as an argument all of whose enclosing applications evaluate theirs. The enclosing
applications of a reference come from pointer doubling (``scopes.ancestors``), so the
rounds grow as the logarithm of the nesting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import scopes, visibility

SYMBOLS = "id string, module string, name string, signature boolean, private boolean, executable boolean, ghosts array<string>"
REFERENCES = "ref_id string, src string, module string, tiers array<array<string>>, application boolean, context string, enclosing string"
ARGUMENTS = "scope string, up string, callee string, argument string"


def bound(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, node_id, n) of the ``refs`` that some tier answers; ``node_id`` where exactly one symbol does.

    ``imports`` has (src, dst), modules. A null name or tier answers nothing. ``n`` is exact up to 1: of symbols of other
    modules no more than two a name are counted, since the second already leaves a reference unbound.
    """
    # A symbol without a flag is an open definition.
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    symbols = cut(symbols.where("id is not null and module is not null and name is not null").select("id", "module", "name", flag("signature"), flag("private")))
    names = refs.select("ref_id", "module", F.posexplode("tiers").alias("tier", "names")).select("ref_id", "module", "tier", F.explode(F.array_distinct("names")).alias("name"))
    names = cut(names.join(symbols.select("name").distinct(), "name", "left_semi"))
    asks = cut(names.select("module", "name").distinct())
    own = asks.join(symbols, ["module", "name"]).groupBy("module", "name", "signature").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    answers = [own.select("module", "name", F.col("signature").cast("int").alias("rank"), "n", "only")]
    # A module's own symbols are counted here too, but where it has any of the name an earlier rank has decided.
    found = visibility.few_visible(asks, symbols.where("not private").select("module", "name", "id", "signature"), imports, F.when(F.col("signature"), 2).otherwise(3))
    answers.append(found.select("module", "name", F.col("group").alias("rank"), "n", "only"))
    known = cut(answers[0].unionByName(answers[1]))
    ranked = names.join(known, ["module", "name"]).groupBy("ref_id", "tier", "rank").agg(F.sum("n").alias("n"), F.min("only").alias("only"))
    best = ranked.groupBy("ref_id").agg(F.min(F.struct("tier", "rank", "n", "only")).alias("b"))
    return best.select("ref_id", F.when(F.col("b.n") == 1, F.col("b.only")).alias("node_id"), F.col("b.n").alias("n"))


def corresponding(symbols: DataFrame) -> DataFrame:
    """(src, dst): each signature with the definition of its name, where there is exactly one."""
    signature = F.coalesce("signature", F.lit(False))
    one = symbols.where(~signature).groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("dst")).where("n = 1")
    return symbols.where(signature).join(one, "name").select(F.col("id").alias("src"), "dst").distinct()


def evaluated(refs: DataFrame, targets: DataFrame, symbols: DataFrame, arguments: DataFrame) -> DataFrame:
    """(ref_id, runtime) for the applied ``refs``: true, false, or null where an enclosing application is not known.

    ``targets`` has (ref_id, node_id); ``arguments`` has the columns of ``ARGUMENTS``: ``callee`` is the reference
    that is applied around the scope. A ghost argument is never evaluated, nor one of what can't be executed.
    """
    applied = refs.where("application")
    callee = applied.select("ref_id").join(targets, "ref_id").join(symbols.select(F.col("id").alias("node_id"), F.coalesce("executable", F.lit(False)).alias("executable"), "ghosts"), "node_id")
    here = arguments.join(callee.withColumnRenamed("ref_id", "callee"), "callee", "left")
    plain = F.coalesce(F.size("ghosts"), F.lit(0)) <= 0
    holds = F.when(F.col("node_id").isNull(), 1).when(~F.col("executable"), 0).when(plain, 2).when(F.col("argument").isNull() | F.array_contains("ghosts", F.col("argument")), 0).otherwise(2)
    local = cut(here.groupBy("scope").agg(F.min(holds).alias("holds"), F.min("up").alias("up")))
    inside = applied.where("context = 'argument'").select("ref_id", F.col("enclosing").alias("scope"))
    around = scopes.ancestors(local.select(F.col("scope").alias("node"), "up"), inside.select("scope"))
    value = around.join(local.select(F.col("scope").alias("ancestor"), "holds"), "ancestor").groupBy("scope").agg(F.min("holds").alias("holds"))
    out = applied.select("ref_id", "context", F.col("enclosing").alias("scope")).join(value, "scope", "left")
    inner = F.when(F.col("holds") == 2, True).when(F.col("holds") == 1, F.lit(None).cast("boolean")).otherwise(False)
    return out.select("ref_id", F.when(F.col("context") == "body", True).when(F.col("context") == "argument", inner).otherwise(False).alias("runtime"))


def linked(refs: DataFrame, symbols: DataFrame, imports: DataFrame, arguments: DataFrame, lenient: bool = False) -> DataFrame:
    """(ref_id, src, dst, kind, confidence): ``references``, the ``calls`` among them, and ``corresponds_to`` without ref_id.

    With ``lenient`` a call whose surroundings are not known is kept as uncertain.
    """
    refs, symbols = cut(refs), cut(symbols)
    targets = cut(bound(refs, symbols, imports).where("node_id is not null").select("ref_id", "node_id"))
    edge = lambda df, kind, sure: df.select("ref_id", "src", "dst", F.lit(kind).alias("kind"), sure.alias("confidence"))
    ends = refs.select("ref_id", "src").join(targets, "ref_id").withColumnRenamed("node_id", "dst")
    runs = symbols.where("executable").select("id").distinct()
    live = ends.join(runs.withColumnRenamed("id", "src"), "src", "left_semi").join(runs.withColumnRenamed("id", "dst"), "dst", "left_semi")
    promoted = live.join(evaluated(refs, targets, symbols, arguments), "ref_id").where("runtime is null or runtime" if lenient else "runtime")
    promoted = promoted.withColumn("sure", F.when(F.col("runtime"), "inferred").otherwise("uncertain"))
    pairs = corresponding(symbols).withColumn("ref_id", F.lit(None).cast("string"))
    return edge(ends, "references", F.lit("inferred")).unionByName(edge(promoted, "calls", F.col("sure"))).unionByName(edge(pairs, "corresponds_to", F.lit("inferred")))

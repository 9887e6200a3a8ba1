"""Callables that flow through variables to the places that use them.

A definition binds a name of a scope at a position: to a callable, to what another name
holds there, or to something unknown. One that always happens ends all before it; one
that may happen (in a branch) adds to them. So the definitions and uses of a name fall
into segments, each begun by a definition that always happens, and a use is met by the
definitions before it in its segment. All uses between two neighbouring definitions are
met by the same ones: they are one state, and an equal join on (scope, name, segment)
takes states instead of uses. A name that its scope does not bind before the use is that
of the scope around it, where what it holds in the end counts.

Copies make edges between states. Callables pass over them from state to state until
nothing is new, also for copies in a circle, so that no pairs of uses and definitions
are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from . import scopes, traverse

DEFINITIONS = "scope string, position long, name string, kind string, value string, always boolean"


#: Where no definition that always happens, or none at all, is before a place.
NONE = -(1 << 63)


def _placed(definitions: DataFrame, asks: DataFrame) -> DataFrame:
    """scope, name, position, def_id, use_id, copy_id, kill, upto: definitions and asks in the order of their scope and name.

    ``kill`` is the position of the last definition so far that always happens, ``upto`` that of the last one at all.
    """
    marks = definitions.select("scope", "name", "position", F.lit(0).alias("after"), "always", "def_id", F.lit(None).cast("string").alias("use_id"), F.lit(None).cast("long").alias("copy_id"))
    rows = marks.unionByName(asks.select("scope", "name", "position", F.lit(-1).alias("after"), F.lit(False).alias("always"), F.lit(None).cast("long").alias("def_id"), "use_id", "copy_id"))
    # A use stands before a definition of its own place: in "f = f" the right side is what f was.
    order = Window.partitionBy("scope", "name").orderBy("position", "after", F.desc("always")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = lambda which: F.coalesce(F.max(F.when(which, F.col("position"))).over(order), F.lit(NONE))
    return cut(rows.select("scope", "name", "position", "def_id", "use_id", "copy_id", latest(F.col("always")).alias("kill"), latest(F.col("def_id").isNotNull()).alias("upto")))


def _met(placed: DataFrame, states: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((state, def_id), (src, dst)): the definitions that may hold in each of ``states`` (state, scope, name, kill, upto), and the states whose definitions may hold there too.

    What a name holds in the end of an outer scope is a state of its own, with a negative number.
    """
    own = placed.where("def_id is not null").select("scope", "name", "kill", "def_id", F.col("position").alias("at"))
    inner = states.where(F.col("upto") > NONE).join(own, ["scope", "name", "kill"]).where("at <= upto").select("state", "def_id")
    # Where no certain definition is before, what is around may hold too.
    up = parents.select(F.col("node").alias("scope"), "up")
    outside = states.where(F.col("kill") == NONE).join(up, "scope").select(F.col("state").alias("ref_id"), F.col("up").alias("scope"), "name")
    bound = own.select("scope", "name").distinct().withColumn("id", F.col("scope"))
    refs = cut(outside)
    holders = scopes.lookup(refs, parents, bound).where("node_id is not null").select("ref_id", F.col("node_id").alias("scope"))
    held = cut(holders.join(refs.select("ref_id", "name"), "ref_id"))
    ends = cut(held.select("scope", "name").distinct().withColumn("end", -1 - F.monotonically_increasing_id()))
    # All definitions from the last one that always happens on: what the name holds in the end.
    asked = own.join(ends, ["scope", "name"])
    last = asked.groupBy("end").agg(F.max("kill").alias("kill"))
    final = asked.join(last, ["end", "kill"]).select(F.col("end").alias("state"), "def_id")
    return cut(inner.unionByName(final)), held.join(ends, ["scope", "name"]).select(F.col("ref_id").alias("src"), F.col("end").alias("dst"))


def arriving(definitions: DataFrame, uses: DataFrame, parents: DataFrame) -> DataFrame:
    """(use_id, n, node_id, unknown): how many callables arrive at each use that any definition meets, the only one of them, and whether something unknown arrives besides.

    ``definitions`` has the columns of ``DEFINITIONS``; ``kind`` is callable (``value`` is a node), name (``value`` is a
    name of the scope) or anything else, which is unknown. ``parents`` has (node, up), the scopes around scopes.

    Uses between the same definitions of a name are one state. What arrives passes from state to state over the copies,
    each callable once, and only then to the uses.
    """
    columns = ["scope", "position", "name", "kind", "value"]
    named = cut(definitions.groupBy(*columns).agg(F.coalesce(F.bool_or("always"), F.lit(False)).alias("always")).withColumn("def_id", F.monotonically_increasing_id()))
    copies = named.where("kind = 'name'").select("scope", "position", F.col("value").alias("name"), F.lit(None).cast("string").alias("use_id"), F.col("def_id").alias("copy_id"))
    asked = uses.select("scope", "position", "name", F.col("use_id").cast("string").alias("use_id"), F.lit(None).cast("long").alias("copy_id"))
    placed = _placed(named, asked.unionByName(copies))
    here = placed.where("def_id is null").select("scope", "name", "upto", "use_id", "copy_id", "kill")
    states = cut(here.select("scope", "name", "upto", "kill").distinct().withColumn("state", F.monotonically_increasing_id()))
    met, links = _met(placed, states, parents)
    links = cut(links)
    met_at_all = cut(met.select("state").unionByName(links.select(F.col("src").alias("state"))).distinct())
    # A copy of a name that nothing defines brings something unknown.
    sources = here.where("copy_id is not null").join(states, ["scope", "name", "upto", "kill"]).join(met_at_all, "state").select(F.col("copy_id").alias("def_id"), F.col("state").alias("copied"))
    brought = F.when(F.col("kind") == "callable", F.concat(F.lit("c"), "value")).when((F.col("kind") == "name") & F.col("copied").isNotNull(), F.lit(None)).otherwise(F.lit("?"))
    does = cut(met.join(named.join(sources, "def_id", "left").select("def_id", brought.alias("brings"), "copied"), "def_id").select("state", "brings", "copied").distinct())
    back = does.where("copied is not null").select(F.col("copied").alias("src"), F.col("state").alias("dst")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = does.where("brings is not null").select(F.col("brings").alias("root"), F.col("state").alias("node"))
    reached = traverse.closure(back, roots, with_roots=True).select(F.col("root").alias("brings"), F.col("node").alias("state"))

    def counted(rows: DataFrame, by: str) -> DataFrame:
        callable_ = F.when(F.col("brings") != "?", F.expr("substring(brings, 2)"))
        return rows.groupBy(by).agg(F.count(callable_).alias("n"), F.min(callable_).alias("only"), F.coalesce(F.bool_or(F.col("brings") == "?"), F.lit(False)).alias("unknown"))

    used = here.where("use_id is not null")
    known = states.join(met_at_all, "state", "left_semi").where(F.col("state") >= 0)
    # A use that stands in several places gets what arrives at any of them.
    often = cut(used.groupBy("use_id").agg(F.count("*").alias("k")).where("k > 1").select("use_id"))
    several = not often.isEmpty()
    once = used.join(often, "use_id", "left_anti") if several else used
    plain = counted(reached, "state")
    answers = known.join(plain, "state", "left").select("scope", "name", "upto", F.coalesce("n", F.lit(0)).alias("n"), "only", F.coalesce("unknown", F.lit(False)).alias("unknown"))
    by = once.join(answers, ["scope", "name", "upto"]).select("use_id", "n", "only", "unknown")
    if several:
        again = used.join(often, "use_id", "left_semi").join(known.select("scope", "name", "upto", "state"), ["scope", "name", "upto"])
        by = by.unionByName(counted(again.join(reached, "state", "left").select("use_id", "brings").distinct(), "use_id"))
    kind = dict(uses.dtypes)["use_id"]
    return by.select(F.col("use_id").cast(kind).alias("use_id"), "n", F.when((F.col("n") == 1) & ~F.col("unknown"), F.col("only")).alias("node_id"), "unknown")


def references(graph: GraphBundle, definitions: DataFrame, uses: DataFrame) -> GraphBundle:
    """``references`` edges from the ``uses`` (use_id, scope, position, name, and the unit ``src``) that one callable alone arrives at; the others that callables arrive at become evidence.

    Scopes are the graph's units by its ``contains`` edges. Running it again changes nothing.
    """
    parents = scopes.tree(graph.edges.where("kind = 'contains'").select("src", "dst"))
    found = cut(uses.select("use_id", "src", "name").join(arriving(definitions, uses, parents).where("n > 0"), "use_id"))
    edges = GraphBundle.conform(graph.edges, "edges")
    high = edges.agg(F.max("edge_seq")).first()[0] or 0
    made = found.where("node_id is not null and node_id <> src").select("src", F.col("node_id").alias("dst"), F.lit("references").alias("kind"), F.lit("inferred").alias("confidence")).distinct()
    made = made.join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti").withColumn("edge_seq", F.lit(high + 1) + F.monotonically_increasing_id())
    several = found.where("node_id is null").select("src", "name").distinct()
    evidence = several.select(F.concat(F.lit("entrypoint:"), F.substring(F.sha2(F.to_json(F.struct("src", "name", F.lit("value-flow"))), 256), 1, 24)).alias("evidence_id"), F.lit("reference").alias("basis"), F.lit("value-flow").alias("rule"), F.col("src").alias("source_id"), F.col("name").alias("symbol"), F.lit("ambiguous").alias("binding"))
    fresh = GraphBundle.conform(evidence.join(graph.evidence.select("evidence_id"), "evidence_id", "left_anti"), "evidence")
    return graph.having(edges=cut(edges.unionByName(GraphBundle.conform(made, "edges"))), evidence=cut(GraphBundle.conform(graph.evidence, "evidence").unionByName(fresh)))

"""Binding limited to what a module sees.

A module sees itself and all that its imports (or includes) lead to. That closure is
never written out module by module: modules that import each other in a cycle see the
same, so it is kept between strongly connected components, and from those alone that
refer to something. A unit of internal linkage answers only to modules that see its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from . import components, traverse

#: A name that more components than these declare is looked for among what is seen, any other one by its declarations.
COMMON = 64


#: A component that none imports and that imports at most so many is seen to see through one of them, where it does.
OUTS = 64


class Sight(NamedTuple):
    """``member`` (module, component) and ``pairs`` (component, target): what is seen from each component asked for.

    Components in ``through`` (component, via) have no pairs: they see themselves and what ``via`` sees.
    """

    member: DataFrame
    pairs: DataFrame
    through: DataFrame | None = None


def sight(imports: DataFrame, modules: DataFrame, either: bool = False, lean: bool = False) -> Sight:
    """What ``modules`` (module) see over ``imports`` (src, dst); with ``either`` also what sees them.

    With ``lean`` components that none imports have pairs only where they see more than one other component and what
    that sees: so many modules that all look into one large cycle are not paired with all that it leads to.
    """
    loops = modules.select(F.col("module").alias("src"), F.col("module").alias("dst"))
    edges = cut(imports.select("src", "dst").unionByName(loops).distinct())
    members = components.strong_components(edges)
    member = members.select(F.col("node").alias("module"), "component")
    seeds = modules.select("module").distinct().join(member, "module").select("component").distinct()
    if lean and not either:
        return _lean(edges, members, member, cut(seeds))
    pairs = components.reach(edges, members, seeds)
    if either:
        back = components.reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), members, seeds)
        pairs = cut(pairs.unionByName(back).distinct())
    return Sight(member, pairs)


def _lean(edges: DataFrame, members: DataFrame, member: DataFrame, seeds: DataFrame) -> Sight:
    """:func:`sight` of the components ``seeds``, with ``through``."""
    links = cut(components.condensed(edges, members))
    tops = cut(links.select("src").distinct().join(links.select(F.col("dst").alias("src")), "src", "left_anti"))
    outs = cut(links.join(tops, "src", "left_semi").join(seeds.select(F.col("component").alias("src")), "src", "left_semi"))
    inner = seeds.join(tops.select(F.col("src").alias("component")), "component", "left_anti").unionByName(outs.select(F.col("dst").alias("component"))).distinct()
    roots = inner.select(F.col("component").alias("root"), F.col("component").alias("node"))
    below = cut(traverse.closure(cut(links.join(tops, "src", "left_anti")), roots, with_roots=True).select(F.col("root").alias("component"), F.col("node").alias("target")))
    # An edge to what another edge's end sees tells nothing new. Components have no cycles, so that one edge is left at least.
    few = outs.join(outs.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") <= OUTS).select("src"), "src", "left_semi")
    both = few.join(few.withColumnRenamed("dst", "component"), "src").where("component <> dst")
    spare = both.join(below.withColumnRenamed("target", "dst"), ["component", "dst"], "left_semi").select("src", "dst").distinct()
    kept = cut(outs.join(spare, ["src", "dst"], "left_anti"))
    via = cut(kept.groupBy(F.col("src").alias("component")).agg(F.count("*").alias("k"), F.min("dst").alias("via")))
    wide = kept.withColumnRenamed("src", "top").join(via.where("k > 1").select(F.col("component").alias("top")), "top", "left_semi")
    seen = wide.withColumnRenamed("dst", "component").join(below, "component").select(F.col("top").alias("component"), "target")
    own = via.where("k > 1").select("component", F.col("component").alias("target"))
    return Sight(member, cut(below.unionByName(seen.distinct()).unionByName(own)), via.where("k = 1").select("component", "via"))


def visible(refs: DataFrame, units: DataFrame, seen: Sight, common: int = COMMON) -> DataFrame:
    """(module, name, n, only): how many of ``units`` (module, name, id) each of ``refs`` (module, name) sees by its name, and the least of them.

    Both joins are by equality: names of few components are joined by name and then checked against what is seen;
    names that very many components declare are looked up component by component of what is seen. Components that see
    through one other are looked up with it, and add what they declare themselves.
    """
    unit = cut(units.join(seen.member, "module").groupBy("name", F.col("component").alias("target")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")))
    ref = refs.select("module", "name").distinct().join(seen.member, "module")
    if seen.through is None:
        ref = ref.withColumn("base", F.col("component"))
    else:
        ref = ref.join(seen.through, "component", "left").withColumn("base", F.coalesce("via", "component")).drop("via")
    ref = cut(ref.select("module", "component", "base", "name"))
    asked = cut(ref.select(F.col("base").alias("component"), "name").distinct())
    often = unit.groupBy("name").agg(F.count("*").alias("k")).where(F.col("k") > common).select("name")
    few = asked.join(often, "name", "left_anti").join(unit, "name").join(seen.pairs, ["component", "target"])
    many = asked.join(often, "name", "left_semi").join(seen.pairs, "component").join(unit.join(often, "name", "left_semi"), ["target", "name"])
    hits = few.select("component", "name", "n", "only").unionByName(many.select("component", "name", "n", "only"))
    found = cut(hits.groupBy(F.col("component").alias("base"), "name").agg(F.sum("n").alias("n"), F.min("only").alias("only")))
    if seen.through is None:
        return ref.join(found, ["base", "name"]).select("module", "name", "n", "only")
    own = unit.join(seen.through.select(F.col("component").alias("target")), "target", "left_semi").select(F.col("target").alias("component"), "name", F.col("n").alias("n_own"), F.col("only").alias("own"))
    out = ref.join(found, ["base", "name"], "left").join(own, ["component", "name"], "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("n_own", F.lit(0))
    return out.select("module", "name", total.alias("n"), F.least("only", "own").alias("only")).where("n > 0")


def few_visible(refs: DataFrame, units: DataFrame, imports: DataFrame, groups: Column, k: int = 2) -> DataFrame:
    """(module, name, group, n, only): how many of ``units`` each of ``refs`` (module, name) sees by its name in each group, counted to ``k``, and the least of them.

    ``groups`` is a column over ``units`` (module, name, id). Only the ``k`` least ids of a name pass from component to
    component, so that what is seen is never paired with who sees it.
    """
    loops = refs.select(F.col("module").alias("src"), F.col("module").alias("dst")).distinct()
    edges = cut(imports.select("src", "dst").unionByName(loops).distinct())
    members = cut(components.strong_components(edges).select(F.col("node").alias("module"), "component"))
    wanted = refs.select("name").distinct()
    own = units.withColumn("group", groups).join(wanted, "name", "left_semi").join(members, "module")
    own = own.select("component", F.struct("name", "group").alias("name"), F.col("id").alias("value"))
    lists = components.least(components.condensed(edges, members.withColumnRenamed("module", "node")), own, k)
    counts = cut(lists.groupBy("component", F.col("name.name").alias("name"), F.col("name.group").alias("group")).agg(F.count("*").alias("n"), F.min("value").alias("only")))
    return refs.select("module", "name").distinct().join(members, "module").join(counts, ["component", "name"]).select("module", "name", "group", "n", "only")


def matches(refs: DataFrame, units: DataFrame, imports: DataFrame, either: bool = False) -> DataFrame:
    """(ref_id, node_id, n) of the ``refs`` (ref_id, module, name) that see a unit of their name; ``node_id`` where it is the only one.

    ``units`` has (module, name, id, internal): those that are not internal answer to every module, and are counted
    once a name.
    """
    refs, units = cut(refs.select("ref_id", "module", "name")), cut(units)
    open_ = units.where("not internal").groupBy("name").agg(F.count_distinct("id").alias("n_open"), F.min("id").alias("open"))
    inner = units.where("internal").select("module", "name", "id")
    out = refs.join(open_, "name", "left")
    if inner.isEmpty():
        out = out.withColumns({"n": F.lit(0).cast("long"), "only": F.lit(None).cast("string")})
    else:
        # Only what may meet is looked at: modules that ask for a name of an inner unit.
        asking = refs.join(inner.select("name").distinct(), "name", "left_semi").select("module", "name")
        seen = sight(imports, cut(asking.select("module").distinct()), either, lean=True)
        out = out.join(visible(asking, inner, seen), ["module", "name"], "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("n_open", F.lit(0))
    return out.select("ref_id", F.when(total == 1, F.coalesce("only", "open")).alias("node_id"), total.alias("n")).where("n > 0")


def file_imports(graph: GraphBundle) -> DataFrame:
    """(src, dst): which file imports or includes which, from the graph's ``imports`` edges.

    An edge names a module of the graph, or a path: as it is, or from the importing file's folder.
    """
    modules = GraphBundle.conform(graph.nodes, "nodes").where("kind = 'module'")
    files = modules.select("id", F.col("file_path").alias("path")).where("path is not null")
    edges = graph.edges.where("kind = 'imports'").select("src", F.col("dst").alias("named")).distinct()
    here = edges.join(files.select(F.col("id").alias("src"), F.col("path").alias("from")), "src")
    by_id = here.join(files.withColumnRenamed("id", "named"), "named").select("from", "path")
    joined = F.concat(F.regexp_replace("from", r"[^/]*$", ""), "named")
    # "./" goes; "folder/../" goes as often as a path of sixteen folders may need it.
    plain = F.regexp_replace(joined, r"(?<=^|/)\./", "")
    for _ in range(16):
        plain = F.regexp_replace(plain, r"(?<=^|/)(?!\.\./)[^/]+/\.\./", "")
    paths = here.select("from", F.explode(F.array("named", plain)).alias("path")).join(files.select("path").distinct(), "path", "left_semi")
    return by_id.select(F.col("from").alias("src"), F.col("path").alias("dst")).unionByName(paths.select(F.col("from").alias("src"), F.col("path").alias("dst"))).distinct()

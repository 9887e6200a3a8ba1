"""Passes that annotate a graph: blast radius, entrypoint reach, privilege boundaries, taint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut, dealt, numbered, wide
from . import components, traverse, views

THRESHOLD = 10
SOURCE = "preanalysis"
GROUPS = ("high_blast_radius", "entrypoints", "entrypoint_reachable", "privilege_boundary", "tainted")
#: How many numbers of components a block of lists has, if there are then at most BLOCKS blocks: a list that crosses an
#: edge is a row for each block, so that their number must not grow with the graph.
BLOCK = 1 << traverse.BITS
BLOCKS = 8


def _numbered(proj: DataFrame, nodes: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, members, condensed edges) of the graph that ``proj`` and ``nodes`` make.

    ``numbers`` (id, n, asked, cc) counts nodes down by (cc, id), so that of numbers the least is the most complex node;
    all else is between numbers. ``limit`` refuses larger graphs if given.
    """
    _limited(nodes, limit)
    proj = cut(proj.select("src", "dst"))
    order = [F.desc("cc"), F.desc("id")]
    numbers = numbered(cut(_asked(proj, nodes)).repartitionByRange(*order).sortWithinPartitions(*order), "n")
    edges = cut(_between(proj, numbers).distinct())
    members = components.strong_components(edges)
    # Without cycles a graph is what it condenses to.
    whole = members.where("node <> component").isEmpty()
    return numbers, members, edges.where("src <> dst") if whole else cut(components.condensed(edges, members))


def _limited(nodes: DataFrame, limit: int | None) -> None:
    if limit is not None and (n := nodes.count()) > limit:
        raise ValueError(f"all pairs of {n} nodes are asked for; at most {limit} are allowed")


def _asked(proj: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(id, cc, asked): the nodes, each once, and the ends of ``proj`` that are none (0 asked)."""
    cc = F.col("cc").cast("int") if "cc" in nodes.columns else F.lit(None).cast("int")
    both = nodes.select("id", cc.alias("cc"), F.lit(1).alias("asked"))
    if proj is not None:
        ends = proj.select(F.col("src").alias("id")).unionByName(proj.select(F.col("dst").alias("id"))).distinct()
        both = both.unionByName(ends.select("id", F.lit(None).cast("int").alias("cc"), F.lit(0).alias("asked")))
    return both.groupBy("id").agg(F.max("cc").alias("cc"), F.sum("asked").alias("asked"))


def _between(proj: DataFrame, numbers: DataFrame) -> DataFrame:
    """(src, dst): the edges between numbers; those whose ends have none are left out."""
    name = lambda end: numbers.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"))
    return proj.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"))


def blast_radius(proj: DataFrame, nodes: DataFrame, limit: int | None = None, block: int = BLOCK, within: bool = False) -> DataFrame:
    """(node, downstream, upstream) for each node of ``nodes``, with 0 where nothing is reached; upstream counts those of ``nodes`` that reach it.

    The nodes of a cycle reach the same, so that pairs are taken between components, and never written out: the numbers
    of components travel as lists (:func:`traverse.lists`), in blocks of about ``block`` numbers, at most :data:`BLOCKS`
    of them. With ``within`` any edges of a stored table may be given: only those between nodes count.
    """
    _limited(nodes, limit)
    proj = proj.select("src", "dst") if within else cut(proj.select("src", "dst"))
    numbers = numbered(_asked(None if within else proj, nodes).drop("cc"), "n")
    steps = dealt(_between(proj, numbers), "src", wide(proj))
    cyclic = components.untrimmed(steps)
    if cyclic is None:
        # Without cycles a graph is what it condenses to.
        own = numbers.select("id", "asked", F.col("n").alias("component"))
        sizes = own.select("component", F.lit(1).cast("long").alias("size"), F.col("asked").alias("asking"))
        steps = steps.where("src <> dst")
    else:
        members = numbers.select(F.col("n").alias("node")).join(cyclic, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        members = cut(members)
        own = cut(numbers.join(members, F.col("n") == F.col("node")).select("id", "asked", "component"))
        sizes = cut(own.groupBy("component").agg(F.count("*").alias("size"), F.sum("asked").alias("asking")))
        condensed = cut(components.condensed(steps, members))
        steps = dealt(condensed, "src", wide(condensed))
    total = numbers.count()
    bits = max(1, (max(block, -(-total // BLOCKS)) - 1).bit_length())
    found = traverse.lists(steps, sizes.where("asking > 0").select(F.col("component").alias("n"), F.col("component").alias("node")), apart=True, bits=bits)
    down = traverse.counted(found, bits).select(F.col("n").alias("component"), F.col("times").alias("downstream"), F.lit(0).alias("upstream"))
    up = found.select(F.col("node").alias("component"), F.lit(0).alias("downstream"), F.size("roots").alias("upstream"))
    both = down.unionByName(up)
    # Each component counted as one node so far; what others have more or less is added for the pairs that they are in.
    odd = cut(sizes.where("size <> 1 or asking <> 1"))
    plain = odd.isEmpty()
    if not plain:
        more = odd.select("component", F.col("size") - 1, F.col("asking") - 1).toDF("of", "size", "asking")
        ends = traverse.members(found.join(more, F.col("node") == F.col("of"), "left_semi"), bits).join(more, F.col("node") == F.col("of"))
        starts = traverse.members(found, bits).join(more.where("asking <> 0"), F.col("n") == F.col("of"))
        both = both.unionByName(ends.select(F.col("n").alias("component"), F.col("size").alias("downstream"), F.lit(0).alias("upstream")))
        both = both.unionByName(starts.select(F.col("node").alias("component"), F.lit(0).alias("downstream"), F.col("asking").alias("upstream")))
        # A node does not count as reached by itself, but by the others of its component.
        both = both.unionByName(more.select(F.col("of").alias("component"), F.col("size").alias("downstream"), F.col("asking").alias("upstream")))
    counts = cut(both.groupBy("component").agg(F.sum("downstream").alias("downstream"), F.sum("upstream").alias("upstream")))
    out = own.where("asked > 0").join(counts, "component", "left")
    node = F.col("id") if plain else F.explode(F.array_repeat("id", F.col("asked").cast("int")))
    return out.select(node.alias("node"), F.coalesce("downstream", F.lit(0)).cast("long").alias("downstream"), F.coalesce("upstream", F.lit(0)).cast("long").alias("upstream"))


def critical(proj: DataFrame, nodes: DataFrame, top: int = 5, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """(root, node, cc, place): of what each node reaches the ``top`` most complex (cc above 0), by (cc, id) falling.

    No pairs are made: lists of one more than ``top`` pass from component to component (:func:`components.least`). The
    nodes of a component share one list, from which each leaves itself out. ``block`` is for callers of
    :func:`blast_radius`; bounded lists need no blocks.
    """
    numbers, members, condensed = _numbered(proj, nodes, limit)
    own = cut(numbers.join(members, numbers.n == members.node).select("id", "n", "component", "asked", "cc"))
    complex_ = own.where("asked > 0 and cc > 0").select("component", F.lit("").alias("name"), F.col("n").alias("value"))
    lists = components.least(condensed, complex_, top + 1).select("component", F.col("value").alias("n"))
    rows = own.where("asked > 0").select(F.col("id").alias("root"), F.col("n").alias("self"), "component").join(lists, "component").where("self <> n")
    place = F.row_number().over(Window.partitionBy("self").orderBy("n"))
    best = rows.withColumn("place", place).where(F.col("place") <= top)
    return best.join(numbers.select("n", F.col("id").alias("node"), "cc"), "n").select("root", "node", "cc", "place")


def entrypoint_reach(graph: GraphBundle, by: str = "trust_level") -> DataFrame:
    """(label, node): nodes that the live entrypoints of each label reach, the entrypoints included."""
    live = graph.entrypoints.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    roots = live.select(F.col(by).alias("root"), F.col("node_id").alias("node"))
    numbers, found = traverse.sets(views.raw_calls(graph), roots, graph.nodes)
    return traverse.members(found).join(numbers, "n").select(F.col("root").alias("label"), "node")


def trust_sets(reach: DataFrame) -> DataFrame:
    """(node, trust): the sorted labels that reach a node, joined by '+'."""
    return reach.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("label")), "+").alias("trust"))


def privilege_boundaries(graph: GraphBundle, reach: DataFrame | None = None) -> DataFrame:
    """(src, dst, src_trust, dst_trust, edge_seq): call sites whose ends have different, known trust sets.

    What is reached exists, so that the joins with the trust sets are the check of both ends.
    """
    sets = cut(trust_sets(entrypoint_reach(graph) if reach is None else reach))
    calls = graph.edges.where("kind = 'calls'").select("edge_seq", "src", "dst")
    a = sets.select(F.col("node").alias("src"), F.col("trust").alias("src_trust"))
    b = sets.select(F.col("node").alias("dst"), F.col("trust").alias("dst_trust"))
    return calls.join(a, "src").join(b, "dst").where("src_trust <> dst_trust").select("src", "dst", "src_trust", "dst_trust", "edge_seq")


def _tainting(graph: GraphBundle) -> tuple[DataFrame, DataFrame]:
    low = graph.entrypoints.where("trust_level <> 'trusted_internal'").join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return traverse.sets(views.raw_calls(graph), low.select(F.col("node_id").alias("root"), F.col("node_id").alias("node")), graph.nodes)


def taint_reach(graph: GraphBundle) -> DataFrame:
    """(root, node): what each entrypoint below internal trust reaches, itself included."""
    numbers, found = _tainting(graph)
    return traverse.members(found).join(numbers, "n").select("root", "node")


def taint_counts(graph: GraphBundle) -> DataFrame:
    """(node, n): how many entrypoints below internal trust reach each node that any of them reaches; no pairs are written out."""
    return _tainting(graph)[1].groupBy("node").agg(F.sum(F.size("roots").cast("long")).alias("n"))


def taint(graph: GraphBundle) -> DataFrame:
    """(node, via): nodes that entrypoints below internal trust reach, with those entrypoints sorted."""
    return taint_reach(graph).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("root")), ", ").alias("via"))


def run(graph: GraphBundle, threshold: int = THRESHOLD, limit: int | None = None, block: int = BLOCK) -> GraphBundle:
    """The four passes: what an earlier run left is dropped, annotations and subgraphs are added."""
    notes = graph.annotations.where(F.col("source") != SOURCE)
    groups = graph.subgraphs.where(~F.col("name").isin(*GROUPS) & ~F.col("name").startswith("entrypoints:"))
    radius = cut(blast_radius(views.projected(graph), graph.nodes.where("kind <> 'proxy'"), limit, block))
    reach = cut(entrypoint_reach(graph))
    edge = cut(privilege_boundaries(graph, reach))
    tainted = cut(taint(graph))
    wide = F.greatest("downstream", "upstream") >= threshold
    ends = edge.select(F.col("src").alias("node_id"), "src_trust", "dst_trust", "edge_seq").unionByName(edge.select(F.col("dst").alias("node_id"), "src_trust", "dst_trust", "edge_seq"))
    worst = critical(views.projected(graph), graph.nodes.where("kind <> 'proxy'"), 5, limit, block)
    five = worst.groupBy(F.col("root").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda r: r["node"]), ", ").alias("five"))
    text = F.concat(F.format_string("%d downstream, %d upstream", "downstream", "upstream"), F.coalesce(F.concat(F.lit("; most complex downstream: "), "five"), F.lit("")))
    added = radius.join(five, "node", "left").select(F.col("node").alias("node_id"), F.lit("blast_radius").alias("kind"), text.alias("description"))
    added = added.unionByName(ends.select("node_id", F.lit("privilege_boundary").alias("kind"), F.concat_ws(" -> ", "src_trust", "dst_trust").alias("description")))
    added = added.unionByName(tainted.select(F.col("node").alias("node_id"), F.lit("taint_propagation").alias("kind"), F.concat(F.lit("tainted via: "), "via").alias("description")))
    next_seq = F.row_number().over(Window.partitionBy("node_id").orderBy("kind", "description")) + F.lit(1 << 20)
    notes = notes.unionByName(added.withColumn("source", F.lit(SOURCE)).withColumn("seq", next_seq.cast("long")).select("node_id", "seq", "kind", "description", "source"))
    live = graph.entrypoints.join(graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    named = radius.where(wide).select(F.lit("high_blast_radius").alias("name"), F.col("node").alias("node_id"))
    for more in (
        live.select(F.lit("entrypoints").alias("name"), "node_id"),
        live.select(F.concat(F.lit("entrypoints:"), "trust_level").alias("name"), "node_id"),
        reach.select(F.lit("entrypoint_reachable").alias("name"), F.col("node").alias("node_id")),
        ends.select(F.lit("privilege_boundary").alias("name"), "node_id"),
        tainted.select(F.lit("tainted").alias("name"), F.col("node").alias("node_id")),
    ):
        named = named.unionByName(more)
    return graph.having(annotations=cut(notes), subgraphs=cut(groups.unionByName(named).distinct()))

"""Set-oriented passes that bind references or make what they lack explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut, tasks
from ..functions.text import digest, escaped, last_segment
from . import scopes, traverse, visibility

PREFIX = "proxy.unresolved:"


def proxy_ids(symbols: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(symbol, id): ids of proxies; where escaping makes two symbols equal (or the id is taken) each gets a digest."""
    named = symbols.select("symbol").distinct().withColumn("plain", F.concat(F.lit(PREFIX), escaped(F.col("symbol"))))
    shared = F.count("*").over(Window.partitionBy("plain")) > 1
    if taken is not None:
        named = named.join(taken.select(F.col("id").alias("plain"), F.lit(True).alias("used")).distinct(), "plain", "left")
        shared = shared | F.col("used").isNotNull()
    return named.select("symbol", F.when(shared, F.concat("plain", F.lit("__"), digest(F.col("symbol"), 16))).otherwise(F.col("plain")).alias("id"))


def materialise_proxies(graph: GraphBundle) -> GraphBundle:
    """Calls to what does not exist point to proxy nodes afterwards; running it again changes nothing."""
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("known"))
    dangling = edges.where("kind = 'calls'").join(known, "dst", "left_anti")
    ids = cut(proxy_ids(dangling.select(F.col("dst").alias("symbol")), nodes.where("kind <> 'proxy'")))
    first = dangling.groupBy("dst").agg(F.min_by(F.struct("file_path", "start_line"), "edge_seq").alias("at"))
    high = nodes.agg(F.max("node_seq")).first()[0] or 0
    made = ids.join(first, ids.symbol == first.dst).join(nodes.select("id"), "id", "left_anti")
    made = made.select(
        (F.lit(high + 1) + F.monotonically_increasing_id()).alias("node_seq"),
        "id", F.col("symbol").alias("name"), F.lit("proxy").alias("kind"), F.lit("proxy").alias("origin"), F.col("at.file_path").alias("file_path"), F.col("at.start_line").alias("start_line"),
        F.to_json(F.struct(F.lit("unresolved").alias("proxy_kind"), F.col("symbol").alias("raw_symbol"))).alias("attrs"),
    )
    bound = edges.join(ids.withColumnRenamed("id", "proxy"), (edges.dst == ids.symbol) & (edges.kind == "calls"), "left")
    raw = F.when(F.col("proxy").isNotNull(), F.to_json(F.map_concat(F.coalesce(F.from_json("attrs", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), F.create_map(F.lit("raw_target"), F.col("dst"))))).otherwise(F.col("attrs"))
    bound = bound.withColumn("attrs", raw).withColumn("dst", F.coalesce("proxy", "dst")).drop("proxy", "symbol")
    return graph.having(nodes=nodes.unionByName(GraphBundle.conform(made, "nodes")), edges=GraphBundle.conform(bound, "edges"))


def unique_matches(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref columns, node_id, confidence): bound if exactly one of ``index`` (name, id) matches ``ref``; several leave it uncertain."""
    hits = index.groupBy(F.col("name").alias("ref")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    out = refs.join(hits, "ref", "left")
    return out.withColumn("node_id", F.when(F.col("n") == 1, F.col("only"))).withColumn("confidence", F.when(F.col("n") == 1, "inferred").when(F.col("n") > 1, "uncertain")).drop("n", "only")


def tiered_matches(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref_id, node_id): ``refs`` (ref_id, tiers: array of arrays of names); the first tier with any hit decides, even if ambiguous."""
    names = refs.select("ref_id", F.posexplode("tiers").alias("tier", "names")).select("ref_id", "tier", F.explode("names").alias("name"))
    hits = names.join(index.select("name", "id").distinct(), "name")
    by_tier = hits.groupBy("ref_id", "tier").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    best = by_tier.groupBy("ref_id").agg(F.min_by(F.struct("n", "id"), "tier").alias("b"))
    return best.where("b.n = 1").select("ref_id", F.col("b.id").alias("node_id"))


#: Languages whose files call one another's units.
FAMILIES = {"c": "c", "cpp": "c", "objc": "c", "javascript": "script", "typescript": "script", "java": "jvm", "kotlin": "jvm"}


def family(language: str = "language") -> Column:
    """The group of languages that a node may be bound within; nodes without a language form one of their own."""
    out = F.coalesce(F.col(language), F.lit(""))
    for name, group in FAMILIES.items():
        out = F.when(F.col(language) == name, F.lit(group)).otherwise(out)
    return out


def _within_family(key: Column, language: str = "language") -> Column:
    return F.concat_ws("|", family(language), key)


def lexical_calls(graph: GraphBundle) -> GraphBundle:
    """Calls marked with a ``bare_name`` bind to the callable of that name in the nearest unit around them, the caller included.

    One that the nearest such unit declares more than once points to its overloads, uncertain.
    """
    nodes, edges = graph.nodes, GraphBundle.conform(graph.edges, "edges")
    bare = F.get_json_object("attrs", "$.bare_name")
    calls = edges.where("kind = 'calls'").where(bare.isNotNull() & _unblocked("binding_blocked"))
    if calls.isEmpty():
        return graph
    contains = edges.where("kind = 'contains'").select("src", "dst")
    callables = nodes.where("kind in ('function', 'method')").select(F.col("id").alias("dst"), "name")
    declared = contains.join(callables, "dst").select(F.col("src").alias("scope"), "name", F.col("dst").alias("id"))
    found = scopes.lookup(calls.select(F.col("edge_seq").alias("ref_id"), F.col("src").alias("scope"), bare.alias("name")), scopes.tree(contains), declared)
    several = found.where("n > 1").select("ref_id")
    at = found.select(F.col("ref_id").alias("edge_seq"), "node_id", F.col("n").alias("__n"))
    owner = _overload_owners(calls, several, contains, declared)
    out = edges.join(at, "edge_seq", "left").join(owner, "edge_seq", "left")
    out = out.withColumn("dst", F.coalesce("node_id", F.concat("__owner", F.lit("."), bare, F.lit("@overload")), "dst"))
    out = out.withColumn("confidence", F.when(F.col("node_id").isNotNull(), "certain").when(F.col("__n") > 1, "uncertain").otherwise(F.col("confidence")))
    return graph.having(edges=GraphBundle.conform(out, "edges"))


def _overload_owners(calls: DataFrame, several: DataFrame, contains: DataFrame, declared: DataFrame) -> DataFrame:
    """(edge_seq, __owner): the unit that declares the name of a call more than once."""
    asked = calls.join(several, F.col("edge_seq") == F.col("ref_id"), "left_semi").select(F.col("edge_seq").alias("ref_id"), F.col("src").alias("scope"), F.get_json_object("attrs", "$.bare_name").alias("name"))
    owners = declared.select("scope", "name", F.col("scope").alias("id")).distinct()
    return scopes.lookup(asked, scopes.tree(contains), owners).select(F.col("ref_id").alias("edge_seq"), F.col("node_id").alias("__owner"))


#: Attributes of a call that keep it from being bound by its name.
BLOCKED = ("binding_blocked", "import_binding", "circom_dependency")


def _unblocked(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & F.coalesce(F.get_json_object("attrs", f"$.{name}"), F.lit("false")).isin("false", "", "0", "null")
    return (F.coalesce("attrs", F.lit("{}")) == "{}") | out


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def free_functions(graph: GraphBundle) -> DataFrame:
    """(id, name, language, file_path, attrs) of what a bare call may mean in another file.

    These are functions that no callable holds; in Python, what a module's name is bound to last: a function or a class.
    """
    nodes = GraphBundle.conform(graph.nodes, "nodes")
    owners = graph.edges.where("kind = 'contains'").select(F.col("src").alias("owner"), F.col("dst").alias("id"))
    kinds = nodes.select(F.col("id").alias("owner"), F.col("kind").alias("owner_kind"))
    held = owners.join(kinds, "owner").groupBy("id").agg(F.bool_or(F.col("owner_kind").isin("function", "method")).alias("in_callable"), F.bool_or(F.col("owner_kind") != "module").alias("in_unit"))
    python = F.coalesce(F.col("language") == "python", F.lit(False))
    inside = F.when(python, F.col("in_unit")).otherwise(F.col("in_callable"))
    units = nodes.where("kind = 'function' or kind = 'class' and language = 'python'").join(held, "id", "left").where(~F.coalesce(inside, F.lit(False)))
    last = F.max_by("id", F.struct(F.coalesce("start_line", F.lit(0)), F.coalesce("start_col", F.lit(0)), "id"))
    final = units.where(python).groupBy("file_path", "name").agg(last.alias("id"))
    return units.join(final.select("id", F.lit(True).alias("final")), "id", "left").where(~python | F.col("final")).select("id", "name", "language", "file_path", "attrs")


def cross_file_calls(graph: GraphBundle) -> GraphBundle:
    """Calls to bare names that no unit has bind to the one free function of that name that they see (inferred).

    The languages of a family bind together. A name with a receiver is never matched by its last part: only
    'module.f' goes to f of a module that the caller's module imports, and 'Type.method', where a file states the
    type, to that method. An uncertain call stays uncertain; several candidates make a call uncertain. Functions of
    internal linkage are seen from their own file and from files that include it or are included by it (through
    any number of files); those of headers also from elsewhere, if nothing better answers. Go functions are seen
    within their package's folder.
    """
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    loose = edges.where("kind = 'calls'").where(_unblocked(*BLOCKED)).join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")
    callers = nodes.select(F.col("id").alias("src"), "language", "file_path", F.get_json_object("attrs", "$.go_package").alias("package"))
    loose = cut(loose.select("edge_seq", "src", "dst").join(callers, "src").where("coalesce(language, '') <> 'erlang'"))
    tail = F.substring_index("dst", ":", -1)
    bare = ~F.col("dst").contains("::") & ~F.col("dst").contains("->") & ~tail.contains(".")
    in_package = lambda package, key: F.when(package.isNotNull(), F.concat_ws("|", F.lit("go"), _folder(F.col("file_path")), package, key)).otherwise(_within_family(key))
    refs = loose.where(bare).select(F.col("edge_seq").alias("ref_id"), F.coalesce("file_path", F.lit("")).alias("module"), in_package(F.col("package"), tail).alias("name"))

    free = free_functions(graph)
    fact = lambda name: F.get_json_object("attrs", f"$.{name}")
    c = F.coalesce(F.col("language").isin("c", "cpp", "objc"), F.lit(False))
    internal = F.coalesce(fact("internal_linkage") == "true", F.lit(False)) | c & F.coalesce(fact("signature").rlike(r"^(inline\s+)?static\b"), F.lit(False))
    header = internal & F.coalesce(F.col("file_path").rlike(r"\.(h|hh|hpp|hxx)$"), F.lit(False)) & ~F.col("id").contains("$anonymous")
    free = free.select("id", F.coalesce("file_path", F.lit("")).alias("module"), internal.alias("internal"), header.alias("header"), _within_family(F.col("name")).alias("name"), F.when(fact("go_package").isNotNull(), in_package(fact("go_package"), F.col("name"))).alias("packaged"))
    units = cut(free.select("module", "name", "id", "internal", "header").unionByName(free.where("packaged is not null").select("module", F.col("packaged").alias("name"), "id", "internal", "header")))
    found = visibility.matches(refs, units, visibility.file_imports(graph), either=True).withColumn("unverified", F.lit(False))
    headers = units.where("header").groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    # What names a header's function is looked at alone.
    maybe = cut(refs.join(headers.select("name"), "name", "left_semi"))
    loosely = maybe.join(found.join(maybe.select("ref_id"), "ref_id", "left_semi").select("ref_id"), "ref_id", "left_anti") if not maybe.isEmpty() else maybe
    loosely = loosely.join(headers, "name").select("ref_id", F.when(F.col("n") == 1, F.col("only")).alias("node_id"), "n", F.lit(True).alias("unverified"))

    receivers = loose.where(~bare)
    own = F.regexp_replace(F.substring_index("id", ":", -1), r"@\d+_\d+", "")
    methods = nodes.where("kind = 'method'").where(F.size(F.split(own, r"\.")) > 1).select(_within_family(F.substring_index(own, ".", -2)).alias("ref"), "id")
    typed = receivers.where(F.col("dst").rlike(r"^[A-Z]\w*\.\w+$")).select(F.col("edge_seq").alias("ref_id"), _within_family(F.col("dst")).alias("ref"))
    typed = unique_matches(typed, methods.withColumnRenamed("ref", "name")).where("confidence is not null")
    imported = edges.where("kind = 'imports'").select(F.substring_index("src", ":", 1).alias("importer"), F.col("dst").alias("imported")).distinct()
    imported = imported.select("importer", "imported", F.explode(F.array_distinct(F.array("imported", last_segment(F.col("imported"))))).alias("qualifier"))
    qualified = receivers.where("dst like '%.%'").select("edge_seq", F.substring_index("src", ":", 1).alias("importer"), F.expr("substring(dst, 1, length(dst) - length(substring_index(dst, '.', -1)) - 1)").alias("qualifier"), F.substring_index("dst", ".", -1).alias("last"))
    named = qualified.join(imported, ["importer", "qualifier"]).select("edge_seq", F.concat_ws(":", "imported", "last").alias("id")).join(units.select("id"), "id", "left_semi")
    modular = named.groupBy(F.col("edge_seq").alias("ref_id")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("only")).select("ref_id", F.when(F.col("n") == 1, F.col("only")).alias("node_id"), "n")

    pick = lambda df, unverified: df.select(F.col("ref_id").alias("edge_seq"), "node_id", unverified.alias("unverified"))
    never = F.lit(False)
    bound = pick(found, never).unionByName(pick(loosely, F.col("unverified"))).unionByName(pick(modular, never)).unionByName(pick(typed.join(modular.select("ref_id"), "ref_id", "left_anti"), never))
    out = edges.join(cut(bound), "edge_seq", "left")
    grade = F.when(F.col("unverified").isNull(), F.col("confidence")).when(F.col("node_id").isNull() | (F.col("confidence") == "uncertain"), "uncertain").otherwise("inferred")
    marked = F.to_json(F.map_concat(F.coalesce(F.from_json("attrs", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), F.create_map(F.lit("include_unverified"), F.lit("true"))))
    out = out.withColumn("attrs", F.when(F.col("unverified") & F.col("node_id").isNotNull(), marked).otherwise(F.col("attrs"))).withColumn("confidence", grade).withColumn("dst", F.coalesce("node_id", "dst"))
    return graph.having(edges=GraphBundle.conform(out, "edges"))


def _type_scopes(graph: GraphBundle, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the tree of units, (scope, name, id) of the types that each unit declares)."""
    contains = graph.edges.where("kind = 'contains'").select("src", "dst")
    return scopes.tree(contains), contains.join(types.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("scope"), "name", F.col("dst").alias("id"))


def inheritance_links(graph: GraphBundle) -> GraphBundle:
    """inherits and implements edges bind to types: the nearest one of that name in an enclosing type, else what they name exactly, else the own module's, else the one type of that name."""
    from ..schema import TYPE_KINDS

    edges = GraphBundle.conform(graph.edges, "edges")
    types = graph.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("name", "id", "language")
    bases = edges.where(F.col("kind").isin("inherits", "implements")).where(_unblocked("exact_target"))
    if bases.isEmpty():
        return graph
    raw = F.substring_index("dst", ":", -1)
    # Types around the deriving one, from its owner outwards; what modules declare is left to the steps after.
    tree, declared = _type_scopes(graph, types)
    inner = declared.join(types.select(F.col("id").alias("scope")), "scope", "left_semi")
    start = bases.where(~raw.contains(".")).join(tree.select(F.col("node").alias("src"), "up"), "src")
    near = scopes.lookup(start.select(F.col("edge_seq").alias("ref_id"), F.col("up").alias("scope"), raw.alias("name")), tree, inner).where("node_id is not null").select("ref_id", "node_id")
    near = cut(near.groupBy("ref_id").agg(F.min("node_id").alias("node_id")))
    loose = bases.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").join(near.select(F.col("ref_id").alias("edge_seq")), "edge_seq", "left_anti")
    loose = loose.join(graph.nodes.select(F.col("id").alias("src"), "language"), "src", "left")
    module = F.concat(F.substring_index("src", ":", 1), F.lit(":"), last_segment(F.col("dst")))
    tiers = loose.select(F.col("edge_seq").alias("ref_id"), F.array(F.array(module), F.array(_within_family(last_segment(F.col("dst"))))).alias("tiers"))
    index = types.select(_within_family(F.col("name")).alias("name"), "id").unionByName(types.select(F.col("id").alias("name"), "id"))
    found = tiered_matches(tiers, index).unionByName(near).select(F.col("ref_id").alias("edge_seq"), "node_id")
    out = edges.join(found, "edge_seq", "left").withColumn("confidence", F.when(F.col("node_id").isNotNull(), "inferred").otherwise(F.col("confidence"))).withColumn("dst", F.coalesce("node_id", "dst"))
    return graph.having(edges=GraphBundle.conform(out, "edges"))


def type_uses(graph: GraphBundle) -> GraphBundle:
    """type_uses edges from units to the types that their references name; one edge a unit and type.

    A reference with a module means that module's type; any other one the type of that name in the nearest unit
    around it (its own unit first). What neither finds is looked for in the own module, then anywhere in the family.
    """
    from ..schema import TYPE_KINDS

    types = graph.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("name", "id", "language")
    index = types.select(_within_family(F.col("name")).alias("name"), "id").unionByName(types.select(F.col("id").alias("name"), "id"))
    # Equal references of a unit are one.
    plain = graph.type_refs.select("node_id", "name", "module").join(graph.nodes.select(F.col("id").alias("node_id"), "language"), "node_id", "left")
    refs = cut(plain.distinct())
    tree, declared = _type_scopes(graph, types)
    near = refs.where("module is null").select(F.struct("node_id", "name").alias("ref_id"), F.col("node_id").alias("scope"), "name").distinct()
    near = cut(scopes.lookup(near, tree, declared).select("ref_id.node_id", F.col("ref_id.name").alias("name"), F.col("node_id").alias("dst")))
    if near.isEmpty():
        rest, bound = refs, None
    else:
        inner = refs.where("module is null").join(near, ["node_id", "name"])
        rest = refs.where("module is not null").unionByName(refs.where("module is null").join(near.select("node_id", "name"), ["node_id", "name"], "left_anti"))
        bound = inner.where("dst is not null").select(F.col("node_id").alias("src"), "dst")
    # What is asked for outside depends on the own module, the family and the name alone, which very many references share.
    keys = ["own", "family", "name", "module"]
    rest = rest.select(F.col("node_id").alias("src"), F.substring_index("node_id", ":", 1).alias("own"), family().alias("family"), "name", "module")
    asks = rest.select(*keys).distinct()
    qualified = F.when(F.col("module").isNotNull(), F.array(F.concat_ws(":", "module", "name"))).otherwise(F.array().cast("array<string>"))
    tiers = F.array(qualified, F.array(F.concat("own", F.lit(":"), "name")), F.array(F.concat_ws("|", "family", "name")))
    found = cut(tiered_matches(asks.select(F.struct(*keys).alias("ref_id"), tiers.alias("tiers")), index).select(*[F.col(f"ref_id.{k}").alias(f"of {k}") for k in keys], F.col("node_id").alias("dst")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"of {k}")) if k == "module" else F.col(k) == F.col(f"of {k}"))
    pairs = rest.join(found, same).select("src", "dst")
    pairs = (pairs if bound is None else pairs.unionByName(bound)).where("src <> dst").distinct()
    edges = GraphBundle.conform(graph.edges, "edges")
    fresh = pairs.join(edges.where("kind = 'type_uses'").select("src", "dst"), ["src", "dst"], "left_anti")
    high = edges.agg(F.max("edge_seq")).first()[0] or 0
    made = fresh.withColumns({"kind": F.lit("type_uses"), "confidence": F.lit("inferred"), "edge_seq": F.lit(high + 1) + F.monotonically_increasing_id()})
    return graph.having(edges=edges.unionByName(GraphBundle.conform(cut(made), "edges")))


def deferred_calls(graph: GraphBundle) -> GraphBundle:
    """An uncertain call from each callable to those nested in it that nothing else connects."""
    nodes, edges = graph.nodes, GraphBundle.conform(graph.edges, "edges")
    callables = nodes.where("kind in ('function', 'method') and coalesce(get_json_object(attrs, '$.executable'), 'true') <> 'false'").select("id")
    owners = traverse.nearest_owner(edges.where("kind = 'contains'").select("src", "dst"), callables)
    nested = owners.join(callables, owners.node == callables.id, "left_semi").select(F.col("owner").alias("src"), F.col("node").alias("dst"))
    fresh = nested.join(edges.where("kind = 'calls'").select("src", "dst"), ["src", "dst"], "left_anti")
    high = edges.agg(F.max("edge_seq")).first()[0] or 0
    made = fresh.withColumns({"kind": F.lit("calls"), "confidence": F.lit("uncertain"), "attrs": F.lit('{"deferred":true}'), "edge_seq": F.lit(high + 1) + F.monotonically_increasing_id()})
    return graph.having(edges=edges.unionByName(GraphBundle.conform(cut(made), "edges")))


def normalised(graph: GraphBundle) -> GraphBundle:
    """Deferred calls, then proxies, then type uses: what every freshly built graph goes through."""
    return type_uses(materialise_proxies(deferred_calls(graph)))


def overload_ids(units: DataFrame) -> DataFrame:
    """(row, id) columns added to ``units`` (base, start_line, start_col): the last definition keeps the plain id, earlier ones get '@line_col'."""
    last = Window.partitionBy("base").orderBy(F.desc("start_line"), F.desc("start_col"))
    # Dealt by rows: a task sorts as many on any table.
    return units.repartition(tasks(units), "base").withColumn("id", F.when(F.row_number().over(last) == 1, F.col("base")).otherwise(F.concat("base", F.lit("@"), "start_line", F.lit("_"), "start_col")))

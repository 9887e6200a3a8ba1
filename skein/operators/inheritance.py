"""The nearest declaration of a name over inheritance.

A method passes from a type to those that derive from it until, on that branch, a type
declares the name with the same signature. So the tables hold, for each type, what
comes to it, and never the pairs of a type and its ancestors. Only names that somebody
asks for move, and only through types from which an asker derives.

Types are gone over by levels: when a type's turn comes, all that it derives from is
known, and what its bases pass on comes to it once, as a list for each name. Only types
that derive from a circle have no turn: for them each round joins what was new in the
last one, and ends where nothing is new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut, numbered
from . import traverse


def _within(asked: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((type), (src, dst)): the types from which some asker derives, without who derives from whom, and the bases between them."""
    steps = cut(bases.select("src", "dst").where("src <> dst").distinct())
    start = asked.select(F.lit(0).alias("root"), F.col("type").alias("node")).distinct()
    within = cut(traverse.closure(steps, start, with_roots=True).select(F.col("node").alias("type")).distinct())
    return within, cut(steps.join(within.withColumnRenamed("type", "dst"), "dst", "left_semi").join(within.withColumnRenamed("type", "src"), "src", "left_semi"))


def inherited(asked: DataFrame, bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, name, signature, id): the methods that each of ``asked`` (type, name) inherits, its own left out.

    ``bases`` has (src, dst): src derives from dst. ``methods`` has (type, name, signature, id, inheritable); only the
    inheritable ones pass on, or stop others, but any of the asking type's own stops its signature. What several
    branches bring is kept, each once.
    """
    within, down = _within(asked, bases)
    known = methods.join(asked.select("name").distinct(), "name", "left_semi").join(within, "type", "left_semi")
    known = cut(known.select("type", "name", "signature", "id", "inheritable"))
    # What moves is the number of a declaration; ``kind`` numbers its name and signature, and so what stops it.
    passing = cut(known.where("inheritable").select("type", "name", "signature", "id").distinct().withColumn("method", F.monotonically_increasing_id()))
    kinds = cut(passing.select("name", "signature").distinct().withColumn("kind", F.monotonically_increasing_id()))
    numbers = cut(passing.alias("p").join(kinds.alias("k"), F.expr("p.name = k.name and p.signature <=> k.signature")).select("p.*", "k.kind"))
    # A signature that is not known stops nothing.
    stops = numbers.where("signature is not null").select(F.col("type").alias("src"), "kind").distinct()
    own = known.join(kinds, ["name", "signature"]).select(F.col("type").alias("src"), "kind").distinct()
    wanted = asked.select(F.col("type").alias("src"), "name").distinct()

    def arrived(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("type").alias("dst"), "kind", "method").join(down, "dst").select("src", "kind", "method").distinct()

    fresh = numbers.select("type", "kind", "method")
    seen, found = [fresh], []
    while True:
        ahead = cut(arrived(fresh))
        found = [*found, ahead] if len(found) < traverse.PARTS else [cut(traverse._union(found)), ahead]
        passes = ahead.join(stops, ["src", "kind"], "left_anti").withColumnRenamed("src", "type")
        fresh = cut(passes.join(traverse._union(seen), ["type", "method"], "left_anti").select("type", "kind", "method"))
        if fresh.isEmpty():
            break
        # Each round's table is kept apart, so that what is known is not written again round by round.
        seen = [*seen, fresh] if len(seen) < traverse.PARTS else [cut(traverse._union(seen)), fresh]
    named = traverse._union(found).join(kinds.select("kind", "name"), "kind").join(wanted, ["src", "name"], "left_semi").join(own, ["src", "kind"], "left_anti")
    out = named.select("src", "method").distinct().join(passing.drop("type"), "method")
    return out.select(F.col("src").alias("type"), "name", "signature", "id").distinct()


def spread(marks: DataFrame, bases: DataFrame) -> DataFrame:
    """(type, mark) for all types that derive from a marked one (type, mark), the marked ones included."""
    roots = marks.select(F.col("mark").alias("root"), F.col("type").alias("node"))
    return traverse.closure(traverse.reversed_edges(bases), roots, with_roots=True).select(F.col("node").alias("type"), F.col("root").alias("mark"))


def nearest(asked: DataFrame, bases: DataFrame, methods: DataFrame, states: DataFrame, known: DataFrame) -> DataFrame:
    """(type, name, status, node_id, n, own) for each of ``asked`` (type, name) that something answers to.

    ``status``: ``state`` if the type or one that it derives from declares a state variable of the name (``states``:
    type, name), ``resolved`` if one method is left, ``uncertain`` if several are. ``own`` says that the method is the
    type's own, and that all types that it derives from are ``known`` (type).
    """
    asked = cut(asked.select("type", "name").distinct())
    strange = bases.select(F.col("dst").alias("type")).distinct().join(known, "type", "left_anti")
    within, down = _within(asked, bases)
    levels = cut(traverse.levels(down, within.withColumnRenamed("type", "node")).withColumnRenamed("node", "type"))
    late = cut(within.join(levels, "type", "left_anti"))
    if late.isEmpty():
        found = _by_levels(asked, down, levels, methods, states, strange)
    else:
        found = _by_levels(asked.join(late, "type", "left_anti"), down, levels, methods, states, strange)
        found = found.unionByName(_by_rounds(cut(asked.join(late, "type", "left_semi")), bases, methods, states, strange))
    status = F.when(F.col("blocked"), "state").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "uncertain")
    node = F.when(status == "resolved", F.col("only"))
    return found.select("type", "name", status.alias("status"), node.alias("node_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), (node.isNotNull() & F.col("local") & F.col("open").isNull()).alias("own")).where("status is not null")


def _by_rounds(asked: DataFrame, bases: DataFrame, methods: DataFrame, states: DataFrame, strange: DataFrame) -> DataFrame:
    """(type, name, n, only, local, blocked, open) for each of ``asked``, on any hierarchy."""
    local = methods.select("type", "name", "id").join(asked, ["type", "name"], "left_semi")
    some = cut(local.withColumn("local", F.lit(True)).unionByName(inherited(asked, bases, methods).select("type", "name", "id", F.lit(False).alias("local"))))
    counted = some.groupBy("type", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"), F.bool_and("local").alias("local"))
    named = states.join(asked.select("name").distinct(), "name", "left_semi")
    blocked = spread(named.select("type", F.col("name").alias("mark")), bases).select("type", F.col("mark").alias("name"), F.lit(True).alias("blocked")).distinct()
    open_ = spread(strange.withColumn("mark", F.lit("")), bases).select("type", F.lit(True).alias("open")).distinct()
    return asked.join(counted, ["type", "name"], "left").join(blocked, ["type", "name"], "left").join(open_, "type", "left")


def _by_levels(asked: DataFrame, down: DataFrame, levels: DataFrame, methods: DataFrame, states: DataFrame, strange: DataFrame) -> DataFrame:
    """What :func:`_by_rounds` returns, for types that have a level (type, level).

    A row holds what comes to a type under one name: numbers made of that of an id, in the order of ids, and that of the
    name and signature, which say what stops it. -1 is a state variable's mark, which nothing stops. The mark of types
    that derive from a ``strange`` one (type) comes under no name.
    """
    names = cut(asked.select("name").distinct())
    some = cut(methods.join(names, "name", "left_semi").join(levels, "type", "left_semi").select("type", "name", "signature", "id", "inheritable"))
    ids = numbered(some.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id"), "i")
    kinds = numbered(some.select("name", "signature").distinct(), "kind")
    width = max(1, kinds.count().bit_length())
    made = some.alias("s").join(kinds.alias("k"), F.expr("s.name = k.name and s.signature <=> k.signature")).select("s.*", "k.kind").join(ids, "id")
    item = F.shiftleft("i", width) + F.col("kind")
    none, yes = F.lit(None).cast("long"), F.lit(True)
    known, own = F.col("signature").isNotNull(), F.coalesce("inheritable", F.lit(False))
    # A signature that is not known stops nothing; what is not inheritable stops only what would come to the type itself.
    rows = made.select("type", "name", F.when(own, item).alias("given"), F.when(own & known, F.col("kind")).alias("stop"), F.when(known, F.col("kind")).alias("hide"), F.col("i").alias("local"), F.lit(None).cast("boolean").alias("asked"))
    marks = states.join(names, "name", "left_semi").select("type", "name").unionByName(strange.select("type", F.lit(None).cast("string").alias("name")))
    rows = rows.unionByName(marks.select("type", "name", F.lit(-1).cast("long").alias("given"), none.alias("stop"), none.alias("hide"), none.alias("local"), F.lit(None).cast("boolean").alias("asked")))
    rows = rows.unionByName(asked.select("type", "name", none.alias("given"), none.alias("stop"), none.alias("hide"), none.alias("local"), yes.alias("asked")))
    rows = rows.groupBy("type", "name").agg(*[F.collect_set(c).alias(c) for c in ("given", "stop", "hide", "local")], F.max("asked").alias("asked"))
    own_rows = cut(rows.join(levels, "type").repartitionByRange("level", "type"))
    level = lambda end: levels.select(F.col("type").alias(end), F.col("level").alias(f"{end}_level"))
    pulls = cut(down.join(level("src"), "src").join(level("dst"), "dst").repartitionByRange("src_level", "src"))
    bases_of, last = {}, levels.agg(F.max("level")).first()[0]
    for to, of in pulls.select("src_level", "dst_level").distinct().collect():
        bases_of.setdefault(to, []).append(of)
    # Types from which none derives pass nothing on.
    leads = cut(down.select(F.col("dst").alias("type"), yes.alias("leads")).distinct())
    mask = F.lit((1 << width) - 1)
    stopped = lambda by: lambda x: (x < 0) | ~F.array_contains(by, x.bitwiseAND(mask))
    passed, out = {}, []
    for k in range((-1 if last is None else last) + 1):
        here = own_rows.where(F.col("level") == k).drop("level").withColumn("came", F.lit(None).cast("array<long>"))
        if k in bases_of:
            above = traverse._union([passed[j].select(F.col("type").alias("dst"), "name", F.col("given").alias("came")) for j in sorted(bases_of[k])])
            came = above.join(pulls.where(F.col("src_level") == k).select("src", "dst"), "dst").select(F.col("src").alias("type"), "name", "came")
            here = here.unionByName(came, allowMissingColumns=True)
        merged = here.groupBy("type", "name").agg(F.array_distinct(F.flatten(F.collect_list("came"))).alias("came"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("given", "stop", "hide", "local")], F.max("asked").alias("asked"))
        merged = merged.join(leads, "type", "left")
        let = F.when(F.size("stop") == 0, F.col("came")).otherwise(F.filter("came", stopped(F.col("stop"))))
        given = F.when(F.col("leads"), F.when(F.size("given") == 0, let).otherwise(F.array_union("given", let)))
        marked = F.array_contains("came", F.lit(-1).cast("long")) | F.array_contains("given", F.lit(-1).cast("long"))
        wanted = F.col("asked") | F.col("name").isNull()
        seen = F.when(F.col("asked"), F.filter("came", lambda x: (x >= 0) & ~F.array_contains(F.col("hide"), x.bitwiseAND(mask))))
        merged = merged.select("type", "name", given.alias("given"), wanted.alias("wanted"), marked.alias("marked"), seen.alias("seen"), "local")
        found = F.array_distinct(F.concat(F.transform("seen", lambda x: F.shiftright(x, width)), "local"))
        merged = merged.select("type", "name", "given", "wanted", "marked", F.size("seen").alias("others"), found.alias("found"))
        done = cut(merged.select("type", "name", "given", "wanted", "marked", F.when(F.size("found") > 0, F.size("found")).alias("n"), F.array_min("found").alias("i"), (F.col("others") == 0).alias("local")))
        passed[k] = done.where("given is not null and size(given) > 0")
        out.append(done.where("wanted").select("type", "name", "marked", "n", "i", "local"))
        if len(out) > traverse.PARTS:
            out = [cut(traverse._union(out))]
    if not out:
        return asked.select("type", "name", F.lit(0).alias("n"), F.lit("").alias("only"), yes.alias("local"), yes.alias("blocked"), yes.alias("open")).where("false")
    every = traverse._union(out)
    open_ = every.where("name is null and marked").select("type", yes.alias("open"))
    return every.where("name is not null").join(ids.withColumnRenamed("id", "only"), "i", "left").join(open_, "type", "left").select("type", "name", "n", "only", "local", F.col("marked").alias("blocked"), "open")


def inherited_calls(graph: GraphBundle, language: str = "solidity") -> GraphBundle:
    """Bare calls within types bind to the nearest declaration of the name over the types' bases.

    A call that means a state variable, or one of several methods, is left uncertain under a name of its own.
    """
    nodes, edges = GraphBundle.conform(graph.nodes, "nodes"), GraphBundle.conform(graph.edges, "edges")
    fact = lambda name: F.get_json_object("attrs", f"$.{name}")
    own = nodes.where(F.col("language") == language)
    bases = cut(edges.where("kind = 'inherits'").join(own.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    if bases.isEmpty():
        return graph
    held = edges.where("kind = 'contains'").select(F.col("src").alias("type"), F.col("dst").alias("id"))
    signature = F.to_json(F.transform(F.coalesce("parameters", F.array()), lambda p: F.coalesce(p["type"], F.lit(""))))
    visibility = F.coalesce(fact("solidity_visibility"), fact("visibility"), F.lit(""))
    methods = cut(own.where("kind = 'method'").join(held, "id").select("type", "name", signature.alias("signature"), "id", (~visibility.isin("private", "external")).alias("inheritable")))
    states = own.where("kind = 'state_variable'").join(held, "id").select("type", "name")
    calls = edges.where("kind = 'calls' and coalesce(get_json_object(attrs, '$.binding_blocked'), 'false') <> 'true'")
    calls = calls.join(held.withColumnRenamed("id", "src"), "src").join(bases.select(F.col("src").alias("type")).distinct(), "type", "left_semi").select("edge_seq", "src", "dst", "type")
    targets = methods.select(F.col("id").alias("dst"), F.col("type").alias("target_type"), F.col("name").alias("target_name"))
    known = calls.join(targets, "dst", "left")
    # A call bound to a method earlier is bound anew if that method's type is the caller's or one that it derives from.
    owners = known.where("target_type is not null").select(F.col("type").alias("root"), F.col("type").alias("node")).distinct()
    above = traverse.closure(bases, owners, with_roots=True).select(F.col("root").alias("type"), F.col("node").alias("target_type"), F.lit(True).alias("above"))
    scoped, module = F.concat("type", F.lit(".")), F.concat(F.substring_index("src", ":", 1), F.lit(":"))
    rest = lambda prefix: F.expr("dst").substr(F.length(prefix) + 1, F.length("dst"))
    name = F.when(F.col("above"), F.col("target_name")).when(F.col("dst").startswith(scoped), F.regexp_replace(rest(scoped), "@overload$", "")).when(F.col("dst").startswith(module), rest(module))
    named = known.join(above, ["type", "target_type"], "left").withColumn("name", name).where(r"name is not null and not name rlike '[:.@]|->'")
    found = nearest(named.select("type", "name"), bases, methods, states, nodes.select(F.col("id").alias("type")))
    bound = cut(named.select("edge_seq", "type", "name").join(found, ["type", "name"]).select("edge_seq", "type", "name", "status", "node_id", "own"))
    out = edges.join(bound, "edge_seq", "left")
    dst = F.when(F.col("status") == "state", F.concat("src", F.lit(".$binding."), "name")).when(F.col("status") == "uncertain", F.concat("type", F.lit("."), "name", F.lit("@overload"))).otherwise(F.coalesce("node_id", "dst"))
    grade = F.when(F.col("status").isin("state", "uncertain"), "uncertain").when(F.col("own"), "certain").when(F.col("status") == "resolved", "inferred").otherwise(F.col("confidence"))
    blocked = F.to_json(F.map_concat(F.coalesce(F.from_json("attrs", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), F.create_map(F.lit("binding_blocked"), F.lit("true"), F.lit("binding_reason"), F.lit("inherited_state_value"))))
    out = out.withColumn("attrs", F.when(F.col("status") == "state", blocked).otherwise(F.col("attrs"))).withColumn("confidence", grade).withColumn("__dst", dst)
    return graph.having(edges=GraphBundle.conform(out.drop("dst").withColumnRenamed("__dst", "dst"), "edges"))

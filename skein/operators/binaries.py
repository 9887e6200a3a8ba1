"""Set operations over native images: ranges, gaps, calls by owner, stubs, mapped spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import across, beside, ranged
from . import intervals, overlay


def function_ends(functions: DataFrame) -> DataFrame:
    """``functions`` (artifact, section, start, end or null) with missing ends at the next start of the section."""
    nxt = F.lead("start").over(Window.partitionBy("artifact", "section").orderBy("start"))
    return functions.withColumn("end", F.coalesce("end", nxt, F.col("start") + 1))


def clipped(functions: DataFrame, spans: DataFrame) -> DataFrame:
    """The parts of functions within selected spans (artifact, s_start, s_end), all half-open."""
    both = functions.join(spans, "artifact").where((F.col("start") < F.col("s_end")) & (F.col("end") > F.col("s_start")))
    return both.withColumns({"start": F.greatest("start", "s_start"), "end": F.least("end", "s_end")}).drop("s_start", "s_end")


def gaps(functions: DataFrame, spans: DataFrame) -> DataFrame:
    """(artifact, start, end): what selected spans hold outside all functions; these become region nodes."""
    own = functions.select("artifact", "start", "end", F.lit(0).alias("source"))
    free = spans.select("artifact", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.lit(1).alias("source"))
    return overlay.overlay(own.unionByName(free), ["artifact"], 2).where("source = 1").drop("source")


def pc_relative(instructions: DataFrame, parts: int | None = None) -> DataFrame:
    """``instructions`` with how and target of the second words of call pairs that add to the program counter (RISC-V, LoongArch64).

    ``instructions``: artifact, architecture, byte_order, address, size, bytes (hexadecimal), how, target. The word before
    one is that of the row before it in ranges of (artifact, address); a range begins with the last row of the one before.
    """
    little = F.coalesce(F.col("byte_order") == "little", F.lit(False))
    swapped = F.concat(*[F.substring("bytes", k, 2) for k in (7, 5, 3, 1)])
    words = instructions.withColumn("word", F.conv(F.when(little, swapped).otherwise(F.col("bytes")), 16, 10).cast("long"))
    placed = ranged(words, ["artifact", "address"], parts)
    own = Window.partitionBy("artifact", "block").orderBy("address")
    state = F.struct("address", "size", "word")
    tops = across(placed.groupBy("artifact", "block").agg(F.max_by(state, "address").alias("top")), ["artifact"])
    carried = tops.select("artifact", "block", F.lag("top").over(Window.partitionBy("artifact").orderBy("block")).alias("carried"))
    paired = beside(placed, ["artifact"], carried).withColumn("before", F.coalesce(F.lag(state).over(own), F.col("carried")))
    first, second, at = F.col("before.word"), F.col("word"), F.col("before.address").cast("long")
    bits = lambda word, low, n: F.shiftright(word, low).bitwiseAND(F.lit((1 << n) - 1))
    signed = lambda value, n: value - F.when(bits(value, n - 1, 1) == 1, F.lit(1 << n)).otherwise(F.lit(0))
    same = lambda word, mask, want: word.bitwiseAND(F.lit(mask)) == F.lit(want)
    adjacent = (F.col("before.size") == 4) & (F.col("size") == 4) & (at + 4 == F.col("address")) & (F.col("how") == "indirect")
    loong = (F.col("architecture") == "loongarch64") & same(first, 0xFE000000, 0x1E000000) & same(second, 0xFC000000, 0x4C000000) & (bits(first, 0, 5) != 0) & (bits(first, 0, 5) == bits(second, 5, 5)) & (bits(second, 0, 5) == 1)
    risc = F.col("architecture").startswith("riscv") & same(first, 0x7F, 0x17) & same(second, 0x707F, 0x67) & (bits(first, 7, 5) != 0) & (bits(first, 7, 5) == bits(second, 15, 5))
    far = at + F.shiftleft(signed(bits(first, 5, 20), 20), 18) + F.shiftleft(signed(bits(second, 10, 16), 16), 2)
    near = (at + signed(first.bitwiseAND(F.lit(0xFFFFF000)), 32) + signed(bits(second, 20, 12), 12)).bitwiseAND(F.lit(-2))
    found = F.when(adjacent & loong, far).when(adjacent & risc, near)
    out = paired.withColumn("found", found)
    kind = dict(instructions.dtypes)["target"]
    return out.withColumn("how", F.when(F.col("found").isNotNull(), "pc_relative").otherwise(F.col("how"))).withColumn("target", F.coalesce(F.col("found").cast(kind), "target")).select(*instructions.columns)


def calls_by_owner(instructions: DataFrame, functions: DataFrame, width: int = 4096) -> DataFrame:
    """(artifact, address, src, dst, confidence): the functions that hold a call's address and its target.

    ``instructions``: artifact, address, target, how (direct, pc_relative or tail). A target with exactly one owner is
    resolved (certain if direct, else inferred), any other is uncertain and has no dst.
    """
    spans = functions.select("artifact", "node_id", "start", "end")
    caller = intervals.stab(instructions, spans, "address", ["artifact"], width).select("artifact", "address", "target", "how", F.col("node_id").alias("src"))
    owner = intervals.stab(instructions.where("target is not null").select("artifact", "address", F.col("target").alias("at")), spans, "at", ["artifact"], width)
    owner = owner.groupBy("artifact", "address").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("only"))
    out = caller.join(owner, ["artifact", "address"], "left").withColumn("dst", F.when(F.col("n") == 1, F.col("only")))
    confidence = F.when(F.col("dst").isNull(), "uncertain").when(F.col("how") == "direct", "certain").otherwise("inferred")
    return out.select("artifact", "address", "src", "dst", confidence.alias("confidence"))


def tail_calls(jumps: DataFrame, functions: DataFrame) -> DataFrame:
    """Jumps (artifact, address, target) to the very start of another function than their own; '.cold' parts are no targets."""
    starts = functions.where(~F.col("name").contains(".cold")).select("artifact", F.col("start").alias("target"), F.col("node_id").alias("dst"))
    own = intervals.stab(jumps, functions.select("artifact", F.col("node_id").alias("src"), "start", "end"), "address", ["artifact"])
    return own.join(starts, ["artifact", "target"]).where("src <> dst").select("artifact", "address", "src", "dst")


def stub_links(stubs: DataFrame, exports: DataFrame) -> DataFrame:
    """(stub, node_id, confidence): import stubs (stub, symbol) bound to the one definition of their symbol, if there is one."""
    known = exports.groupBy("symbol").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("only"))
    out = stubs.join(known, "symbol", "left").withColumn("node_id", F.when(F.col("n") == 1, F.col("only")))
    return out.select("stub", "node_id", F.when(F.col("node_id").isNull(), "uncertain").otherwise("inferred").alias("confidence"))


def aliased(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, to): symbols (id, symbol) whose aliases (as is, without leading '_', the last segment of a demangled name) name one source (name, to)."""
    plain = F.regexp_replace(F.regexp_replace("symbol", r"\(.*\)$", ""), "^_", "")
    names = symbols.select("id", F.explode(F.array_distinct(F.array(F.col("symbol"), plain, F.element_at(F.split(plain, "::"), -1)))).alias("name"))
    hits = names.join(sources, "name").groupBy("id").agg(F.count_distinct("to").alias("n"), F.min("to").alias("to"))
    return hits.where("n = 1").select("id", "to")


def mapped_spans(mappings: DataFrame) -> DataFrame:
    """Mappings of equal context that touch or overlap, as one; gaps are not bridged."""
    by = ["artifact", "node_id", "source_path", "line", "col", "function", "inline_depth"]
    return intervals.coalesced(mappings, by).drop("n")


def violations(artifacts: DataFrame, ranges: DataFrame, mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(what, key): everything that forbids adding a binary graph: unknown artifacts or nodes, empty or unheld spans."""
    known = artifacts.select(F.col("id").alias("artifact"))
    ids = nodes.select(F.col("id").alias("node_id"))
    key = F.concat_ws(":", "artifact", "node_id", F.col("start").cast("string"))
    out = ranges.join(known, "artifact", "left_anti").select(F.lit("range of an unknown artifact").alias("what"), key.alias("key"))
    out = out.unionByName(ranges.join(ids, "node_id", "left_anti").select(F.lit("range of an unknown node").alias("what"), key.alias("key")))
    out = out.unionByName(ranges.where(F.col("end") <= F.col("start")).select(F.lit("empty range").alias("what"), key.alias("key")))
    held = mappings.join(ranges.select("artifact", "node_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["artifact", "node_id"], "left")
    inside = held.groupBy("artifact", "node_id", "start", "end").agg(F.max((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))).alias("ok"))
    return out.unionByName(inside.where("not coalesce(ok, false)").select(F.lit("mapping outside its node's ranges").alias("what"), key.alias("key")))

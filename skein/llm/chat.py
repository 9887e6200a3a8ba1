"""Preference formatting of conversations.

A chosen and a rejected conversation share their first turns. The longest common
turn prefix is found by joining both on the turn number, rendered once as the
prompt; what follows in either is rendered as its completion, with a mask that
trains on assistant turns only.

:func:`paired` makes pairs from one table: each conversation is chosen against the
one with the smallest id among the others that open with the same turn. Openings
are counted on the map side, so a very common one costs one row a task, no
more than one pair a conversation arises, and the conversations that have a very
common partner are joined with it in parts.

Only DataFrame functions run here. Defined cases: a null role or text counts as
empty, a null turn comes first; a turn given twice is kept twice, ordered by role and
text; turns are numbered anew in that order; a conversation without partner has
rejected_id null, an empty rejected completion, and its prompt ends before its last
turn; equal conversations have empty completions; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The rendering of a turn: head, role, after the role, text, tail.
HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
#: Bins that the ids of an opening are dealt to.
BINS = 1024
#: Turns that a mask is made of at a time.
BLOCK = 256


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def paired(whole: DataFrame) -> DataFrame:
    """(chosen_id, chosen, rejected_id, rejected) by common opening turns."""
    # Read from files, both sides of the last join are shuffled for it, so that a hot rejected_id can be split.
    whole = common.stored(whole, "conversations")
    role, text = (F.element_at("turns", 1)[c] for c in ("role", "text"))
    # The role's length before it: no two openings give the same bytes.
    opened = whole.withColumn("opening", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    known = common.stored(_two_smallest(opened.select("opening", "conv_id")), "openings")
    hot = known.where(F.col("n") > common.HOT_ROWS).orderBy(F.desc("n"), "opening").limit(common.HOT_KEYS)
    chosen = common.salted_join(opened, known.drop("n"), "opening", ["conv_id"], "left", found=hot.select("opening", "n").collect()).select(
        F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.when(F.col("conv_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("rejected_id")
    )
    heads = known.select(F.explode(F.array("first", "second")).alias("conv_id")).where("conv_id is not null").distinct()
    rejected = whole.join(heads, "conv_id").select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    # All but one conversation of an opening have its first one as their partner.
    return common.salted_join(chosen, rejected, "rejected_id", ["chosen_id"], "left", found=hot.select(F.col("first").alias("rejected_id"), "n").collect())


def _two_smallest(rows: DataFrame) -> DataFrame:
    """(opening, first, second, n): the two smallest ids of each opening that several conversations have, and how many do.

    Ids are dealt to bins, so that a hot opening is spread. The second smallest id is the
    smallest of another bin, or the next one in the first id's bin.
    """
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("conv_id"), F.lit(BINS)))
    mins = common.stored(binned.groupBy("opening", "bin").agg(F.min("conv_id").alias("m"), F.count("*").alias("n")), "bins")
    named = F.when(F.col("m").isNotNull(), F.struct("m", "bin"))
    first = common.stored(mins.groupBy("opening").agg(F.min(named).alias("f"), F.sum("n").alias("n")).where("n > 1").select("opening", F.col("f.m").alias("first"), F.col("f.bin").alias("bin"), "n"), "firsts")
    elsewhere = mins.drop("n").join(first.withColumnRenamed("bin", "own"), "opening").where("bin <> own").select("opening", F.col("m").alias("second"))
    beside = binned.join(first, ["opening", "bin"]).where("conv_id <> first").select("opening", F.col("conv_id").alias("second"))
    second = elsewhere.unionByName(beside).groupBy("opening").agg(F.min("second").alias("second"))
    return first.select("opening", "first", "n").join(second, "opening", "left")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """'start:end' of trained characters within the rendering, comma-joined: assistant texts with their tails.

    Turns are gone through in blocks, so that a conversation of n turns costs about n * BLOCK steps, not n * n.
    """
    length = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(HEAD) + len(MIDDLE) + len(TAIL)
    part = lambda b: F.slice(turns, b * BLOCK + 1, F.lit(BLOCK))
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / BLOCK).cast("int")), lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda n, t: n + length(t)))

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + len(HEAD) + F.length(t["role"]) + len(MIDDLE)
        end = begin + F.length(t["text"]) + len(TAIL)
        spans = F.when(t["role"] == TRAINED, F.concat(state["spans"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    def spans(b: Column) -> Column:
        before = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda n, x: n + x)
        return F.aggregate(part(b), F.struct(before.alias("at"), F.array().cast("array<string>").alias("spans")), add, lambda s: s["spans"])

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(turns) / BLOCK).cast("int")), spans)), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, prefix_turns, prompt, both completions and their masks for each pair."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = lambda i: (F.element_at("chosen", i)["role"] == F.element_at("rejected", i)["role"]) & (F.element_at("chosen", i)["text"] == F.element_at("rejected", i)["text"])
    # The first position where they differ, or one past the shorter.
    common_turns = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), shorter), lambda i: ~same(i))) - 1, shorter)
    prefix = F.when(F.col("rejected").isNull(), F.greatest(F.size("chosen") - 1, F.lit(0))).otherwise(common_turns).cast("int")
    cut = pairs.withColumn("prefix_turns", prefix).withColumn("rejected", F.coalesce("rejected", F.expr("slice(chosen, 1, 0)")))
    rest = lambda c: F.expr(f"slice({c}, prefix_turns + 1, greatest(size({c}) - prefix_turns, 0))")
    parts = cut.select("chosen_id", "rejected_id", F.col("prefix_turns").cast("long").alias("prefix_turns"), F.expr("slice(chosen, 1, prefix_turns)").alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select("chosen_id", "rejected_id", "prefix_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"))

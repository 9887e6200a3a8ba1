"""Interval joins as equi-joins on buckets, and coalescing of spans.

Spark has no range join; a bare one compares all with all. Each interval is dealt to
the buckets that it covers, points and the starts of shared stretches decide in
which bucket a pair is reported, and the exact comparison is a residual condition.
Buckets come in levels, each ``FAN`` times as wide as the one before; a span lies at the level at which it
covers about ``FAN`` of them, so that a span of any length is a few rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import across, beside, cut, ranged

FAN, TOP = 16, 1 << 60


def _widths(width: int) -> list[int]:
    """The widths of the levels' buckets, up to ``TOP``."""
    out = [width]
    while out[-1] * FAN <= TOP:
        out.append(out[-1] * FAN)
    return out


def _level(width: int, start: str, end: str) -> Column:
    length, out = F.col(end) - F.col(start), F.lit(0)
    for k, wide in enumerate(_widths(width)[1:], 1):
        out = F.when(length > F.lit(wide), k).otherwise(out)
    return out


def _wide(width: int) -> Column:
    """The width of a bucket of the level in ``level``."""
    return F.element_at(F.array(*[F.lit(wide).cast("long") for wide in _widths(width)]), F.col("level") + 1)


def _levels(*spans: tuple[DataFrame, str, str], width: int) -> Column:
    """The levels that any of the spans lies at, as an array: some fifteen numbers reach the driver at most."""
    found = {r[0] for df, start, end in spans for r in df.select(_level(width, start, end)).distinct().collect()}
    return F.array(*[F.lit(k) for k in sorted(found)]) if found else F.array().cast("array<int>")


def bucketed(spans: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open spans with their ``level``, a row for each ``bucket`` of that level that they cover; empty spans vanish."""
    placed = spans.where(F.col(end) > F.col(start))
    placed = placed if "level" in placed.columns else placed.withColumn("level", _level(width, start, end))
    first, last = F.floor(F.col(start) / _wide(width)).cast("long"), F.floor((F.col(end) - 1) / _wide(width)).cast("long")
    return placed.withColumn("bucket", F.explode(F.sequence(first, last)))


def stab(points: DataFrame, spans: DataFrame, at: str = "at", on: list[str] | None = None, width: int = 4096, start: str = "start", end: str = "end") -> DataFrame:
    """Points within half-open spans, with equal ``on`` columns. Each pair comes once: a point lies in one bucket of each level."""
    keyed = points.withColumn("level", F.explode(_levels((spans, start, end), width=width)))
    keyed = keyed.withColumn("bucket", F.floor(F.col(at) / _wide(width)).cast("long"))
    return keyed.join(bucketed(spans, width, start, end), ["level", "bucket", *(on or [])]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("level", "bucket")


def overlaps(left: DataFrame, right: DataFrame, on: list[str], width: int = 64) -> DataFrame:
    """Pairs of closed spans (l_start..l_end, r_start..r_end) that share a unit, with equal ``on`` columns; each pair once.

    A pair meets at the higher of its two levels, in the bucket where what it shares begins.
    """
    left, right = left.withColumn("__l", F.col("l_end") + 1), right.withColumn("__r", F.col("r_end") + 1)
    levels = _levels((left, "l_start", "__l"), (right, "r_start", "__r"), width=width)

    def at_levels(spans: DataFrame, own: str, start: str, end: str) -> DataFrame:
        """A row a bucket of each level from the span's own upwards."""
        higher = F.filter(levels, lambda k: k >= F.col(own))
        return bucketed(spans.withColumn(own, _level(width, start, end)).withColumn("level", F.explode(higher)), width, start, end)

    a, b = at_levels(left, "__a", "l_start", "__l"), at_levels(right, "__b", "r_start", "__r")
    shared = F.floor(F.greatest("l_start", "r_start") / _wide(width)).cast("long")
    both = a.join(b, ["level", "bucket", *on]).where((F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start")) & (F.col("level") == F.greatest("__a", "__b")) & (F.col("bucket") == shared))
    return both.drop("level", "bucket", "__l", "__r", "__a", "__b")


def tightest(hits: DataFrame, by: list[str], span: Column, tie: list[Column], keep: str) -> DataFrame:
    """Of the hits of each ``by`` the one with the smallest span."""
    return hits.groupBy(*by).agg(F.min_by(keep, F.struct(span.alias("span"), *tie)).alias(keep))


def coalesced(spans: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 0, parts: int | None = None) -> DataFrame:
    """Spans of equal ``by`` that touch or overlap (or lie at most ``gap`` apart) as one: by, start, end, n.

    The spans are dealt to ranges (``parts`` of them) of (key, start) of about equal size; they are ordered within a range only, and
    what reaches into a range comes from the ranges' summaries. So no key, however many spans it has and wherever they
    lie, is one task; only spans with one start are together (equal ones as one row with their number).
    """
    spans = spans.select(*by, F.col(start).alias("s"), F.col(end).alias("e"))
    blocked = ranged(spans, [*by, "s"], parts, lambda rows: rows.groupBy(*by, "s", "e").agg(F.count("*").alias("k")))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "block").orderBy("s", "e")

    def carried(rows: DataFrame, value: Column) -> DataFrame:
        """The largest ``value`` of the block as ``top`` and of all earlier blocks of the key as ``carry``: a row a block."""
        tops = across(rows.groupBy(*by, "block").agg(F.max(value).alias("top")), by)
        return cut(tops.withColumn("carry", F.max("top").over(before)))

    reach = F.greatest(F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    fresh = beside(blocked, by, carried(blocked, F.col("e"))).withColumn("fresh", F.when(reach.isNull() | (F.col("s") > reach + gap), F.col("s")))
    # An island is named by its first start: that of the latest span that began one, equal spans counted whatever their order.
    # What the block has of an island is one row; those that go on from an earlier block have no name yet.
    peers = Window.partitionBy(*by, "block").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("k").alias("k"))
    pieces = cut(sums(fresh.withColumn("island", F.max("fresh").over(peers)), *by, "block", "island"))
    # Only a block's first and last islands may be parts of longer ones.
    tops = F.broadcast(carried(pieces, F.col("island")).withColumnsRenamed({c: f"of {c}" for c in (*by, "block")}))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"`of {c}`")) for c in (*by, "block")])
    open_ = F.coalesce(F.col("of block").isNotNull() & (F.col("island").isNull() | (F.col("island") == F.col("top"))), F.lit(False))
    marked = pieces.join(tops, same, "left").withColumn("open", open_).withColumn("island", F.coalesce("island", "carry"))
    whole = marked.where("not open").select(*by, "s", "e", "k")
    merged = sums(marked.where("open"), *by, "island").select(*by, "s", "e", "k")
    return whole.unionByName(merged).select(*by, F.col("s").alias(start), F.col("e").alias(end), F.col("k").alias("n"))

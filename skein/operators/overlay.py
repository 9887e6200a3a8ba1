"""Sweeps over address axes: overlays by precedence, and the selection of spans to scan.

Spans become events at their ends: so many of a source begin or end here. They are dealt
to ranges of (key, address) of about equal size, where those of one address are added
up, and each range is swept by itself, beginning with what
earlier ranges of its key carry into it: sums, the last mark, and the address at which
the next one begins. An axis of any length is many tasks; only the table of ranges is
ordered as a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import across, beside, cut, ranged
from . import intervals


def swept(events: DataFrame, by: list[str], sources: int, parts: int | None = None, marks: tuple[str, ...] = ("mark",)) -> DataFrame:
    """``by``, start, end, active (array: how many spans of each source cover the piece) and ``marks``, a row a piece between neighbouring events.

    ``events`` has ``by``, at, source (0 and on, or null), delta (1 where a span begins, -1 where it ends) and marks: what
    holds from here on, or null. Of several marks at one address the greatest holds.
    """
    sums = [F.coalesce(F.sum(F.when(F.col("source") == k, F.col("delta"))), F.lit(0)).alias(f"d{k}") for k in range(sources)]
    placed = ranged(events, [*by, "at"], parts, lambda rows: rows.groupBy(*by, "at").agg(*sums, *[F.max(m).alias(m) for m in marks]))
    last = lambda m: F.max_by(m, F.when(F.col(m).isNotNull(), F.col("at"))).alias(m)
    totals = across(placed.groupBy(*by, "block").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(sources)], F.min("at").alias("first"), *[last(m) for m in marks]), by)
    blocks = Window.partitionBy(*by).orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "block", *[F.coalesce(F.sum(f"d{k}").over(before), F.lit(0)).alias(f"c{k}") for k in range(sources)], *[F.last(m, ignorenulls=True).over(before).alias(f"carried {m}") for m in marks], F.lead("first").over(blocks).alias("next"))
    own = Window.partitionBy(*by, "block").orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.array(*[F.coalesce(F.col(f"c{k}"), F.lit(0)) + F.sum(f"d{k}").over(upto) for k in range(sources)])
    held = [F.coalesce(F.last(m, ignorenulls=True).over(upto), F.col(f"carried {m}")).alias(m) for m in marks]
    out = beside(placed, by, carried).select(*by, F.col("at").alias("start"), F.coalesce(F.lead("at").over(own), F.col("next")).alias("end"), active.alias("active"), *held)
    return out.where("end is not null")


def ends(spans: DataFrame, by: list[str], source: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The events of half-open spans; empty ones have none."""
    both = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("delta"))))
    kept = spans.where(F.col(end) > F.col(start)).select(*by, source.cast("int").alias("source"), both.alias("e"))
    return kept.select(*by, "e.at", "source", "e.delta", F.lit(None).cast("string").alias("mark"))


def overlay(spans: DataFrame, by: list[str], sources: int, source: str = "source", start: str = "start", end: str = "end", parts: int | None = None) -> DataFrame:
    """``by``, start, end, source: disjoint pieces that cover what the spans cover, each of the first source (0 and on) that has a span there."""
    pieces = swept(ends(spans, by, F.col(source), start, end), by, sources, parts)
    best = F.array_position(F.transform("active", lambda n: n > 0), True) - 1
    return pieces.select(*by, "start", "end", best.cast("int").alias("source")).where("source >= 0")


def mapped(spans: DataFrame, by: list[str], sources: int, width: int = 4096, parts: int | None = None) -> DataFrame:
    """The pieces of :func:`overlay` with the columns of the spans of the winning source there: several, if its spans overlap."""
    pieces = overlay(spans, by, sources, parts=parts).withColumnsRenamed({"start": "p_start", "end": "p_end"})
    rest = [c for c in spans.columns if c not in (*by, "start", "end", "source")]
    hits = intervals.stab(pieces, spans, "p_start", [*by, "source"], width)
    return hits.select(*by, F.col("p_start").alias("start"), F.col("p_end").alias("end"), "source", *rest)


def on_one_axis(ranges: DataFrame, artifacts: DataFrame, segments: DataFrame) -> DataFrame:
    """(artifact, start, end, mode): ``ranges`` (artifact, kind, start, end, mode) as virtual addresses.

    ``kind`` is va, rva (from the artifact's image_base on) or file (through ``segments``: artifact, start, end and
    file_offset; a range of a file that lies in several of them comes in as many parts).
    """
    based = ranges.where("kind <> 'file'").join(artifacts.select(F.col("id").alias("artifact"), "image_base"), "artifact")
    shift = F.when(F.col("kind") == "rva", F.col("image_base")).otherwise(F.lit(0))
    out = based.select("artifact", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), "mode")
    held = segments.select("artifact", F.col("start").alias("va"), F.col("file_offset").alias("off"), (F.col("file_offset") + F.col("end") - F.col("start")).alias("off_end"))
    inside = ranges.where("kind = 'file'").join(held, "artifact").where((F.col("start") < F.col("off_end")) & (F.col("end") > F.col("off")))
    files = inside.select("artifact", (F.col("va") + F.greatest("start", "off") - F.col("off")).alias("start"), (F.col("va") + F.least("end", "off_end") - F.col("off")).alias("end"), "mode")
    return out.unionByName(files)


def scan_spans(selected: DataFrame, marks: DataFrame, mode: str = "", data: str = "data", parts: int | None = None) -> DataFrame:
    """(artifact, start, end, mode): ``selected`` (artifact, start, end, mode) cut at the marks within, without data.

    ``marks`` (artifact, at, mode) hold from their address to the next one or the span's end; a span's own mode goes
    before them, and what no mark of the span precedes has ``mode``. Selections that overlap are an error.
    """
    by, types = ["artifact"], dict(selected.dtypes) | {"at": dict(marks.dtypes)["at"]}
    kinds = {"mark": f"struct<at: {types['at']}, mode: string>", "span": f"struct<start: {types['start']}, own: string>"}
    note = F.struct("at", "mode").cast(kinds["mark"]).alias("mark")
    notes = marks.select("artifact", "at", F.lit(None).cast("int").alias("source"), F.lit(0).alias("delta"), note, F.lit(None).cast(kinds["span"]).alias("span"))
    # A span that begins is a mark as well: as no others overlap it, it is the one that what follows lies in.
    begins = F.when(F.col("delta") > 0, F.struct(F.col("at"), F.col("own")).cast(kinds["span"]))
    events = ends(selected.withColumn("own", F.col("mode")), [*by, "own"], F.lit(0)).select("artifact", "at", "source", "delta", F.lit(None).cast(kinds["mark"]).alias("mark"), begins.alias("span")).unionByName(notes)
    pieces = cut(swept(events, by, 1, parts, ("mark", "span")).where("active[0] > 0"))
    clash = pieces.where("active[0] > 1").orderBy("artifact", "start").first()
    if clash is not None:
        raise ValueError(f"selected spans of {clash['artifact']} overlap at {clash['start']}")
    inside = F.when(F.col("mark.at") >= F.col("span.start"), F.col("mark.mode"))
    out = pieces.select("artifact", "start", "end", F.coalesce("span.own", inside, F.lit(mode)).alias("mode"))
    return out.where(F.col("mode") != data)

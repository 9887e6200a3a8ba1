"""Mixing sources to target weights.

Words are summed by source (combined on the map side, so a hot source costs one row
a task). The targets share the total by weight; a target stops at ``limit`` times
its source's size and the excess is shared by weight among the others until none is
above. Since sources reach the limit in the order of size / weight, the level at
which the sharing ends comes from two running sums over the source table, without
a loop. Each document is emitted floor(rate) times, plus once more if a number in
[0, 1) seeded by its doc_id is below the rate's fraction; rate is target / size of
the source. The same doc_id always draws the same number.

Only DataFrame functions run here. The source table has a row a source and is
ordered whole (weights go by rank); it does not grow with the documents.

Defined cases: a null text has size 0; documents of a null source form a source of
their own, ranked last; a source without words has target 0 and none of its
documents is taken; a null doc_id draws as the text 'null'; repeated rows are
drawn alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
#: Digits of MD5 that make the drawn number: 52 bits, exact in a double.
DIGITS = 13


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long")


def drawn(doc_id: str = "doc_id", seed: str = "") -> Column:
    """A number in [0, 1) from the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DIGITS))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target from a table of (source, source_size)."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1)))
    weighed = weighed.withColumn("ratio", F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    full, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # The level at a source if it and all after it are below their limits.
    level = (F.sum("source_size").over(whole) - limit * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") <= limit * F.col("ratio"))
    levels = levels.withColumn("final", F.min(F.when(F.col("free"), F.struct("ratio", "source", "level"))).over(whole)["level"])
    capped = F.col("source_size") * F.lit(float(limit))
    return levels.select("source", "source_size", F.when(F.col("final").isNull(), capped).otherwise(F.least(capped, F.col("final") * F.col("weight"))).alias("target"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each row of ``docs``."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"))
    sized = common.stored(sized, "sizes")
    return _copies(sized, sized, weights, limit, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _copies(rows: DataFrame, sized: DataFrame, weights, limit: int, seed: str) -> DataFrame:
    """``rows`` with what their source and id decide."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = common.stored(targets(by_source, weights, limit), "targets").withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(goals, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__rate", rate)
    return joined.withColumn("copies", (F.floor("__rate") + (drawn(seed=seed) < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long")).drop("__rate")


def emitted(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "") -> DataFrame:
    """Each document as often as the mixture takes it, with the columns of ``docs``."""
    sized = docs.select(F.col("source").cast("string").alias("source"), words().alias("size"))
    whole = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    taken = _copies(whole, sized, weights, limit, seed).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")

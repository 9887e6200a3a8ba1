"""Cutting the lineage of tables that are built round by round."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A task gets more than ``FEW`` rows where tasks are fewer than a shuffle has, and not more than some ``ROWS``.
FEW, ROWS = 1 << 14, 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made only where none is set and Spark runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the shared folder and read back: computed once, and later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """The distinct rows of ``df`` stored in buckets of ``column``: joins by it deal only their other side, however often they run.

    There are as many buckets as a shuffle has tasks, or ``parts`` (:func:`wide`).
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, column).distinct().write.format("parquet").bucketBy(parts, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def wide(df: DataFrame) -> int:
    """How many tasks the rows of ``df``, which must be cheap to count, are dealt to: as many as a shuffle has, more where each would hold more than four times ``ROWS``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (4 * ROWS)))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` stored with numbers from 0 without gaps in ``column``, which rise in the order in which its rows lie."""
    placed = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # A row a task that wrote: few enough for one window.
    before = cut(sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before")))
    return placed.join(F.broadcast(before), part == F.col("__part")).select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(column))


def tasks(stored: DataFrame) -> int:
    """How many tasks the rows of a stored table are dealt to: as many as a shuffle has, fewer for few rows, and more where each would hold more than ``ROWS``."""
    rows, usual = stored.count(), int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(min(usual, -(-rows // FEW)), -(-rows // ROWS), 1)


def ranged(df: DataFrame, columns: list[str], parts: int | None = None, grouped: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` stored in ranges of ``columns`` of about equal size, with the range's number, which rises with them, in ``block``.

    Without ``parts`` their number grows with the rows (:func:`tasks`), so that a range stays as large on any table.
    ``grouped`` groups the rows by ``columns`` (and others) where they come to lie.
    """
    by = [F.col(f"`{c}`") for c in columns]
    if parts is None:
        df = cut(df)
        parts = tasks(df)
    placed = df.repartitionByRange(parts, *by)
    return cut((grouped(placed) if grouped else placed).withColumn("block", F.spark_partition_id()))


def beside(placed: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """The rows of ``placed`` (from :func:`ranged`, ``by`` first) dealt by (key, block), with the columns of ``totals`` (``by``, block, ...) of theirs, if any.

    ``totals`` are broadcast: they must be of keys that lie in several ranges (:func:`across`), which are two rows a range at most.
    """
    rest = [c for c in totals.columns if c not in (*by, "block")]
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"`of {c}`")) for c in (*by, "block")])
    dealt_ = placed.repartition(tasks(placed), *by, "block")
    return dealt_.join(F.broadcast(totals.withColumnsRenamed({c: f"of {c}" for c in (*by, "block")})), same, "left").select(*placed.columns, *rest)


def across(totals: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``totals`` (a row a key ``by`` and ``block``) of the keys that lie in several blocks."""
    return totals.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n > 1").drop("__n")

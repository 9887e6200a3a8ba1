"""Tables, shared storage and Arrow plumbing used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to one vectorised step are cut into slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Rows that a Python worker gets at once.
BATCH = 1000
#: Rows of one key that a join leaves together, and the most keys that are split (a key beyond them holds less than
#: 1 / HOT_KEYS of the rows).
HOT_ROWS, HOT_KEYS = 20_000, 1024
#: Bits of the map behind :func:`maybe_in`: 1 MB, whatever the input.
BITS = 1 << 23


def small_batches(spark: SparkSession) -> None:
    """Send Python workers ``BATCH`` rows at a time where the session has Spark's default: a row may hold a long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in this process (tests) a temporary
    folder is made, once a session; on a cluster the missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored`, once nothing reads it any more (a round's table, after the next)."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` reach ``SLICE_BYTES``; a longer value stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, sliced: str | None = None) -> DataFrame:
    """``mapInArrow`` with one step a batch (or a slice of it by the bytes of ``sliced``)."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sliced) if sliced else [batch]:
                if part.num_rows and (out := step(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many signs put before it as it takes to differ from every column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, **made: Column) -> DataFrame:
    """``row`` (all columns of ``df`` in one struct) beside the columns made from them: no name of ``df`` can clash with these."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in made.items()])


def hot_keys(df: DataFrame, on: list[str], rows: int | None = None) -> list:
    """(key columns, n) of the keys of ``df`` with more than ``rows`` rows, the largest ones, at most ``HOT_KEYS``."""
    known = df.where(" and ".join(f"{c} is not null" for c in on)).groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > (rows or HOT_ROWS))
    return known.orderBy(F.desc("n"), *on).limit(HOT_KEYS).collect()


def salted_join(left: DataFrame, right: DataFrame, on: str | list[str], by: list[str], how: str = "inner", rows: int | None = None, found: list | None = None) -> DataFrame:
    """``left.join(right, on, how)`` where single keys may hold most of ``left``, which has to be cheap to read twice.

    The rows of such a key (``found``, or :func:`hot_keys` of ``left``) are dealt to n / ``rows`` parts by a hash of
    ``by``, and ``right``'s rows of the key are given to each part. Only the list of these keys is broadcast: at most
    ``HOT_KEYS`` rows.
    """
    on, rows = [on] if isinstance(on, str) else on, rows or HOT_ROWS
    found = hot_keys(left, on, rows) if found is None else found
    if not found:
        return left.join(right, on, how)
    kinds = {c: t for c, t in left.dtypes}
    parts = left.sparkSession.createDataFrame([(*[r[c] for c in on], -(-r["n"] // rows)) for r in found], ", ".join([*(f"{c} {kinds[c]}" for c in on), "parts int"]))
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")).cast("int"), F.lit(0))
    one = left.join(F.broadcast(parts), on, "left").withColumn("part", part).drop("parts")
    two = right.join(F.broadcast(parts), on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return one.join(two, [*on, "part"], how).drop("part")


def bit_words(keys: DataFrame, key: str) -> DataFrame:
    """The set bits of a map of ``BITS`` bits of the hashes in ``key``: (word, bits), at most BITS / 64 rows."""
    at = F.pmod(F.col(key), F.lit(BITS))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def maybe_in(rows: DataFrame, key: str, words: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false where the hash in ``key`` is certainly none of those behind ``words``.

    The map has a fixed size and is broadcast; a full one only lets more rows pass for the exact join that follows.
    """
    word, bits = free_names(rows, "word", "bits")
    words = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    marked = rows.withColumn(word, F.shiftright(F.pmod(F.col(key), F.lit(BITS)), 6)).join(words, word, "left")
    return marked.withColumn(flag, F.coalesce(F.getbit(bits, F.pmod(F.col(key), F.lit(64)).cast("int")) == 1, F.lit(False))).drop(word, bits)

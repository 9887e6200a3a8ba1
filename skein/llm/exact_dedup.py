"""Exact deduplication through an extendible-hash index on shared files.

1. Every row gets a 64-bit key (xxHash of the whole text). Keys are counted where
   they are read (map-side) and then once a key: the key table.
2. A directory is grown over the leading bits of the keys: it starts with one cell
   and doubles while some cell holds more than ``capacity`` keys; a bucket is split
   only down to the depth where it fits (its local depth), so several directory
   cells may share one bucket. A bucket is named by its first cell.
3. The directory places every row: its key's cell names the bucket, and the bucket
   the owner task. Owners hold ranges of buckets, thus of keys, one range a
   partition; no bucket spans two of them.
4. An owner chains the texts of a key by comparing whole texts (the aggregation
   within the task has the text itself as a key), so equal hashes of different
   texts stay apart. What it finds is the index, one entry a distinct text, sorted
   by bucket and key and written as the owner's own file.
5. Texts travel to owners only where they can matter: rows whose key is certainly
   met once (by a bitmap of fixed size, which is broadcast) stay where they are, and
   the index, which is of the texts of shared keys, has no entry for them. The rows
   of a very common key are combined beforehand in parts, on the map side too, so a
   hot text reaches its owner as a few rows.

Only DataFrame functions run here. Defined cases: a null text counts as empty;
repeated doc_ids are rows of their own (each gets a result row); a null doc_id
loses against any other and is the kept id only in a group without ids; an empty
table gives an empty result; extra columns, whatever their names, are ignored by
:func:`groups` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys a bucket may hold before it is split.
CAPACITY = 100_000
#: A key with more rows than this is combined in so many parts before it goes to its owner.
HOT, PARTS = 1000, 32


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth) for each used directory cell, and the global depth.

    ``keys`` has one row a key, in column ``key``. A bucket is named by the first cell of
    its range. The directory has about ``keys / capacity`` cells; it stays a table. The
    doublings that the number of keys makes certain are done at once.
    """
    depth = max(0, (keys.count() // max(1, capacity)).bit_length() - 1)
    while True:
        cells = keys.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("n"))
        # At 64 bits a cell is one key.
        if depth == 62 or (cells.agg(F.max("n")).first()[0] or 0) <= max(1, capacity):
            break
        depth += 1
    cells = common.stored(cells, "directory")
    # A bucket's depth: the least d at which the cell's prefix of d bits is not overfull.
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
    fits = prefixes.groupBy("d", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") <= capacity)
    local = prefixes.join(fits, ["d", "prefix"], "left_semi").groupBy("cell").agg(F.min("d").alias("local_depth"))
    out = cells.join(local, "cell", "left").withColumn("local_depth", F.coalesce("local_depth", F.lit(depth)))
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    return out.select("cell", bucket.alias("bucket"), "local_depth"), depth


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def owner(bucket: str, depth: int, owners: int) -> Column:
    """The owner task of a bucket: the ranges of the directory's cells are dealt in equal shares."""
    return F.floor(F.col(bucket) / F.lit(float(2**depth)) * owners).cast("int")


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def index(rows: DataFrame, keys: DataFrame, capacity: int, *merges: Column) -> DataFrame:
    """owner, bucket, key, text, n and the merged values for each distinct text of ``rows`` (key, text, values).

    ``merges`` are aggregates named as the values they merge. Rows of one bucket lie in one partition, sorted by
    bucket and key.
    """
    spark = rows.sparkSession
    cells, depth = directory(keys, capacity)
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merges = (F.sum("n").alias("n"), *merges)
    placed = rows.withColumn("cell", _cell(depth)).join(cells.select("cell", "bucket"), "cell").drop("cell").withColumn("n", F.lit(1).cast("long"))
    known = keys.where(F.col("n") > HOT).orderBy(F.desc("n"), "key").limit(common.HOT_KEYS).select("key").collect()
    if known:
        marked = placed.join(F.broadcast(spark.createDataFrame(known, "key long").withColumn("hot", F.lit(True))), "key", "left")
        # Dealt by what a row holds, so that a task that runs anew deals as before; equal rows are combined where they are read.
        own = [c for c, kind in rows.dtypes if c not in ("key", "text") and not any(k in kind for k in ("map<", "variant"))]
        part = F.pmod(F.xxhash64(*own) if own else F.lit(0), F.lit(PARTS))
        hot = marked.where("hot").withColumn("part", part).groupBy("bucket", "key", "text", "part").agg(*merges).drop("part")
        placed = marked.where("hot is null").select(hot.columns).unionByName(hot)
    owned = placed.withColumn("owner", owner("bucket", depth, owners)).repartitionById(owners, F.col("owner"))
    return owned.groupBy("owner", "bucket", "key", "text").agg(*merges).sortWithinPartitions("bucket", "key")


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(F.col("text")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    # From here on a text is told from others of its key by its digest: whole texts move to their owners only.
    narrow = common.stored(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "rows")
    keys = common.stored(narrow.groupBy("key").agg(F.count("*").alias("n")), "keys")
    words = common.stored(common.bit_words(keys.where("n > 1"), "key"), "shared-keys")
    shared = common.maybe_in(rows, "key", words, "shared").where("shared")
    chains = index(shared.select("key", "text", F.col("doc_id").alias("keep_id")), keys, capacity, F.max("keep_id").alias("keep_id"))
    chains = common.stored(chains.select("owner", "bucket", "key", F.sha2("text", 256).alias("text_sha256"), F.col("n").alias("group_size"), "keep_id"), "index")
    marked = common.maybe_in(narrow, "key", words, "shared")
    found = marked.where("shared").drop("shared")
    copies = common.salted_join(found, chains.select("key", "text_sha256", "group_size", "keep_id"), ["key", "text_sha256"], ["doc_id"])
    single = marked.where("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    both = copies.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(single)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest doc_id.

    Rows that repeat both text and doc_id stay once. All columns are kept, whatever their names.
    """
    text = _text(F.col("text"))
    rows = common.packed(docs, text=text, key=F.xxhash64(text))
    keys = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    words = common.stored(common.bit_words(keys.where("n > 1"), "key"), "shared-keys")
    marked = common.maybe_in(rows, "key", words, "shared")
    # The text is sent once: the kept row is made of the others' columns, the text, and whether it was null.
    rest = [c for c in docs.columns if c.lower() != "text"]
    own = F.col("row")
    best = F.struct(*[own.getField(c) for c in rest], own.getField("text").isNull().alias("null text"))
    # Rows that agree in text and doc_id are told apart by what else can be hashed, so that runs agree.
    hashed = [own.getField(c) for c, kind in docs.dtypes if c in rest and not any(k in kind for k in ("map<", "variant"))]
    order = F.struct(own.getField("doc_id").isNotNull(), own.getField("doc_id"), own.getField("text").isNotNull(), F.xxhash64(*hashed))
    shared = marked.where("shared").select("key", "text", best.alias("best"), order.alias("order"))
    kept = index(shared, keys, capacity, F.max_by("best", "order").alias("best"), F.max("order").alias("order"))
    whole = F.when(F.col("best").getField("null text"), F.lit(None)).otherwise(F.col("text")).cast(dict(docs.dtypes)["text"])
    back = kept.select(*[(whole if c.lower() == "text" else F.col("best").getField(c)).alias(c) for c in docs.columns])
    return marked.where("not shared").select("row.*").unionByName(back)

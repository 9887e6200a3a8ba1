"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. *Sketch.* A text's set of word shingles is placed in ``COORDS`` bins in rounds: in
   round i each element falls in a bin and leaves i + a hashed fraction there, the
   least stays; rounds go on until every bin is filled, and from round ``COORDS`` on all
   elements go to one bin after another, so that no bin can stay empty. Two sets
   agree at a coordinate with probability equal to their similarity, with the
   concentration of independent trials.
2. *Classes.* Equal sets are one class (they are linked whatever else holds), so exact
   copies cost one row from here on.
3. *Bands* of ``ROWS`` coordinates give ``COORDS / ROWS`` bucket keys a class. A pair at the
   threshold 0.8 misses all of 40 buckets with probability 1.2e-7.
4. *Stars.* In each bucket the class with the largest total of bucket sizes (the one
   nearest to the middle of its group) is compared with the others; exact links
   give components. The middle's text is sent once for each ``PART`` classes compared with it, not once a pair.
5. *Rest.* Only buckets that hold classes of several components are left. Small ones
   give their pairs across components; large ones are cut in blocks, and a task
   compares two blocks by exact set products, giving a spanning forest of what
   links, never pairs. So no bucket, whatever its size, lands in one task, and no
   pair that shares a bucket goes unchecked unless a chain of links joins it already.
6. *Components* of all links by label spreading with pointer jumping; the label is the
   smallest doc_id.

Texts move only where they are compared: one row a class of a shared bucket, found by a
bitmap of fixed size. Buckets, hubs, labels and sets that hold very many rows are joined in parts.

All links are confirmed on the full sets (64-bit hashes of all shingles).

Defined cases: a null text, or one without words, has an empty set, size 0, and is
its own component; fewer words than a shingle has form one; rows that repeat a
doc_id each get a result (with texts that differ, each its own component's label);
a null doc_id never is a label unless all of its component are null; extra columns
are ignored by :func:`components` and kept, whatever their names, by :func:`deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 80  # per cent
ROWS, BANDS = 5, 40
COORDS = ROWS * BANDS
#: Buckets up to this size give pairs; larger ones are compared block by block.
SMALL = 12
BLOCK = 256
#: Classes that are compared with one copy of a middle's text.
PART = 256

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_PLACE = [np.uint64(pow(_GOLD, 2 * j + 1, 1 << 64) | 1) for j in range(64)]
_S = [np.uint64(s) for s in (27, 30, 31, 10)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[1])) * _A
    x = (x ^ (x >> _S[0])) * _B
    return x ^ (x >> _S[2])


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        return mixed(np.array([sum(int(x) * int(_PLACE[j + 32]) for j, x in enumerate(h)) + len(h) & (1 << 64) - 1], np.uint64))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        total += h[j : len(h) - width + 1 + j] * _PLACE[j]
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of filled coordinates for each (non-empty) set."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * coords, empty, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sets):
        return out.reshape(0, coords)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * coords):
        v = mixed(elements + np.uint64((i + 1) * _GOLD & (1 << 64) - 1))
        at = (v % np.uint64(coords)).astype(np.int64) if i < coords else i - coords
        np.minimum.at(out, owner * coords + at, (np.uint64(i) << np.uint64(54)) | (v >> _S[3]))
        open_sets = (out.reshape(-1, coords) == empty).any(1)
        keep = open_sets[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
        if not len(owner):
            break
    return out.reshape(-1, coords)


def band_keys(coords: np.ndarray) -> np.ndarray:
    by_band = mixed(coords).reshape(len(coords), BANDS, ROWS)
    total = np.zeros(by_band.shape[:2], np.uint64)
    for j in range(ROWS):
        total += by_band[:, :, j] * _PLACE[j + 8]
    return mixed(total + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(_GOLD)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def sketched(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n, s1 and s2 (digest of the set), t1 and t2 (of the text), bands; on shared files."""
    import xxhash

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), width) for t in batch.column("text")]
        raw = [s.tobytes() for s in sets]
        full = [s for s in sets if len(s)]
        keys = iter(band_keys(sketches(full)).tolist()) if full else iter(())
        signed = lambda seed: pa.array(np.array([xxhash.xxh64_intdigest(r, seed) for r in raw], np.uint64).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), signed(1), signed(2), batch.column("t1"), batch.column("t2"), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "n", "s1", "s2", "t1", "t2", "bands"],
        )

    return common.stored(common.map_batches(_keyed(docs), step, "doc_id long, n long, s1 long, s2 long, t1 long, t2 long, bands array<long>", "text"), "sketches")


def classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct non-empty set: node (a key of its own), smallest doc_id, a row's keys, bands."""
    from pyspark.sql import Window

    found = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min(F.struct("t1", "t2", "doc_id")).alias("x"), F.first("bands").alias("bands"))
    # Digests whose first half is equal (at most a few) get keys side by side.
    node = F.col("s1") + F.row_number().over(Window.partitionBy("s1").orderBy("s2")) - 1
    return common.stored(found.withColumn("node", node).select("node", "s1", "s2", "least", "n", "x.t1", "x.t2", "x.doc_id", "bands"), "classes")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) for the classes in ``nodes`` (node, t1, t2, doc_id)."""
    key = F.xxhash64("t1", "t2", "doc_id")
    words = common.stored(common.bit_words(nodes.select(key.alias("row_key")), "row_key"), "compared")
    rows = common.maybe_in(_keyed(docs).withColumn("row_key", key), "row_key", words, "compared").where("compared")
    wanted = nodes.select("node", "t1", "t2", F.col("doc_id").alias("id"))
    found = rows.join(wanted, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
    return common.stored(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b) of those of ``pairs`` (middle, node) that link, by their full sets; on shared files.

    The nodes of a middle are dealt to parts; a part's rows arrive sorted, the middle's text first.
    """
    pairs = common.stored(pairs.select("middle", "node"), "pairs")
    parts = common.stored(pairs.groupBy("middle").agg(F.ceil(F.count("*") / PART).cast("int").alias("among")), "middles")
    dealt = common.salted_join(pairs, parts, "middle", ["node"]).select("middle", F.pmod(F.xxhash64("node"), F.col("among")).cast("int").alias("share"), "node")
    ones = dealt.join(texts, "node").select("middle", "share", F.lit(1).alias("place"), "node", "text")
    middles = parts.join(texts.withColumnRenamed("node", "middle"), "middle")
    middles = middles.select("middle", F.explode(F.sequence(F.lit(0), F.col("among") - 1)).alias("share"), F.lit(0).alias("place"), F.col("middle").alias("node"), "text")
    order = ["middle", "share", "place", "node"]
    sent = middles.unionByName(ones).repartition("middle", "share").sortWithinPartitions(*order)
    held: dict = {"at": None, "set": None}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for middle, share, place, node, text in zip(*(batch.column(c).to_pylist() for c in order), batch.column("text")):
            own = shingles(text.as_py(), width)
            if place == 0:
                held["at"], held["set"] = (middle, share), own
            elif held["at"] != (middle, share):
                raise AssertionError("a node before its middle")
            elif linked(held["set"], own):
                found.append((min(middle, node), max(middle, node)))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = common.stored(common.map_batches(sent, step, "a long, b long", "text"), "links")
    for done in (pairs, parts):
        common.forget(pairs.sparkSession, done)
    return found


def spread(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of each node that has a link."""
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.stored(both, "edges")
    hubs = common.hot_keys(both, ["b"])
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = common.salted_join(both, labels.select(F.col("node").alias("b"), "label"), "b", ["a"], found=hubs)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # The label's own label is no larger and belongs to the same component.
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = common.salted_join(labels.select("node", "label"), ahead, "label", ["node"])
        after = jumped.join(near, "node").select("node", F.least("label", "near", "further").alias("label"), F.col("label").alias("old"))
        before, labels = labels, common.stored(after, "labels")
        common.forget(spark, before)
        if labels.where("label <> old").isEmpty():
            common.forget(spark, both)
            return labels.select("node", "label")


def _blocks(rest: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links across components within large buckets, block by block: a forest for each two blocks."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label").join(texts, "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, width) for t in group["text"]]
        nodes, label = group["node"].to_numpy(), pd.factorize(group["label"])[0]
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        names, code, count = np.unique(every, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count > 1
        place = np.cumsum(shared) - 1
        row, column = row[shared[code]], place[code[shared[code]]]
        product = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(shared.sum()), 8192):
            here = (column >= lo) & (column < lo + 8192)
            part = np.zeros((len(sets), min(8192, int(shared.sum()) - lo)), np.float32)
            part[row[here], column[here] - lo] = 1
            product += part @ part.T
        union = sizes[:, None] + sizes[None, :] - product
        a, b = np.nonzero(np.triu((100 * product >= THRESHOLD * union) & (label[:, None] != label[None, :]), 1))
        root = np.arange(label.max() + 1)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for x, y in zip(a, b):
            p, q = top(label[x]), top(label[y])
            if p != q:
                root[p] = q
                found.append((nodes[x], nodes[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def links(docs: DataFrame, found: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(a, b) links between the classes in ``found`` that give all components."""
    keyed = found.select("node", "n", F.explode("bands").alias("key"))
    sizes = common.stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    hot = sizes.select("key", F.col("size").alias("n")).where(F.col("n") > common.HOT_ROWS).orderBy(F.desc("n"), "key").limit(common.HOT_KEYS).collect()
    hits = common.stored(common.salted_join(keyed, sizes, "key", ["node"], found=hot), "hits")
    weight = hits.groupBy("node").agg(F.sum("size").alias("weight"))
    nodes = common.stored(found.join(weight.select("node"), "node", "left_semi").select("node", "t1", "t2", "doc_id"), "compared-classes")
    texts = _texts(docs, nodes)
    middle = common.stored(hits.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("m")), "bucket-middles")
    alike = lambda x, y: 100 * F.least(x, y) >= THRESHOLD * F.greatest(x, y)
    stars = common.salted_join(hits, middle, "key", ["node"], found=hot).where((F.col("node") != F.col("m.node")) & alike(F.col("n"), F.col("m.n")))
    # Of two classes the heavier is the middle in every bucket, so a pair is named one way.
    stars = common.stored(stars.select(F.col("m.node").alias("middle"), "node").distinct(), "stars")
    first = _verified(stars, texts, width)
    labels = spread(first)
    named = hits.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    open_keys = common.stored(open_keys, "open")
    rest = common.stored(common.salted_join(named, open_keys, "key", ["node"], found=hot), "rest")
    small = rest.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "label"))).alias("g"))
    small = small.select(F.col("g"), F.explode("g").alias("x")).select("x", F.explode(F.filter("g", lambda y: y["node"] > F.col("x.node"))).alias("y"))
    small = small.where((F.col("x.label") != F.col("y.label")) & alike(F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("middle"), F.col("y.node").alias("node")).distinct()
    done = stars.select(F.least("middle", "node").alias("middle"), F.greatest("middle", "node").alias("node"))
    second = _verified(small.join(done, ["middle", "node"], "left_anti"), texts, width)
    third = common.stored(_blocks(rest.where(F.col("size") > SMALL), texts, width), "links")
    # The links are all that is read from here on.
    for done in (sizes, hits, nodes, texts, middle, stars, labels, open_keys, rest):
        common.forget(docs.sparkSession, done)
    return first.unionByName(second).unionByName(third)


def _components(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t1, t2, n and component_id for each row of ``docs``."""
    rows = sketched(docs, width)
    found = classes(rows)
    labels = spread(links(docs, found, width))
    named = found.select("node", "s1", "s2", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = common.stored(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = common.stored(common.salted_join(named, least, "label", ["node"]).select("s1", "s2", "component_id"), "components")
    columns = ["doc_id", "t1", "t2", "n", "component_id"]
    full = rows.where("n > 0").select("doc_id", "t1", "t2", "n", "s1", "s2")
    out = common.salted_join(full, by_set, ["s1", "s2"], ["doc_id"]).select(columns)
    return out.unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")).select(columns))


def components(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``, over shingles of ``width`` words."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _components(docs, width).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each group, with all columns.

    Rows that repeat the kept doc_id within its group stay too; exact dedup goes before.
    Rows that are certainly not among those that go (by a bitmap of fixed size) stay where they are read.
    """
    keys = ["doc_id", "t1", "t2"]
    found = common.stored(_components(docs, width).select(*keys, F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "decisions")
    words = common.stored(common.bit_words(found.where("not kept").select(F.xxhash64(*keys).alias("row_key")), "row_key"), "dropped")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.packed(docs, id=F.col("doc_id").cast("long"), x1=F.xxhash64(text), x2=F.xxhash64(F.lit(1), text))
    marked = common.maybe_in(rows.withColumn("row_key", F.xxhash64("id", "x1", "x2")), "row_key", words, "doubted")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2"))
    doubted = marked.where("doubted").join(found.where("kept").select(keys).distinct(), same, "left_semi")
    return marked.where("not doubted").select("row.*").unionByName(doubted.select("row.*"))

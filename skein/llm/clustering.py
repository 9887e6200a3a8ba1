"""Centroid clustering: Lloyd's rounds over vectors sharded by dimension.

Vectors are scaled to integers once and written as shards: a row holds one block of
columns of one chunk of vectors, packed in the narrowest integers that take them. A
round is two passes over the shards:

1. A column-block task computes the partial squared distances of its chunks against
   its slice of each centroid, in 64-bit integers, so that they are exact. The partial
   distances meet by chunk: blocks are added, the least sum is the nearest centroid
   (of equal ones the smaller number). What crosses the network is one packed matrix a
   chunk and block, not the vectors.
2. The labels, two bytes a vector, go back to the shards of their chunk. Each shard adds
   up the columns that it holds by label, first within the task, then by block, label
   and column (map-side too), and each block divides its own sums: its slice of the new
   centroids.

No distance is computed from whole vectors and no key is a value of the data: chunks have
at most ``CHUNK`` vectors, so many equal vectors are no hot key. All centroids are k x 64
numbers, whatever the input; only these reach the driver and are broadcast. Rounds cut
their lineage with tables in the shared folder.

Defined cases: a vector that is null, or has another number of components, or a null or
non-finite one, is left out, and so is one with a component beyond +-2^27 once scaled,
for which a 64-bit distance may not be exact; repeated rows and ids are vectors of their
own; first centroids with equal hashes come in the order of their components; fewer
vectors than centroids give fewer centroids; an empty table gives an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Columns of a shard, and vectors of a chunk.
WIDTH, CHUNK = 32, 1024
LARGEST = float(1 << 27)


def integers(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x (the scaled components) of the vectors that are kept."""
    scaled = F.transform(F.col(f"`{column}`"), lambda v: F.floor(F.lit(scale) * v.cast("double")))
    fine = F.forall(F.col(f"`{column}`"), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(F.lit(scale) * v.cast("double")) <= F.lit(LARGEST)))
    return vectors.where(F.size(f"`{column}`") == dimensions).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def starts(kept: DataFrame, k: int = CENTROIDS, seed: str = "1") -> list[list[int]]:
    """The first centroids: the k vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [r["x"] for r in kept.orderBy(hashed, "x").limit(k).collect()]


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    if values.size:
        lo, hi = values.min(), values.max()
        for kind in (np.int8, np.int16, np.int32):
            if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
                return values.astype(kind)
    return values.astype(np.int64)


def _pack(values: np.ndarray) -> dict:
    own = narrow(values)
    return {"kind": own.dtype.str, "data": own.tobytes()}


def _unpack(kind: str, data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, columns).astype(np.int64)


def shards(kept: DataFrame, width: int = WIDTH, chunk: int = CHUNK, dimensions: int = DIMENSIONS) -> DataFrame:
    """chunk, block, kind and data of each shard, stored; ids (of the chunk's vectors, block 0 only) are 64-bit, null ones named in ``nulls``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                x = part.column("x").flatten().to_numpy().reshape(-1, dimensions)
                ids = part.column("vec_id")
                rows = []
                for block, first in enumerate(range(0, dimensions, width)):
                    own = {"ids": np.ascontiguousarray(ids.fill_null(0).to_numpy(zero_copy_only=False)).tobytes(), "nulls": np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()} if not block else {"ids": None, "nulls": None}
                    rows.append({"chunk": number, "block": block, **_pack(x[:, first : first + width]), **own})
                yield pa.RecordBatch.from_pylist(rows, SHARD)
                number += 1

    common.small_batches(kept.sparkSession)
    return common.stored(kept.mapInArrow(run, "chunk long, block int, kind string, data binary, ids binary, nulls binary"), "shards")


SHARD = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("ids", pa.binary()), ("nulls", pa.binary())])


def partial_distances(made: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """chunk, kind and data of the partial distances of each shard to its columns of the centroids."""
    known = made.sparkSession.sparkContext.broadcast(centroids)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in batch.to_pylist():
            own = known.value[:, r["block"] * width : (r["block"] + 1) * width]
            x = _unpack(r["kind"], r["data"], own.shape[1])
            rows.append({"chunk": r["chunk"], **_pack(np.stack([((x - c) ** 2).sum(axis=1) for c in own], axis=1))})
        return pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("data", pa.binary())]))

    return common.map_batches(made.select("chunk", "block", "kind", "data"), step, "chunk long, kind string, data binary", "data")


def nearest(partial: DataFrame, k: int) -> DataFrame:
    """chunk, labels (bytes, 16 bits each) and distances (64 bits each): the blocks of a chunk added, and the least sum."""
    import pandas as pd

    def add(key, rows):
        total = sum(_unpack(kind, data, k) for kind, data in zip(rows["kind"], rows["data"]))
        labels = total.argmin(axis=1)
        return pd.DataFrame({"chunk": [key[0]], "labels": [labels.astype("<u2").tobytes()], "distances": [total[np.arange(len(labels)), labels].astype("<i8").tobytes()]})

    return partial.groupBy("chunk").applyInPandas(add, "chunk long, labels binary, distances binary")


def updated(made: DataFrame, labels: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The next centroids: each block's sums of its own columns by label over the counts, rounded down; a centroid without vectors stays."""
    (k, dimensions), both = centroids.shape, made.select("chunk", "block", "kind", "data").join(labels.select("chunk", "labels"), "chunk")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                columns = min(width, dimensions - r["block"] * width)
                x, own = _unpack(r["kind"], r["data"], columns), np.frombuffer(r["labels"], "<u2")
                total, n = found.setdefault(r["block"], (np.zeros((k, columns), np.int64), np.zeros(k, np.int64)))
                for label in np.unique(own):
                    mine = own == label
                    total[label] += x[mine].sum(axis=0)
                    n[label] += mine.sum()
        for block, (total, n) in found.items():
            label, column = np.divmod(np.arange(total.size), total.shape[1])
            arrays = [pa.array(np.full(total.size, block, np.int32)), pa.array(label.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(total.ravel()), pa.array(n[label])]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "label", "column", "total", "n"])

    local = both.mapInArrow(sums, "block int, label int, column int, total long, n long")
    whole = local.groupBy("block", "label", "column").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    after = centroids.copy()
    # Whole numbers throughout: the total less its remainder divides evenly.
    for r in whole.select("block", "label", "column", F.expr("(total - pmod(total, n)) div n").alias("value")).collect():
        after[r["label"], r["block"] * width + r["column"]] = r["value"]
    return after


def clustered(vectors: DataFrame, column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "1", width: int = WIDTH, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of the kept vectors after the rounds, and (cluster, centroid) of all final centroids."""
    spark = vectors.sparkSession
    kept = integers(vectors, column, dimensions, scale)
    centroids = starts(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>")
    made, at, k = shards(kept, width, chunk, dimensions), np.array(centroids, dtype=np.int64), len(centroids)
    for _ in range(rounds):
        labels = common.stored(nearest(partial_distances(made, at, width), k).select("chunk", "labels"), "labels")
        at = updated(made, labels, at, width)
        common.forget(spark, labels)
    final = nearest(partial_distances(made, at, width), k)
    named = final.join(made.where("block = 0").select("chunk", "ids", "nulls"), "chunk")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, distances = [], [], []
        for r in batch.to_pylist():
            own = np.frombuffer(r["ids"], "<i8")
            ids.append(pa.array(own, mask=np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[: len(own)].astype(bool)))
            labels.append(np.frombuffer(r["labels"], "<u2"))
            distances.append(np.frombuffer(r["distances"], "<i8"))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(labels).astype(np.int32)), pa.array(np.concatenate(distances))], ["vec_id", "cluster", "distance"])

    assigned = common.map_batches(named, step, "vec_id long, cluster int, distance long", "ids")
    return assigned, spark.createDataFrame([(i, row) for i, row in enumerate(at.tolist())], "cluster int, centroid array<long>")


def digests(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    assigned, centroids = clustered(vectors, column)
    assigned = common.stored(assigned, "assigned")
    by = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by.agg(F.sum("cluster_inertia").alias("inertia"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda v: v.cast("string"))), 256)
    facts = common.stored(by.join(total).join(centroids.select("cluster", digest.alias("centroid_sha256")), "cluster"), "clusters")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

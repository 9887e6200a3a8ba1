import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import clustering


def brute(rows, k=16, rounds=3, dims=64):
    """Lloyd's rounds by whole vectors and Python's own integers."""
    kept = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) and abs(64 * v) <= 2**27 for v in x)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    distance = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    assign = lambda: [min((distance(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, at) in zip(kept, own) if at == j]
            if mine:
                centroids[j] = [sum(v) // len(mine) for v in zip(*mine)]
    own, inertia = assign(), {}
    for d, j in own:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, own)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def random_rows(n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(v) for v in rng.normal(size=64) * scale + i % 5]) for i in range(n)]


@pytest.fixture(scope="module")
def odd():
    nan, inf, rows = float("nan"), float("inf"), random_rows(300, 1)
    x = rows[0][1]
    rows += [(7, x), (7, x), (7, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]  # repeated ids and rows, no id
    rows += [(400, None), (401, []), (402, x[:63]), (403, [*x, 1.0]), (404, [nan, *x[1:]]), (405, [inf, *x[1:]]), (406, [None, *x[1:]]), (407, [1e300, *x[1:]])]
    return rows + [(500 + i, x) for i in range(400)]  # a hot vector


def test_equals_whole_vectors(spark, odd):
    df = table(spark, odd).withColumns({c: F.lit("clash") for c in ("x", "block", "chunk", "data", "labels", "cluster", "distance", "n", "ids", "kind")})
    assert got(clustering.digests(df)) == brute(odd)


def test_wide_values_are_exact(spark):
    rows = random_rows(60, 2, 2.0**19)
    assert got(clustering.digests(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("width,chunk", [(64, 1000), (1, 7), (5, 64), (16, 1)])
def test_shards_and_chunks_change_nothing(spark, width, chunk):
    rows = random_rows(120, 3)
    assigned, centroids = clustering.clustered(table(spark, rows), k=4, width=width, chunk=chunk)
    want = brute(rows, k=4)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()) == [w[:3] for w in sorted(want)]
    assert {hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() for r in centroids.collect()} >= {w[5] for w in want}


def test_equal_and_few_vectors(spark):
    rows = [(i, [0.5] * 64) for i in range(5)]
    assert got(clustering.digests(table(spark, rows))) == brute(rows)
    assert {r["cluster"] for r in clustering.digests(table(spark, rows)).collect()} == {0}


def test_empty_table(spark):
    assert clustering.digests(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert clustering.digests(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0

import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.llm import common, near_dedup


def brute(rows, width):
    """Components by comparing all pairs of shingle sets."""
    sets, par = [], {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset())
        par[k] = k

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                par[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[top(k)].append(i)
    label = lambda k: min((i for i in least[top(k)] if i is not None), default=None) if sets[k] else rows[k][0]
    return sorted(((i, len(sets[k]), label(k), i == label(k)) for k, (i, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def copies(seed, groups=12, size=9):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 5, 30, 120]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_all_pairs(spark, width):
    rows = copies(width)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.components(df, width)) == brute(rows, width)


def test_a_large_bucket_goes_block_by_block(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
        rows.append((n, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.components(df, 4)) == brute(rows, 4)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(near_dedup.components(awkward, 4)) == brute(rows, 4)


def test_kept_rows_keep_their_columns(awkward):
    unique = awkward.where("doc_id is not null and doc_id <> 8").dropDuplicates(["doc_id"])
    out = near_dedup.deduplicated(unique)
    assert out.columns == awkward.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5, 7]


def test_empty_table(nothing):
    assert near_dedup.components(nothing).count() == 0
    assert near_dedup.deduplicated(nothing).count() == 0


def test_every_coordinate_fills_and_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 300, 5000)]
    out = near_dedup.sketches(sets)
    assert not (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    agree = []
    for _ in range(60):
        shared = rng.integers(0, 2**63, 160).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 20).astype(np.uint64)])) for _ in range(2))
        x = near_dedup.sketches([a, b])
        agree.append((x[0] == x[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02
    assert np.std(agree) < 0.06


def test_short_texts_are_one_shingle():
    assert len(near_dedup.shingles("One two", 4)) == 1
    assert (near_dedup.shingles("one TWO", 4) == near_dedup.shingles(" one\ttwo ", 4)).all()
    assert (near_dedup.shingles("one two", 4) != near_dedup.shingles("two one", 4)).all()
    assert len(near_dedup.shingles(None, 4)) == 0


def test_hot_buckets_hubs_and_labels_in_parts(spark, monkeypatch):
    """With every path of splitting taken the result is that of all pairs."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(near_dedup, "PART", 3)
    rows = copies(11, groups=3, size=40) + [(10_000 + k, "the very same words in each of these rows here") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.components(df, 4)) == brute(rows, 4)


def test_salted_join_equals_a_join(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 10 < 8 then 0 when id % 10 = 8 then null else id end as k", "id % 3 as j")
    right = spark.range(0, 5000, 7).selectExpr("id as k", "id % 3 as j", "id * 2 as v").unionByName(spark.sql("select 0L as k, 1L as j, -1L as v"))
    for on in ("k", ["k", "j"]):
        for how in ("inner", "left"):
            plain, own = left.join(right, on, how), common.salted_join(left, right, on, ["id"], how, rows=100)
            assert own.columns == plain.columns
            assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
    tasks = common.salted_join(left, right, "k", ["id"], rows=100)._jdf.queryExecution().toString()
    assert "part" in tasks


def test_no_task_is_hot_without_adaptive_plans(spark):
    """A key on nine tenths of the rows: no task of the salted join gets more than twice the median."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100_000).selectExpr("id", "case when id % 10 < 9 then 0 else id end as k")
        right = spark.range(100_000).selectExpr("id as k", "id as v")
        out = common.salted_join(left, right, "k", ["id"], rows=500).groupBy(F.spark_partition_id()).count().toPandas()["count"].sort_values()
        assert len(out) == 4 and out.max() <= 2 * out.median()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_rows_have_all_columns(awkward):
    out = near_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns
    kept = {r["doc_id"] for r in near_dedup.components(awkward).where("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept

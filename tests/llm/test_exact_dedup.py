import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import common, exact_dedup


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["text"] or ""].append(r["doc_id"])
    out = []
    for r in rows:
        ids = by[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=repr)


def test_groups_of_awkward_rows(awkward):
    assert got(exact_dedup.groups(awkward)) == expected(awkward.collect())


@pytest.fixture(scope="module")
def hot(spark):
    return spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 1400).cast("string"))).alias("text"))


@pytest.mark.parametrize("capacity", [4, 100_000])
def test_buckets_split_and_a_hot_text(hot, capacity):
    assert got(exact_dedup.groups(hot, capacity=capacity)) == expected(hot.collect())


def test_the_capacity_changes_the_layout_alone(spark, hot):
    rows = hot.withColumn("key", F.xxhash64("text"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    found = {}
    for capacity in (16, 128, 100_000):
        out = exact_dedup.index(rows.select("key", "text", "doc_id"), keys, capacity, F.max("doc_id").alias("doc_id"))
        placed = common.stored(out.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "test-index")
        # An owner is a task, a bucket has one owner, and an owner's range of keys meets no other's.
        assert placed.groupBy("bucket").agg(F.countDistinct("task", "owner").alias("n")).where("n > 1").isEmpty()
        unsigned = F.expr("shiftrightunsigned(key, 1)")
        ranges = [tuple(r) for r in placed.groupBy("owner").agg(F.min(unsigned), F.max(unsigned)).orderBy("owner").collect()]
        assert all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
        for _, part in placed.toPandas().sort_values("place").groupby("task"):
            assert part[["bucket", "key"]].apply(tuple, axis=1).is_monotonic_increasing
        layout = frozenset((r["key"], r["bucket"], r["owner"]) for r in placed.collect())
        found[capacity] = (layout, sorted((r["key"], r["text"], r["n"], r["doc_id"]) for r in placed.collect()))
    assert len({layout for layout, _ in found.values()}) == len(found)
    assert all(rows == found[16][1] for _, rows in found.values())
    assert len({b for _, b, _ in found[16][0]}) > len({b for _, b, _ in found[128][0]}) > len({b for _, b, _ in found[100_000][0]}) == 1


def test_texts_that_share_a_key_stay_apart(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], "key long, text string").withColumn("top", F.lit(0))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = exact_dedup.index(rows, keys, 10, F.max("top").alias("top"))
    assert sorted((r["key"], r["text"], r["n"]) for r in out.collect()) == [(1, "a", 2), (1, "b", 1), (2, "c", 1)]


def test_directory_doubles_until_cells_fit(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    cells, depth = exact_dedup.directory(keys, capacity=50)
    assert depth > 4
    found = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("cell")).count().join(cells, "cell")
    assert found.groupBy("bucket").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] <= 50
    assert found.agg(F.sum("count")).first()[0] == 2000
    assert cells.groupBy("bucket").agg(F.countDistinct("local_depth").alias("n")).where("n > 1").isEmpty()


def test_kept_rows_have_all_columns(awkward):
    out = exact_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in awkward.collect()})
    assert [r["doc_id"] for r in out.where("text like 'alpha%'").collect()] == [2]
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id in (3, 4)").collect()} == {4: ""}


def test_a_null_text_that_stays_is_null(spark, awkward):
    out = exact_dedup.deduplicated(awkward.where("doc_id <> 4"))
    assert [r["text"] for r in out.where("doc_id = 3").collect()] == [None]


def test_a_hot_text_among_kept_rows(hot):
    out = exact_dedup.deduplicated(hot)
    best = {}
    for r in hot.collect():
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], 0))
    assert sorted((r["text"], r["doc_id"]) for r in out.collect()) == sorted(best.items())


def test_no_python_in_the_plans(spark, awkward):
    for df in (exact_dedup.groups(awkward), exact_dedup.deduplicated(awkward)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


def test_empty_table(nothing):
    assert exact_dedup.groups(nothing).count() == 0
    assert exact_dedup.deduplicated(nothing).count() == 0

import math

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    """Shares by rounds: who is above its limit is fixed there, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > limit * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: float(limit * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 20}, {"a": 5}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 97}, {f"s{k}": (k * 37) % 101 + 1 for k in range(40)}])
def test_targets_equal_rounds(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_awkward_rows(awkward):
    rows = mixing.mixture(awkward).collect()
    assert len(rows) == awkward.count()
    sizes = {(r["doc_id"], len((r["text"] or "").encode())): len((r["text"] or "").encode().split()) for r in awkward.collect()}
    assert sorted(r["size"] for r in rows) == sorted([*sizes.values(), 5])
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(awkward).collect())) if all(r["doc_id"] is not None for r in rows) else True


def test_words_come_near_the_targets(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.sqrt(F.col("id") / 500).cast("int")).cast("string")).alias("source"))
    got = mixing.mixture(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["source_size"] + 60 for r in got)


def test_emitted_copies(awkward):
    out = mixing.emitted(awkward)
    assert out.columns == awkward.columns
    want = {}
    for r in mixing.mixture(awkward).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_no_python_in_the_plan(awkward):
    plan = mixing.mixture(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(nothing):
    assert mixing.mixture(nothing).count() == 0
    assert mixing.emitted(nothing).count() == 0

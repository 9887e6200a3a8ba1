import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality
from skein.llm.queries import op10_quality

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_rows_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    out = op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    assert out.where("predicted = quality").count() >= 0.95 * out.count()


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(0)
    texts = [" ".join(random.Random(k).choices(["abc", "DEF!!", "x|y", "lorem", "1234"], k=40)) for k in range(40)]
    groups, shapes = quality.matrix(texts)
    space = quality.Space(np.ones(groups.shape[1], np.float32), np.linalg.qr(rng.standard_normal((groups.shape[1], 8)))[0].astype(np.float32), shapes.mean(0), shapes.std(0) + 1e-6, np.zeros((0, 0)), (np.arange(40) % 2).astype(float), np.ones(40), 0.5, 5)
    space.vectors = space.place(groups, shapes)
    got = space.scores(texts)
    for k in range(40):
        near = np.clip(space.vectors @ space.vectors[k], 0, None).astype(float)
        best = np.argsort(-near, kind="stable")[:5]
        w = near[best] ** 8 + 1e-12
        assert got[k] == pytest.approx((w * space.labels[best]).sum() / w.sum(), abs=1e-3)


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    twisted = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, twisted)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels) and a.prior == b.prior


def test_awkward_rows_and_no_labels(spark, awkward, nothing):
    rows = quality.scored(awkward, quality.fit(awkward, spark.createDataFrame([], LABELS))).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (2, 0, 0)], LABELS)
    rows = quality.scored(awkward, quality.fit(awkward, labels)).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(nothing, quality.fit(nothing, labels)).count() == 0


def test_long_labelled_texts_keep_their_counts(spark):
    long = "a" * 100_000 + " X9, " * 400
    rows = [(k, long if k % 2 else f"Some text {k}; no. {k * k}!") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    space = quality.fit(docs, spark.createDataFrame([(k, k % 2, 0) for k, _ in rows], LABELS))
    assert np.allclose(space.vectors[space.labels == 1], space.place(*quality.matrix([long])), atol=1e-6)

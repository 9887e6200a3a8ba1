import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import common, packing


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.encode_special_tokens = True
    return out


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_whole_encodings(library):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = packing.Words(f.read())
    assert own.direct
    rng = random.Random(3)
    signs = "abzAZ019 \t\n\x0b\x1c\x1f\x85\xa0 　﻿́éÉßΣςİıﬁ中한각🙂👩‍🚀'’\"!?.,-_<|>@#/\\­​\0"
    texts = ["", " ", "it's IT'S don't'll 'S", "<|endoftext|> a<|startoftext|>b", "x" * 300, "ΑΣ ΑΣΑ Σ", "á ȩ́ 가", "12,345.67e-8", "they'llve''d"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for text in texts * 2:  # the second time from the cache
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(library, text), repr(text)


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 2)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = packing.Words(f.read())
    text = "one two three two one four " + "long" * 40
    assert np.frombuffer(own.encode(text) + own.encode(text), "<u4").tolist() == 2 * ids(library, text) and len(own.known) == 2


def check(rows, docs, library, capacity):
    """The pieces are those of the documents, and each sequence is filled without a gap."""
    want = Counter()
    for r in docs:
        whole = [*ids(library, r["text"]), 1]
        for k, at in enumerate(range(0, len(whole), capacity)):
            part = whole[at : at + capacity]
            want[r["doc_id"], k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_awkward_rows(awkward, library, capacity):
    check(packing.digests(awkward, capacity=capacity).collect(), awkward.collect(), library, capacity)


def test_real_documents(spark, sf, library):
    docs = common.table(spark, sf, "documents")
    rows = packing.digests(docs).collect()
    n = check(rows, docs.collect(), library, 4096)
    assert n == -(-sum(r["length"] for r in rows) // 4096)


def test_sequences_hold_the_ids(spark, sf, library):
    docs = common.table(spark, sf, "documents").limit(60)
    made = common.stored(packing.pieces(docs), "test-pieces")
    placed = common.stored(packing.packed(made), "test-packed")
    got = {r["sequence_id"]: (r["n"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        n, whole = got[r["sequence_id"]]
        assert n == len(whole) and whole[r["offset"] : r["offset"] + r["length"]] == np.frombuffer(bytes(r["ids"]), "<u4").tolist()


def best_fit(histogram, capacity):
    """Piece by piece, the longest first, into the fullest sequence that takes it."""
    rooms = []
    for length in sorted(Counter(histogram).elements(), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def held(groups):
    out = Counter()
    for n, own in groups:
        for length, q in own.items():
            out[length] += n * q
    return out


@pytest.mark.parametrize("seed", range(6))
def test_residual_is_best_fit(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 60): rng.randrange(1, 40) for _ in range(rng.randrange(1, 25))}
    groups = packing.residual(dict(histogram), {}, 60)
    assert held(groups) == histogram and all(sum(a * q for a, q in own.items()) <= 60 for _, own in groups)
    assert sum(n for n, _ in groups) == best_fit(histogram, 60)


def shapes():
    rng = np.random.default_rng(5)
    yield "long tail", np.maximum(1, rng.lognormal(6.5, 1, 50_000)).astype(int) % 4097
    yield "one length", np.full(1000, 1500)
    yield "fits exactly", np.concatenate([np.full(500, 4000), np.full(500, 96)])
    yield "three lengths", np.concatenate([np.full(1000, 1500), np.full(1000, 1300), np.full(900, 2100)])
    yield "middling", rng.integers(1000, 2500, 20_000)


@pytest.mark.parametrize("name,lengths", list(shapes()))
def test_plans_hold_the_histogram_in_few_sequences(name, lengths):
    histogram = {int(k): int(n) for k, n in Counter(lengths.tolist()).items() if k}
    groups = packing.plan(histogram)
    assert held(groups) == histogram and all(sum(a * q for a, q in own.items()) <= 4096 for _, own in groups)
    least = sum(n for n, _ in packing.residual(dict(histogram), {}, 4096))
    assert sum(n for n, _ in groups) <= 1.002 * least + 1


def test_most_sequences_come_from_fitted_patterns():
    lengths = np.maximum(1, np.random.default_rng(5).lognormal(6.5, 1, 50_000)).astype(int) % 4097
    histogram = {int(k): int(n) for k, n in Counter(lengths.tolist()).items() if k}
    size = np.array(sorted(histogram))
    found = packing.patterns(size)
    assert ((found > 0).sum(axis=1) <= 4).all() and (found.sum(axis=1) <= 4096).all() and (found.sum(axis=1) + size[0] > 4096).all()
    x = packing.fitted(found, size, np.array([histogram[k] for k in size.tolist()], float))
    assert (x >= 0).all() and 0.8 < (x * found.sum(axis=1)).sum() / lengths.sum() < 1.01


def test_the_fit_is_a_least_squares_optimum():
    size, counts = np.array([1, 2, 3, 5]), np.array([40.0, 30, 20, 10])
    found = packing.patterns(size, capacity=8)
    x = packing.fitted(found, size, counts, 8, steps=20_000, thrift=0)
    used = np.array([[(p == s).sum() for s in size] for p in found]).T
    slope = used.T @ (size**2 * (used @ x - counts))
    assert (slope > -1e-3).all() and (np.abs(slope * x) < 1e-2).all()


def test_ranks_of_a_hot_length(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.repeat(F.lit("a "), (F.col("id") % 40).cast("int"))).alias("text")).repartition(7)
    rows = packing.digests(df, capacity=50).collect()
    assert len(rows) == 3000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000


def test_empty_table(nothing):
    assert packing.digests(nothing).count() == 0

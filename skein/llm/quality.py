"""Quality by the votes of nearest neighbours in a latent-semantic space.

A text becomes counts of three-sign groups over 16 classes of bytes and of hashed
letter triples, weighed by 1 + log(count), inverse document frequency and length,
plus a few shape figures (shares of upper case, signs, repeated words ...).
A truncated singular value decomposition of the labelled rows gives the latent
space. The labelled vectors are broadcast; each document's exact cosine products
with all of them are computed in blocks, and the labels of the ``neighbours``
nearest vote, weighed by a power of the similarity.

Fitting uses at most ``sample`` labelled rows of each class (those whose id hashes
lowest), so the broadcast matrix has at most ``2 * sample * rank`` numbers whatever
the input. Votes are weighed so that the classes count by their true shares.

Defined cases: a null or empty text has the zero vector and gets the share of
label 1; without labelled rows every score is 0.5; several labels of an id count as
1 if any is 1; repeated rows score alike; ties between neighbours go by the order of
the labelled rows, which is fixed; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import labelled_sample

SAMPLE = 1500
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
#: Width of the hashed letter triples; a power of two.
HASHED = 2048
SHAPES = 10


def _classes() -> np.ndarray:
    of = np.full(256, 15, np.uint16)
    of[ord("a") : ord("z") + 1] = 0
    of[128:] = 0
    of[ord("A") : ord("Z") + 1] = 1
    of[ord("0") : ord("9") + 1] = 2
    for k, chars in enumerate((" ", "\n\r", "\t\x0b\x0c", ".", ",", "!?", "|/\\", "%#$&*@~^", "-_=+", ":;", "'\"`", "()[]{}<>")):
        of[[ord(c) for c in chars]] = 3 + k
    return of


_CLASS = _classes()


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Group counts (4096 + HASHED) and shape figures of a text."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    c = _CLASS[b]
    groups = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=4096) if len(c) > 2 else np.zeros(4096, int)
    low = (b | 0x20).astype(np.uint32)
    triples = ((low[:-2] * 0x9E3779B1 + low[1:-1] * 0x85EBCA6B + low[2:] * 0xC2B2AE35) >> 20) & (HASHED - 1) if len(b) > 2 else np.zeros(0, int)
    words = raw.lower().split()
    n, size = max(1, len(words)), max(1, len(b))
    by = np.bincount(c, minlength=16)
    lines = raw.count(b"\n") + 1
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    shape = np.array([by[1] / max(1, by[0] + by[1]), by[2] / size, (by[10] + by[9]) / n, by[8] / n, (size - len(words)) / n / 10, len(set(words)) / n ** 0.9, repeats / n, np.log1p(n) / 8, lines / n, by[15] / size], np.float32)
    return np.concatenate([groups, np.bincount(triples, minlength=HASHED)]), shape


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [counts(t) for t in texts]
    return np.stack([f[0] for f in found]).astype(np.float32), np.stack([f[1] for f in found])


@dataclass
class Space:
    """Weights of the groups, the latent axes, and the labelled vectors with their votes."""

    idf: np.ndarray
    axes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def place(self, groups: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        latent = weighed(groups, self.idf) @ self.axes
        latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
        both = np.concatenate([latent, np.clip((shapes - self.mean) / self.spread, -4, 4) * 0.25], 1)
        both /= np.maximum(1e-9, np.linalg.norm(both, axis=1, keepdims=True))
        return both.astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        full = [i for i, t in enumerate(texts) if t]
        for k in range(0, len(full), 256):
            own = full[k : k + 256]
            near = self.place(*matrix([texts[i] for i in own])) @ self.vectors.T
            n = min(self.neighbours, near.shape[1])
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            votes = np.maximum(0, np.take_along_axis(near, best, 1)).astype(np.float64) ** 8 * self.weight[best] + 1e-12
            out[own] = (votes * self.labels[best]).sum(1) / votes.sum(1)
        return np.clip(out, 0, 1)


def weighed(groups: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(groups) * idf
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Space:
    """The latent space of a bounded sample of the rows that are not held out."""
    rows = labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id")), sample)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, shapes = matrix([t.as_py() for t in batch.column("text")])
        return pa.RecordBatch.from_arrays([pa.array([g.astype(np.uint32).tobytes() for g in groups], pa.binary()), pa.array([s.tobytes() for s in shapes], pa.binary()), batch.column("y")], ["groups", "shapes", "y"])

    got = sorted((r["y"], bytes(r["groups"]), bytes(r["shapes"])) for r in common.map_batches(rows, step, "groups binary, shapes binary, y int", "text").collect())
    width = 4096 + HASHED
    nothing = Space(np.ones(width), np.zeros((width, 0)), np.zeros(SHAPES), np.ones(SHAPES), np.zeros((0, SHAPES)), np.zeros(0), np.zeros(0), 0.5)
    if not got:
        return nothing
    groups = np.stack([np.frombuffer(g, np.uint32) for _, g, _ in got]).astype(np.float32)
    shapes = np.stack([np.frombuffer(s, np.float32) for _, _, s in got])
    y = np.array([r[0] for r in got], np.float64)
    idf = np.log((1 + len(got)) / (1 + (groups > 0).sum(0))).astype(np.float32) + 0.3
    x = weighed(groups, idf)
    rank = min(rank, len(got), width)
    # Randomised range finder with two power steps: the sample's leading right singular vectors.
    start = np.random.default_rng(7).standard_normal((width, min(width, rank + 16))).astype(np.float32)
    q = np.linalg.qr(x @ start)[0]
    for _ in range(2):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T
    share = {r["y"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("quality").cast("int").alias("y")).count().collect()}
    ones = y.sum()
    prior = share.get(1, 0) / max(1, sum(share.values()))
    by = {1: share.get(1, 0) / max(1, ones), 0: share.get(0, 0) / max(1, len(y) - ones)}
    space = Space(idf, axes.astype(np.float32), shapes.mean(0), shapes.std(0) + 1e-6, np.zeros((0, 0)), y, np.where(y == 1, by[1], by[0]), float(prior), neighbours)
    space.vectors = space.place(groups, shapes)
    return space


def scored(docs: DataFrame, space: Space, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores([t.as_py() or "" for t in batch.column("text")])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, score double, predicted int", "text")

"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents kept, look-alike letters of other
scripts and digits or signs that stand for letters replaced, i and l (1 is either)
made one letter, joiners dropped, all else made a single blank. Where "!" stands
before a letter or digit, the text is also read with it as i, and counts by its heavier reading. The lexicon holds whole words and word beginnings with
the log odds of their document counts among labelled rows. One automaton finds all
of them and the exception phrases; a word counts once, by its heaviest entry, and
not at all inside an exception phrase. The sum is divided by a slowly growing
function of the text's length, cut at a ceiling and turned into a probability by a
logistic curve.

Fitting uses at most ``sample`` labelled rows of each class (those whose id hashes
lowest; the shares of the classes are put right afterwards) and keeps at most
``entries`` lexicon entries; both bounds are parameters. Entries occur in at least 2 and in 1 of 400 of the
sampled toxic rows and weigh more than the least of ``FLOORS``. Terms are counted on the
executors. Scoring reads whole texts.

Defined cases: a null or empty text matches nothing and gets the curve's value at
0; rows without label are scored, not learned from; several labels of an id count
as 1 if any is 1; without any labelled rows the score is 0.5 and nothing is
predicted; repeated rows score alike; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 4000
ENTRIES = 4096
THRESHOLD = 0.7
#: Standard errors taken off the log odds, and the floors tried for what is left.
DOUBT = 2.5
FLOORS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
#: What a single point may add to the loss by which a floor is chosen.
MOST = 5.0
#: Parts of the sample; each is measured with the entries of the others.
FOLDS = 8
#: Word beginnings of these lengths are entries besides whole words.
STEMS = (4, 5, 6)
#: Phrases in which a listed word means no harm.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pond scum", "scum line", "class clown", "sore loser")

#: Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ſ": "s",
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
_FOLD = str.maketrans(LOOKALIKES | {c: "" for c in "​‌‍⁠﻿­"} | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
#: 1 is written for i and for l, so these are one class on both sides.
_FOLD = {c: "i" if to == "l" else to for c, to in _FOLD.items()} | {ord("l"): "i"}
_SIGN = re.compile(r"!(?=\w)")
_BREAK = re.compile(r"[\W_\d]+")


def folded(text: str) -> str:
    """Words in folded form, with one blank before, between and after them."""
    return f" {_BREAK.sub(' ', text.lower().translate(_FOLD)).strip()} "


def readings(text: str) -> list[str]:
    """The folded text, and where "!" may stand for a letter also the one in which it does."""
    signed = _SIGN.sub("i", text)
    return [folded(text)] if signed == text else [folded(text), folded(signed)]


@dataclass
class Lexicon:
    """Entries are ' word ' or ' beginn' with their weights; slope and offset make the curve."""

    weights: dict[str, float]
    slope: float = 0.0
    offset: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: A density beyond this makes a text no more toxic.
    ceiling: float = math.inf
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            heaviest: dict[str, float] = {}
            for term, weight in self.weights.items():
                term = term.translate(_FOLD)
                heaviest[term] = max(weight, heaviest.get(term, -math.inf))
            for term, weight in heaviest.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase := folded(phrase), (len(phrase), None))
            self._automaton.make_automaton()
        return self._automaton

    def densities(self, text: str, floors: tuple[float, ...]) -> list[float]:
        """The density of the entries heavier than each of ``floors``; of two readings of the text the heavier one counts."""
        return [max(at) for at in zip(*(self._densities(words, floors) for words in readings(text)))]

    def density(self, text: str) -> float:
        return self.densities(text, (-math.inf,))[0]

    def _densities(self, words: str, floors: tuple[float, ...]) -> list[float]:
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        if self.weights:
            for end, (length, weight) in self.automaton().iter(words):
                begin = end - length + 1
                if weight is None:
                    free.append((begin, end))
                elif weight > found.get(begin, -math.inf):
                    found[begin] = weight
        if free:
            # One sweep over the beginnings and the ends of phrases up to them.
            free.sort()
            kept, k, reach = {}, 0, -1
            for at in sorted(found):
                while k < len(free) and free[k][0] <= at:
                    reach = max(reach, free[k][1])
                    k += 1
                if at >= reach:
                    kept[at] = found[at]
            found = kept
        size = math.log(math.e + words.count(" ") / 100)
        return [math.fsum(w for w in found.values() if w > floor) / size for floor in floors]

    def score(self, text: str) -> float:
        x = max(-30.0, min(30.0, self.slope * min(self.ceiling, self.density(text)) + self.offset))
        return 1 / (1 + math.exp(-x))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, size: int) -> DataFrame:
    """(text, y) of at most ``size`` labelled rows of each class, those whose ids hash lowest.

    The ids are bounded by ``2 * size``, so they are broadcast to the scan of the documents.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64(F.col("doc_id"), F.lit(label)), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(size).unionByName(known.where("y = 0").orderBy(*order).limit(size))
    ids = docs.sparkSession.createDataFrame(picked.collect(), "doc_id long, y int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")


def terms(text: str) -> set[str]:
    found = set()
    for word in {w for words in readings(text) for w in words.split()}:
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn entries, weights and curve from the rows that are not held out.

    How sure an entry has to be (``FLOORS``) and the curve come from crossing ``FOLDS``
    parts of the sample: each is measured with the entries of all others, which are nearly
    as many and as heavy as those of the whole.
    """
    rows = labelled_sample(docs, labels, "toxic", ~held_out(F.col("doc_id")), sample)
    rows = common.stored(rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)).cast("int")), "toxic-sample")
    sizes = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return Lexicon({}, exceptions=exceptions)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by = {(y, fold): Counter() for y in (0, 1) for fold in range(FOLDS)}
        for text, y, fold in zip(batch.column("text"), batch.column("y"), batch.column("fold")):
            by[y.as_py(), fold.as_py()].update(terms(text.as_py()))
        names = sorted(set().union(*by.values()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([by[k][t] for t in names], pa.int64()) for k in sorted(by))], ["term", *counts])

    counts = [f"{kind}{fold}" for kind in ("good", "bad") for fold in range(FOLDS)]
    counted = common.map_batches(rows, count, "term string, " + ", ".join(f"{c} long" for c in counts), "text")
    counted = common.stored(counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in counted.columns[1:])), "terms")

    def entries_of(folds: list[int]) -> list[tuple[str, float]]:
        bad, good = (sum(F.col(f"{kind}{f}") for f in folds) for kind in ("bad", "good"))
        all_bad, all_good = (float(sum(sizes.get((y, f), 0) for f in folds)) for y in (1, 0))
        odds = F.log((bad + 0.5) / (F.lit(all_bad + 0.5) - bad)) - F.log((good + 0.5) / (F.lit(all_good + 0.5) - good))
        sure = odds - DOUBT * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        chosen = counted.select("term", sure.alias("weight")).where((F.col("weight") > FLOORS[0]) & (bad >= max(2, all_bad / 400)))
        return [(r["term"], r["weight"]) for r in chosen.orderBy(F.desc("weight"), "term").limit(entries).collect()]

    # The classes' true shares among the labelled rows weigh the points.
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("toxic").cast("int").alias("y")).count().collect()
    share = {r["y"]: r["count"] / sum(n for (y, _), n in sizes.items() if y == r["y"]) for r in usable}
    crossed = {fold: Lexicon(dict(entries_of([f for f in range(FOLDS) if f != fold])), exceptions=exceptions) for fold in range(FOLDS)}

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [crossed[fold.as_py()].densities(text.as_py(), FLOORS) for text, fold in zip(batch.column("text"), batch.column("fold"))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    points = sorted((tuple(r["x"]), r["y"]) for r in common.map_batches(rows, measure, "x array<double>, y int", "text").collect())
    # Few labels are wrong, but one of a text full of entries would flatten the whole curve: densities end at a quarter of the toxic ones.
    tops = [sorted(x[k] for x, y in points if y == 1 and x[k] > 0) for k in range(len(FLOORS))]
    ceilings = [top[len(top) // 4] if top else math.inf for top in tops]
    curves = [curve([(min(x[k], ceilings[k]), y) for x, y in points], share) for k in range(len(FLOORS))]
    k = min(range(len(FLOORS)), key=lambda k: curves[k][2])
    slope, offset, _ = curves[k]
    return Lexicon({t: w for t, w in entries_of([*range(FOLDS)]) if w > FLOORS[k]}, slope, offset, exceptions, ceilings[k])


def curve(points: list[tuple[float, int]], weight: dict[int, float], rounds: int = 60, decay: float = 1e-2) -> tuple[float, float, float]:
    """Slope, offset and mean loss of the weighted logistic curve, by damped Newton steps.

    Points of class 1 at which no entry was found say nothing about how heavy entries have to be, and would flatten
    the curve: they count in the loss (no point more than ``MOST``), but the curve is not bent towards them.
    """
    import numpy as np

    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    w = np.where(y == 1, weight[1], weight[0])
    w = w / w.mean()
    scale = max(1e-9, float(np.abs(x).max()))
    all_of = np.stack([x / scale, np.ones_like(x)], 1), w, y
    told = (x > 0) | (y == 0)
    if not (told & (y == 1)).any():
        told = np.ones_like(told)
    a, w, y = (part[told] for part in all_of)
    b = np.zeros(2)
    ridge = np.diag([decay, decay])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    a, w, y = all_of
    z = np.clip(a @ b, -30, 30)
    return float(b[0] / scale), float(b[1]), float((w * np.minimum(MOST, np.logaddexp(0, np.where(y == 1, -z, z)))).mean())


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs``; the lexicon's size is bounded, so it travels with the task."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        scores = [own.score(t.as_py() or "") for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, score double, predicted int", "text")


def passed(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("boolean")
    def clean(texts):
        own = shared.value
        return texts.map(lambda t: own.score(t or "") < threshold)

    return docs.where(clean(F.col("text").cast("string")))

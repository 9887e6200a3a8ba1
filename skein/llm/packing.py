"""Packing documents into sequences by patterns, fitted with non-negative least squares.

1. Every text is encoded (word by word, a bounded cache of words a worker), one id ends
   it, and only what is longer than a sequence is cut, into whole sequences and a rest.
   Each piece gets its rank among the pieces of its length that the same task made.
2. The histogram of lengths is all that reaches the driver: at most ``CAPACITY`` rows.
3. Patterns of few documents are enumerated over the lengths that occur: one, two, three
   or four pieces that fill a sequence, or nearly (:func:`patterns`). How often each is
   used is fitted to the histogram by non-negative least squares (:func:`fitted`:
   accelerated projected gradient), rounded, and cut to the pieces there are, the fullest
   patterns first.
4. The pieces left are packed by best fit, the longest first, into the sequences that
   have room and into new ones. It works on (length, count) and (room, count), so that a
   million equal pieces are one step (:func:`residual`).
5. The plan is a list of ranges of ranks: pieces number i to j of a length go to
   sequences k and on, so many to each, at such a place. Pieces of one length are
   exchangeable; the global rank is the task's first rank (a running sum over the small
   table of counts by task and length) plus the rank within the task. Every piece then
   looks its range up by a binary search in the broadcast plan.

Nothing orders or gathers documents: one join with a small table, for which narrow rows
(no ids, no texts) are shuffled once. The plan's size depends on the capacity and the pattern limit,
not on the number of documents.

Defined cases: a null or empty text is one piece, the end id alone; repeated rows and
doc_ids are pieces of their own; a null doc_id is kept; an empty table gives an empty
result; extra columns are ignored. Which of several pieces of one length gets which
place is arbitrary, though fixed once the pieces are stored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 4096
END = 1
#: Words whose ids a worker keeps: so many, none longer than so many characters.
CACHED, LONGEST = 1 << 19, 64
#: Patterns offered to the fit, and its steps.
PATTERNS, STEPS = 30_000, 400
#: What a waste costs in the fit.
THRIFT = 1.0
#: Words of these signs go to the model at once: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: how the vocabulary splits such words in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: Byte-level vocabularies write each byte as a sign: the visible ones of Latin-1 as themselves, the others from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
_BLANKS = re.compile(r"[\x20\x09-\x0D]+").split
_ODD_BLANKS = re.compile(r"[\x1c-\x1f]").search


class Words:
    """Ids of texts, word by word: the vocabulary never joins anything across blanks."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.known = self.whole.model, {}
        # The short way is taken only where it gives what the library gives.
        letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
        probe = f"It's 42nd-rate: they'll #say@ \"x_y\" don't-we've I'm you're he'd..! {letters} ß'Été-7ÿ'ø. {' '.join(letters)}"
        self.direct = [self._parts(w) for w in probe.split()] == [self._whole(w) for w in probe.split()]

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _parts(self, word: str) -> bytes:
        word = word.lower()
        if word.isascii():
            found = [t.id for part in _PARTS(word) for t in self.model.tokenize(part)]
        else:
            found = [t.id for part in _PARTS(word) for t in self.model.tokenize(part.encode().decode("latin-1").translate(_SIGNS))]
        return np.asarray(found, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        words = _BLANKS(text) if _ODD_BLANKS(text) else text.split()
        known, fresh = self.known, {}
        for word in set(words).difference(known):
            ids = self._parts(word) if self.direct and _PLAIN(word) and "<|" not in word else self._whole(word)
            if len(known) < CACHED and len(word) <= LONGEST:
                known[word] = ids
            else:
                fresh[word] = ids
        if fresh:
            return b"".join([known[w] if w in known else fresh[w] for w in words])
        return b"".join(map(known.__getitem__, words))


_WORDS: dict[bytes, Words] = {}


def _encoder(definition: str) -> Words:
    """One encoder a worker process, whatever the number of batches."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _WORDS:
        _WORDS[key] = Words(definition)
    return _WORDS[key]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit) and, for placing, task and rank: the piece's number among those of its length in the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = b"" if end is None else np.asarray([end], "<u4").tobytes()
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, ranks = _encoder(definition.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id"), part.column("text")):
                    doc_id, ids = doc_id.as_py(), own.encode(text.as_py() or "") + tail
                    for k, at in enumerate(range(0, max(len(ids), 1), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(piece) // 4, piece, task, int(ranks[len(piece) // 4])))
                        ranks[len(piece) // 4] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids", "task", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, rank long")


def patterns(lengths: np.ndarray, capacity: int = CAPACITY, most: int = PATTERNS) -> np.ndarray:
    """Rows of up to four lengths (0: none), longest first, whose sum is within the capacity and that leave no room for the shortest one.

    For each longest length: alone, with the best-fitting second, and with the best-fitting last one after seconds (and
    thirds) spread evenly over the lengths that fit; so many of these that about ``most`` patterns come out.
    """
    fits = np.sort(lengths)
    each = max(2, most // max(1, 2 * len(fits)))

    def closing(room: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """The longest length within ``room`` and not above ``longest``; 0 where there is none."""
        at = np.searchsorted(fits, np.minimum(room, longest), side="right")
        return np.where(at > 0, fits[np.maximum(at - 1, 0)], 0)

    rows = []
    for a in fits[::-1]:
        room = capacity - a
        rows.append([a, closing(np.array([room]), np.array([a]))[0], 0, 0])
        seconds = fits[: np.searchsorted(fits, min(a, room), side="right")]
        if not len(seconds):
            continue
        b = seconds[np.unique(np.linspace(0, len(seconds) - 1, min(each, len(seconds))).astype(int))]
        c = closing(room - b, b)
        rows.extend(np.stack([np.full(len(b), a), b, c, closing(room - b - c, c)], axis=1).tolist())
        half = closing((room - b) // 2, b)
        rows.extend(np.stack([np.full(len(b), a), b, half, closing(room - b - half, half)], axis=1).tolist())
    found = np.unique(np.array(rows, dtype=np.int64).reshape(-1, 4), axis=0)
    found = -np.sort(-found, axis=1)
    found = np.unique(found, axis=0)
    # What leaves room for the shortest length is no whole pattern.
    return found[found.sum(axis=1) + fits[0] > capacity]


def fitted(found: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS, thrift: float = THRIFT) -> np.ndarray:
    """How often each pattern is used: x >= 0 that makes sum of (length * (used - counts))^2 least, by accelerated projected gradient.

    A miss weighs as the length does: long pieces are the hard ones. Of the many fits that are nearly as good, those
    that waste little are wanted: a room of w in a pattern costs ``thrift`` * w for each use (in units of the data).
    """
    if not len(found):
        return np.zeros(0)
    row = np.searchsorted(lengths, found)
    real = found > 0
    row, weight = np.where(real, row, 0), np.where(real, found.astype(float), 0.0)
    size = len(lengths)
    goal = counts * lengths.astype(float)
    cost = thrift * (counts.mean() * lengths.mean()) * (capacity - found.sum(axis=1))
    apply = lambda x: np.bincount(row.ravel(), (weight * x[:, None]).ravel(), size)
    back = lambda r: (weight * r[row]).sum(axis=1)
    # The largest eigenvalue, by powers.
    v = np.ones(len(found))
    for _ in range(30):
        v = back(apply(v / max(np.linalg.norm(v), 1e-300)))
    rate = 1 / max(1.05 * np.linalg.norm(v), 1e-300)
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        ahead = np.maximum(0, y - rate * (back(apply(y) - goal) + cost))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = ahead + (t - 1) / after * (ahead - x)
        if ((ahead - x) * (y - ahead)).sum() < 0:  # overshot: begin to gather speed anew
            after, y = 1.0, ahead
        x, t = ahead, after
    return x


def residual(left: dict[int, int], rooms: dict[int, list], capacity: int) -> list:
    """Best fit, longest first, over (length, count): groups of equal sequences as [count, {length: pieces}].

    ``rooms``: by the room left, groups that may take more; every group is in the result.
    """
    import bisect

    order = sorted(rooms)
    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fit = capacity // length
                groups = [(need // fit, fit), (1, need % fit)] if need % fit else [(need // fit, fit)]
                for count, pieces_each in groups:
                    if count:
                        _put(rooms, order, capacity - pieces_each * length, [count, {length: pieces_each}])
                break
            room = order[at]
            group = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            count, held = group
            fit = room // length
            whole = min(count, need // fit)
            parts = [(whole, fit)] if whole else []
            need -= whole * fit
            if whole < count and need:
                rest = min(fit, need)  # one sequence of the group takes fewer
                parts.append((1, rest))
                need -= rest
                whole += 1
            if whole < count:
                parts.append((count - whole, 0))
            for n, took in parts:
                _put(rooms, order, room - took * length, [n, held | ({length: held.get(length, 0) + took} if took else {})])
    return [g for groups in rooms.values() for g in groups]


def _put(rooms: dict[int, list], order: list[int], room: int, group: list) -> None:
    import bisect

    if room not in rooms:
        rooms[room] = []
        bisect.insort(order, room)
    rooms[room].append(group)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, most: int = PATTERNS, steps: int = STEPS) -> list:
    """Groups of equal sequences, [count, {length: pieces of it in each}], that hold the histogram exactly."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=float)
    if not len(lengths):
        return []
    found = patterns(lengths, capacity, most)
    times = np.rint(fitted(found, lengths, counts, capacity, steps)).astype(np.int64)
    left, groups = dict(histogram), []
    used = np.flatnonzero(times)
    for k in used[np.lexsort((-found[used, 0], -found[used].sum(axis=1)))].tolist():
        own: dict[int, int] = {}
        for length in found[k].tolist():
            if length:
                own[length] = own.get(length, 0) + 1
        n = min(int(times[k]), *(left[length] // q for length, q in own.items()))
        if n:
            groups.append([n, own])
            for length, q in own.items():
                left[length] -= n * q
    return groups + residual({k: n for k, n in left.items() if n}, {}, capacity)


def ranges(groups: list) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks by (length, first): sequences from ``sequence`` on get ``each`` pieces, the first one at ``offset``."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for count, held in groups:
        offset = 0
        for length in sorted(held, reverse=True):
            rows.append((length, at.get(length, 0), sequence, held[length], offset))
            at[length] = at.get(length, 0) + count * held[length]
            offset += length * held[length]
        sequence += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T))


def place(found: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, offset) of pieces by length and rank: a binary search among the ranges of each length present."""
    at = np.empty(len(length), dtype=np.int64)
    for one in np.unique(length):
        lo, hi = np.searchsorted(found["length"], [one, one + 1])
        mine = length == one
        at[mine] = lo + np.searchsorted(found["first"][lo:hi], rank[mine], side="right") - 1
    into = rank - found["first"][at]
    each = found["each"][at]
    return found["sequence"][at] + into // each, found["offset"][at] + into % each * length


def packed(made: DataFrame, capacity: int = CAPACITY, most: int = PATTERNS, steps: int = STEPS) -> DataFrame:
    """``made`` (a stored table: length, task, rank and any other columns) with sequence_id and offset, without task and rank."""
    spark: SparkSession = made.sparkSession
    counts = common.stored(made.groupBy("task", "length").agg(F.count("*").alias("n")), "length-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).hint("merge")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    known = spark.sparkContext.broadcast(ranges(plan(histogram, capacity, most, steps)))
    rest = [c for c in made.columns if c not in ("task", "rank")]
    # The table of counts grows with the tasks, and packs far smaller than it is: it is not to be broadcast.
    ranked = made.join(starts, ["task", "length"]).select(*rest, (F.col("before") + F.col("rank")).alias("rank"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = place(known.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(sequence), pa.array(offset)], [*rest, "sequence_id", "offset"])

    kinds = dict(made.dtypes)
    return common.map_batches(ranked, step, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "sequence_id long, offset long"]))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n (ids in it) and ids of each sequence: the ids of its pieces one after the other."""
    ordered = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    join = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return ordered.select("sequence_id", "n", join.alias("ids"))


def digests(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    made = pieces(docs, path, capacity, end)
    narrow = common.stored(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packed(narrow, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

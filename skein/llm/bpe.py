"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A segment of text is a monoid element: its token ids when encoded alone. A text is
cut blindly at its middle until the parts are small (``LEAF`` characters), the parts
are encoded, and neighbours are joined: a window around the seam between them is
encoded anew. It begins and ends at *breaks*, positions where every context splits
the text into separate matches of the pattern, and grows until its outermost tokens,
up to its first and from its last inner break, are those that the two segments have
there already. So the tokens outside have met their final neighbours: nothing beyond
a break depends on anything before it. Decoding concatenates up the same kind of tree.

Breaks are named by the classes (letters, numbers, blanks, other signs) that
characters of every script have had since Unicode 15.1 at least; next to a character that was
not assigned then, or lies beyond the first plane, there is none. A run of one class has no break; where one fills a
window the window grows on, at most to the ends of both segments, which is still
exact. The classes are those of the one pattern in ``BREAKS``; for any other pattern
no break is known, and a join encodes both segments anew.

Defined cases: a null or empty text has no tokens (hash of the empty string); equal
rows give equal results; extra columns are ignored by :func:`digests` and kept by
:func:`encoded` and :func:`decoded`; what these make gets a name of its own where a column has it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Segments up to this many characters are encoded whole.
LEAF = 512
#: First width of the window to each side of a seam, in characters.
WINDOW = 20
#: Characters from here on (the rarer scripts, emoji) have no breaks: tables of the first plane are looked up at once.
BMP = 0x10000
#: Fixed value: the pattern whose breaks are known.
BREAKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranges(kinds: str, without: str = "") -> str:
    """The characters whose category begins with one of ``kinds``, as the inside of a character class."""
    out, begin = [], None
    for i in range(BMP + 1):
        c = chr(i) if i < BMP else ""
        if c and c not in without and unicodedata.category(c)[0] in kinds and unicodedata.category(c) not in ("Cn", "Cs"):
            begin = i if begin is None else begin
        elif begin is not None:
            out.append(re.escape(chr(begin)) + (f"-{re.escape(chr(i - 1))}" if i - 1 > begin else ""))
            begin = None
    return "".join(out)


def breaks() -> re.Pattern:
    """Between a letter and what is none, a number and what is none, and a sign (but "'", which may begin a
    contraction) and a blank, letter or number; blanks and controls on the right are the ASCII ones alone."""
    letter, number = _ranges("L"), _ranges("N")
    sign = _ranges("PS", "'")
    blank = " \t\n\r"
    return re.compile(f"(?<=[{letter}])(?=['{sign}{number}{blank}])|(?<=[{number}])(?=['{sign}{letter}{blank}])|(?<=[{sign}])(?=[{letter}{number}{blank}])")


class Codec:
    """Ranks and pattern of one vocabulary, with the tree on top of it."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = [b""] * (1 + max(table.values()))
        for token, i in table.items():
            self.bytes_of[i] = token
        self.size_of = [len(b) for b in self.bytes_of]
        self.name_of = [str(i) for i in range(len(self.bytes_of))]
        #: How ids are packed: two bytes each where all fit.
        self.packing = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.breaks = breaks() if pattern == BREAKS else None

    def encode(self, text: str) -> list[int]:
        return self._segment(text, 0, len(text))

    def _segment(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.plain.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._segment(text, lo, mid), self._segment(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[lo:hi] from those of its parts before and after ``mid``."""
        wide_left = wide_right = self.window
        while self.breaks:
            begin, first = self._near(text, lo, mid, max(lo, mid - wide_left), -1)
            last, end = self._near(text, mid, hi, min(hi, mid + wide_right), 1)
            if begin is not None and end is not None:
                made = self.plain.encode_ordinary(text[begin:end])
                keep, skip = self._back(left, len(text[begin:mid].encode())), self._ahead(right, len(text[mid:end].encode()))
                # The tokens that each side has between its outer and its inner break.
                same_left = left[keep : keep + self._ahead(left, len(text[begin:first].encode()), keep)]
                same_right = right[skip - self._back_from(right, skip, len(text[last:end].encode())) : skip]
                if made[: len(same_left)] == same_left and made[len(made) - len(same_right) :] == same_right:
                    return left[:keep] + made + right[skip:]
                begin = end = None
            if wide_left >= mid - lo and wide_right >= hi - mid:
                break
            wide_left *= 1 if begin is not None else 4
            wide_right *= 1 if end is not None else 4
        return self.plain.encode_ordinary(text[lo:hi])

    def _near(self, text: str, lo: int, hi: int, edge: int, way: int) -> tuple[int | None, int | None]:
        """The outermost and the innermost break on one side of a seam, in the order of the text; the segment's
        own end is its outer bound once the window reaches it, and there need be no inner one then."""
        if way < 0:
            found = [m.start() for m in self.breaks.finditer(text, edge, hi) if m.start() > edge]
            if edge == lo:
                return lo, found[-1] if found else lo
            return (found[0], found[-1]) if len(found) > 1 else (None, None)
        found = [m.start() for m in self.breaks.finditer(text, lo + 1, min(len(text), edge + 1)) if m.start() < edge]
        if edge == hi:
            return found[0] if found else hi, hi
        return (found[0], found[-1]) if len(found) > 1 else (None, None)

    def _ahead(self, ids: list[int], size: int, at: int = 0) -> int:
        """How many tokens from ``at`` on make ``size`` bytes."""
        begin = at
        while size > 0:
            size -= self.size_of[ids[at]]
            at += 1
        if size:
            raise AssertionError("a window ended within a token")
        return at - begin

    def _back(self, ids: list[int], size: int) -> int:
        return len(ids) - self._back_from(ids, len(ids), size)

    def _back_from(self, ids: list[int], at: int, size: int) -> int:
        """How many tokens before ``at`` make ``size`` bytes."""
        begin = at
        while size > 0:
            at -= 1
            size -= self.size_of[ids[at]]
        if size:
            raise AssertionError("a window ended within a token")
        return begin - at

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def decimal(self, ids: list[int]) -> bytes:
        return ",".join(map(self.name_of.__getitem__, ids)).encode()


_CODECS: dict[tuple, Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec a worker process, whatever the number of batches."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file as a broadcast value: about a megabyte, whatever the input."""
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``docs``."""
    ranks, pattern = _vocabulary(docs.sparkSession, path, pattern)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(ranks.value, pattern)
        n, a, b = [], [], []
        for text in batch.column("text"):
            ids = own.encode(text.as_py() or "")
            n.append(len(ids))
            a.append(hashlib.sha256(own.decimal(ids)).hexdigest())
            b.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids`` (the ids packed in little-endian order, two bytes each if the vocabulary allows, else four).

    Where ``docs`` has such a column, the new one's name begins with "_".
    """
    ranks, pattern = _vocabulary(docs.sparkSession, path, pattern)
    import numpy as np

    @F.pandas_udf("struct<n_tokens:long,token_ids:binary>")
    def ids_of(texts):
        import pandas as pd

        own = codec(ranks.value, pattern)
        packed = [np.asarray(own.encode(t or ""), own.packing) for t in texts]
        return pd.DataFrame({"n_tokens": [len(p) for p in packed], "token_ids": [p.tobytes() for p in packed]})

    ids_of = ids_of.asNondeterministic()  # evaluated once, although two fields are read
    n, ids = common.free_names(docs, "n_tokens", "token_ids")
    made = common.packed(docs, ids=ids_of(F.col(f"`{text}`").cast("string")))
    return made.select("row.*", F.col("ids.n_tokens").alias(n), F.col("ids.token_ids").alias(ids))


def decoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded`` (or a name that is free): the bytes that ``ids`` stand for; null ids give empty bytes."""
    ranks, pattern = _vocabulary(docs.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def bytes_of(packed):
        import numpy as np
        import pandas as pd

        own = codec(ranks.value, pattern)
        return pd.Series([own.decode(np.frombuffer(p or b"", own.packing).tolist()) for p in packed])

    return docs.withColumn(common.free_names(docs, "decoded")[0], bytes_of(F.col(f"`{ids}`")))

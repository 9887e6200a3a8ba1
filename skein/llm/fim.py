"""Fill-in-the-middle by in-place block rotation.

A text is cut at two places into prefix, middle and suffix. The cuts are drawn in code
points and found in the UTF-8 bytes by one scan. The bytes lie in a bytearray, with a
sentinel put in front of each segment:

    <P>prefix <M>middle <S>suffix

Two neighbouring blocks change places by three reversals (of each block, then of both
together), in the same bytearray. One rotation of the last two blocks gives the form
``psm`` (prefix, suffix, middle); another one of the first two gives ``spm`` (suffix,
prefix, middle). The way back reads an output and its form alone: the sentinels are
found, the rotations undone in reverse order (three reversals with the blocks' sizes
exchanged), and the sentinels taken out. A text that holds a sentinel itself stays
plain, so each sentinel is found once: "<" begins none but at its first sign, thus no
match spans the seam between a segment and a sentinel.

Which form a text gets and where it is cut depends on its doc_id and length alone
(four 32-bit numbers of a SHA-256), so reruns agree.

No row meets another one: there is no shuffle; a text longer than a slice of a batch
stands alone (:func:`skein.llm.common.slices`).

Defined cases: a null text counts as empty; an empty text, or one with a sentinel, is
plain; a null doc_id is drawn as the text 'null'; repeated rows give equal results; an
empty table gives an empty result; extra columns, whatever their names, are kept by
:func:`transformed` and :func:`restored`, whose own columns get a name that is free.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Recipe:
    """Sentinels, the seed before ``:doc_id``, and of 100 texts how many are cut and how many of those are ``spm``."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1"
    cut: int = 90
    spm: int = 20

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or m[0] in "".join(x[1:] for x in marks) or any(m != x and x.startswith(m) for x in marks) for m in marks):
            raise ValueError("sentinels must differ, begin with a sign that none of them has further on, and not begin one another")

    def drawn(self, doc_id: int | None) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))

    def choose(self, doc_id: int | None, text: str) -> tuple[str, int, int]:
        """(form, end of the prefix, end of the middle), the ends in code points."""
        h1, h2, h3, h4 = self.drawn(doc_id)
        if not text or any(mark in text for mark in (self.prefix, self.suffix, self.middle)) or h3 % 100 >= self.cut:
            return PLAIN, 0, 0
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        return (SPM if h4 % 100 < self.spm else PSM), a, b

    def arrange(self, text: str, form: str, a: int, b: int) -> bytes:
        """The bytes of ``text`` in its form."""
        if form == PLAIN:
            return text.encode()
        first, second = len(text[:a].encode()), len(text[a:b].encode())
        p, s, m = (x.encode() for x in (self.prefix, self.suffix, self.middle))
        buffer = bytearray(text.encode())
        # The later sentinels first, so that the scanned places stay right.
        for at, mark in ((first + second, s), (first, m), (0, p)):
            buffer[at:at] = mark
        head, mid = len(p) + first, len(m) + second
        exchange(buffer, head, head + mid, len(buffer))
        if form == SPM:
            exchange(buffer, 0, head, len(buffer) - mid)
        return bytes(buffer)

    def restore(self, output: bytes, form: str) -> bytes:
        """The text's bytes, from an output and its form alone."""
        if form == PLAIN:
            return bytes(output)
        p, s, m = (x.encode() for x in (self.prefix, self.suffix, self.middle))
        buffer = bytearray(output)
        mid = len(buffer) - buffer.index(m)
        if form == SPM:
            exchange(buffer, 0, buffer.index(p), len(buffer) - mid)
        head = buffer.index(s)
        exchange(buffer, head, len(buffer) - mid, len(buffer))
        # prefix sentinel, prefix, middle sentinel, middle, suffix sentinel, suffix
        for at, mark in ((head + mid, s), (head, m), (0, p)):
            if buffer[at : at + len(mark)] != mark:
                raise ValueError("an output without its sentinels in place")
            del buffer[at : at + len(mark)]
        return bytes(buffer)


def exchange(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """buffer[lo:mid] and buffer[mid:hi] change places by three reversals."""
    for i, j in ((lo, mid), (mid, hi), (lo, hi)):
        part = buffer[i:j]
        part.reverse()
        buffer[i:j] = part


def transformed(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (code points; null where plain) and output, under names that are free."""
    names = common.free_names(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    made = common.packed(docs, __id=F.col("doc_id").cast("long"), __text=F.col("text").cast("string"))
    row = made.schema["row"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, forms, prefix, middle, out = [], [], [], [], []
        for doc_id, text in zip(batch.column("__id"), batch.column("__text")):
            text = text.as_py() or ""
            form, a, b = recipe.choose(doc_id.as_py(), text)
            n.append(len(text))
            forms.append(form)
            prefix.append(None if form == PLAIN else a)
            middle.append(None if form == PLAIN else b - a)
            out.append(recipe.arrange(text, form, a, b).decode())
        arrays = [batch.column("row"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = common.map_batches(made, step, f"row {row}, n long, form string, prefix_chars long, middle_chars long, output string", "__text")
    return found.select("row.*", *[F.col(c).alias(name) for c, name in zip(("n", "form", "prefix_chars", "middle_chars", "output"), names)])


def restored(outputs: DataFrame, recipe: Recipe = Recipe(), output: str = "output", form: str = "form") -> DataFrame:
    """``outputs`` with ``restored`` (or a name that is free): the text rebuilt from ``output`` and ``form``; null where either is null."""
    name = common.free_names(outputs, "restored")[0]
    made = common.packed(outputs, __output=F.col(f"`{output}`").cast("string"), __form=F.col(f"`{form}`").cast("string"))
    row = made.schema["row"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(o.as_py(), f.as_py()) for o, f in zip(batch.column("__output"), batch.column("__form"))]
        back = [None if o is None or f is None else recipe.restore(o.encode(), f).decode() for o, f in pairs]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(back, pa.string())], ["row", "restored"])

    return common.map_batches(made, step, f"row {row}, restored string", "__output").select("row.*", F.col("restored").alias(name))

"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

Base spans come from three patterns over whole texts. Their values are labelled
credentials (the label is the kind). For each kind a prefix tree of the values'
character classes is merged, state by state, where two states are statistically
compatible (Hoeffding bounds on their next-symbol and end frequencies, down all
common suffixes); what remains is a probabilistic automaton of the format. Every
other token of ``LEAST`` characters or more, letters alone included, is a candidate:
it is scored by its mean log likelihood a character under each automaton against the
class frequencies of all such tokens. Candidates whose score lies where the kind's own
values have theirs (from the share ``MISSED`` up to the highest: a plain number is likelier
than any mixture of digits and letters, and no example of it) are added as spans of
kind ``like_<kind>``, by the automaton whose lowest score they exceed most.

Learning takes at most ``sample`` distinct values a kind, those that hash lowest, in that order as long
as they have at most ``signs`` characters together; both are parameters. Class
frequencies are counted over all tokens of all texts.

Texts are read twice (learning, scanning); nothing of them is stored. Candidates of
a text are held against its base spans in one sweep.

Defined cases: a null text is empty and has no spans; without credentials only base
spans are given; positions are code points, ends exclusive; repeated rows give
equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(f"like_{k}" for k in BASE))
LEAST = 6
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)

SAMPLE = 400
SIGNS = 65_536
ALPHA = 0.05
#: Share of a kind's own values that may score below the threshold.
MISSED = 0.05
_UNSEEN = 1e-3
#: Scores of class words that a task keeps at hand.
_KNOWN = 1 << 18


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's index, value) of the base patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        # A run of 20 characters or more; a shorter one holds no longer match.
        found += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text)]
    found += [(*m.span(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


_CLASSES = {ord(c): "0" if c.isdigit() else "a" if c <= "f" else "g" for c in "0123456789abcdefghijklmnopqrstuvwxyz"} | {ord(c): "A" if c <= "F" else "G" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_ALPHABET = "0agAG+/_.=-"


def classes(value: str) -> str:
    """One sign a character: digits, letters up to f and beyond in either case, others as they are."""
    return value.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton; state 0 is the first. ``floor`` and ``top`` bound the scores that count as the format."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.seen, self.ends, self.next = [0], [0], [{}]
        self.uses: list[Counter] = [Counter()]
        self.floor, self.top = 0.0, math.inf
        for word in words:
            state = 0
            self.seen[0] += 1
            for sign in word:
                self.uses[state][sign] += 1
                if sign not in self.next[state]:
                    self.next[state][sign] = len(self.seen)
                    for column, empty in ((self.seen, 0), (self.ends, 0), (self.next, {}), (self.uses, Counter())):
                        column.append(empty)
                state = self.next[state][sign]
                self.seen[state] += 1
            self.ends[state] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _merge(self) -> None:
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            state = blue.pop(0)
            for other in red:
                if self._compatible(other, state):
                    self._redirect(red, state, other)
                    self._fold(other, state)
                    break
            else:
                red.append(state)
            of = {s for r in red for s in self.next[r].values()} - set(red)
            blue = sorted(of, key=lambda s: (-self.seen[s], s))

    def _redirect(self, red: list[int], state: int, to: int) -> None:
        for r in red:
            for sign, target in self.next[r].items():
                if target == state:
                    self.next[r][sign] = to

    def _alike(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) < (1 / math.sqrt(n) + 1 / math.sqrt(m)) * self._bound

    def _compatible(self, a: int, b: int) -> bool:
        todo, done = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if pair in done or a == b:
                continue
            done.add(pair)
            n, m = self.seen[a], self.seen[b]
            if not self._alike(self.ends[a], n, self.ends[b], m):
                return False
            for sign in self.uses[a].keys() | self.uses[b].keys():
                if not self._alike(self.uses[a][sign], n, self.uses[b][sign], m):
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            if into == state:
                continue
            self.seen[into] += self.seen[state]
            self.ends[into] += self.ends[state]
            self.uses[into].update(self.uses[state])
            for sign, target in self.next[state].items():
                if sign in self.next[into]:
                    todo.append((self.next[into][sign], target))
                else:
                    self.next[into][sign] = target

    def score(self, word: str, background: dict[str, float]) -> float:
        """Mean log likelihood ratio a sign against the background."""
        state, total = 0, 0.0
        for sign in word:
            known = state is not None and self.seen[state] > 0
            p = self.uses[state][sign] / self.seen[state] if known else 0.0
            total += math.log(max(p, _UNSEEN)) - math.log(background.get(sign, _UNSEEN))
            state = self.next[state].get(sign) if known else None
        return total / max(1, len(word))


def _string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def candidates(text: str, base: list[tuple]) -> list[re.Match]:
    """The tokens of a text that meet none of its base spans (ordered by their starts)."""
    found, k, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        # Spans that begin before the token's end: the furthest end among them decides.
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][1])
            k += 1
        if reach <= m.start():
            found.append(m)
    return found


def credentials(docs: DataFrame) -> DataFrame:
    """(kind, value, n) of the base spans and, with kind null, how often each class sign (value) occurs in tokens; on shared files."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, signs = Counter(), Counter()
        for value in batch.column("text"):
            text = value.as_py() or ""
            values.update((k, v) for _, _, k, v in base_spans(text))
            tokens = classes("".join(TOKEN.findall(text)))
            signs.update({c: n for c in _ALPHABET if (n := tokens.count(c))})
        rows = [(k, v, n) for (k, v), n in values.items()] + [(None, c, n) for c, n in signs.items()]
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()))], ["kind", "value", "n"])

    found = common.map_batches(docs.select(F.col("text").cast("string").alias("text")), step, "kind int, value string, n long", "text")
    return common.stored(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")


def sampled(values: list[str], signs: int) -> list[str]:
    """The first of ``values`` that have at most ``signs`` characters together."""
    out = []
    for value in values:
        if (signs := signs - len(value)) < 0:
            break
        out.append(value)
    return out


def learn(found: DataFrame, sample: int = SAMPLE, signs: int = SIGNS) -> tuple[dict[int, Automaton], dict[str, float]]:
    """An automaton a kind, and the background's class frequencies."""
    counts = {r["value"]: r["n"] for r in found.where("kind is null").collect()}
    total = sum(counts.values()) + len(_ALPHABET)
    background = {c: (counts.get(c, 0) + 1) / total for c in _ALPHABET}
    automata = {}
    for kind in range(len(BASE)):
        own = found.where((F.col("kind") == kind) & (F.length("value") <= signs))
        rows = own.select("value").orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        words = [classes(v) for v in sampled([r["value"] for r in rows], signs)]
        if len(words) < 5:
            continue
        automaton = Automaton(words)
        scores = sorted(automaton.score(w, background) for w in words)
        automaton.floor, automaton.top = max(0.1, scores[int(MISSED * len(scores))]), scores[-1]
        automata[kind] = automaton
    return automata, background


def format_of(word: str, automata: dict[int, Automaton], background: dict[str, float]) -> int | None:
    """The kind whose automaton a class word exceeds most, if any."""
    scores = [(kind, own, own.score(word, background)) for kind, own in automata.items()]
    return max(((x - own.floor, -kind, kind) for kind, own, x in scores if own.floor <= x <= own.top), default=(0, 0, None))[2]


def scan(docs: DataFrame, sample: int = SAMPLE, signs: int = SIGNS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(credentials(docs), sample, signs))
    known: dict[str, int | None] = {}

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        automata, background = model.value
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            own = [(a, b, k) for a, b, k, _ in base_spans(text)]
            every = own
            if automata:
                signs, added = classes(text), []
                for m in candidates(text, own):
                    word = signs[m.start() : m.end()]
                    if word not in known:
                        if len(known) > _KNOWN:
                            known.clear()
                        known[word] = format_of(word, automata, background)
                    if (kind := known[word]) is not None:
                        added.append((*m.span(), len(BASE) + kind))
                every = sorted(own + added, key=lambda s: (s[0], s[2]))
            n = Counter(k for _, _, k in own)
            rows.append((n[0], n[1], n[2], hashlib.sha256(_string(own).encode()).hexdigest(), _string(every)))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), step, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", "text")

"""Nearest declarations against a walk of each branch."""

import random

import pytest

from skein.operators import inheritance
from skein.sources import ingest


def plain(asked, bases, methods, states, known):
    up = {}
    for s, d in bases:
        up.setdefault(s, []).append(d)

    def above(t):
        seen, todo = set(), [t]
        while todo:
            for b in up.get(todo.pop(), []):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    out = set()
    for t, name in asked:
        around = above(t) | {t}
        own = [(s, i) for mt, mn, s, i, _ in methods if (mt, mn) == (t, name)]
        found = {i for _, i in own}
        signatures = {s for mt, mn, s, _, ok in methods if ok and mn == name and mt in around} - {s for s, _ in own}
        for signature in signatures:
            seen, todo = {t}, list(up.get(t, []))
            while todo:
                b = todo.pop()
                if b in seen:
                    continue
                seen.add(b)
                here = {i for mt, mn, s, i, ok in methods if ok and (mt, mn, s) == (b, name, signature)}
                found |= here
                todo += [] if here else up.get(b, [])
        strange = any(x not in known for x in around - {t})
        blocked = any((x, name) in states for x in around)
        if blocked or found:
            status = "state" if blocked else "resolved" if len(found) == 1 else "uncertain"
            node = min(found) if status == "resolved" else None
            out.add((t, name, status, node, len(found), node is not None and bool(own) and not strange))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_hierarchies(spark, seed):
    rng = random.Random(seed)
    types = [f"t{k:02}" for k in range(14)]
    bases = sorted({(types[k], types[rng.randrange(k)]) for k in range(1, 14) for _ in range(2)} | {("t05", "gone")})
    methods = [(rng.choice(types), rng.choice("fg"), rng.choice("xyz"), f"m{k}", rng.random() < 0.85) for k in range(22)]
    states = {(rng.choice(types), rng.choice("fgh")) for _ in range(2)}
    asked = [(t, n) for t in types for n in "fgh"]
    frame = lambda data, kind: spark.createDataFrame(sorted(data), kind)
    got = inheritance.nearest(frame(asked, "type string, name string"), frame(bases, "src string, dst string"), frame(methods, "type string, name string, signature string, id string, inheritable boolean"), frame(states, "type string, name string"), frame([(t,) for t in types], "type string"))
    assert {tuple(r[c] for c in ("type", "name", "status", "node_id", "n", "own")) for r in got.collect()} == plain(asked, bases, methods, states, set(types))


def test_a_circle_of_bases_ends(spark):
    frame = lambda data, kind: spark.createDataFrame(data, kind)
    got = inheritance.inherited(frame([("a", "f")], "type string, name string"), frame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"), frame([("c", "f", "x", "c.f", True), ("b", "g", "x", "b.g", True)], "type string, name string, signature string, id string, inheritable boolean"))
    assert [tuple(r) for r in got.collect()] == [("a", "f", "x", "c.f")]


def test_methods_of_other_files(spark):
    graph = ingest.parse_text(spark, {
        "base.sol": ("solidity", "contract Base {\n  uint total;\n  function pay() internal {}\n  function hidden() private {}\n  function ask() public {}\n}\n"),
        "mid.sol": ("solidity", "contract Mid is Base {\n  function ask() public {}\n}\n"),
        "top.sol": ("solidity", "contract Top is Mid {\n  function go() public { pay(); hidden(); ask(); own(); }\n  function own() internal {}\n}\n"),
    })
    found = {(r["dst"], r["confidence"]) for r in graph.edges.where("kind = 'calls' and src = 'top:Top.go'").collect()}
    assert ("base:Base.pay", "inferred") in found and ("mid:Mid.ask", "inferred") in found and ("top:Top.own", "certain") in found
    assert not any(d == "base:Base.hidden" for d, _ in found)


def test_unknown_signatures_end_on_a_circle(spark, monkeypatch):
    make, calls, plain_cut = spark.createDataFrame, [], inheritance.cut

    def counted(df):
        calls.append(1)
        assert len(calls) < 40, "rounds without end"
        return plain_cut(df)

    monkeypatch.setattr(inheritance, "cut", counted)
    methods = make([("b", "f", None, "b.f", True)], "type string, name string, signature string, id string, inheritable boolean")
    found = inheritance.inherited(make([("a", "f")], "type string, name string"), make([("a", "b"), ("b", "a")], "src string, dst string"), methods)
    assert [tuple(r) for r in found.collect()] == [("a", "f", None, "b.f")]


def test_levels_and_circles(spark, monkeypatch):
    """Types above circles are gone over by levels, those on and below them by rounds; without circles there are no rounds."""
    rng = random.Random(8)
    types = [f"t{k:02}" for k in range(12)]
    bases = sorted({(types[k], types[rng.randrange(k)]) for k in range(1, 12) for _ in range(2)} | {("t04", "gone"), ("t07", "t07")})
    methods = [(rng.choice(types), rng.choice("fg"), rng.choice(["x", "y", None]), f"m{k % 20}", rng.random() < 0.8) for k in range(24)]
    methods = [m for m in methods if m[2]] + [("t00", "f", None, "m90", True)]
    states, asked = {("t01", "g")}, [(t, n) for t in [*types, "alone"] for n in "fgh"]
    frame = lambda data, kind: spark.createDataFrame(sorted(data, key=str), kind)

    def found(bases):
        got = inheritance.nearest(frame(asked, "type string, name string"), frame(bases, "src string, dst string"), frame(methods, "type string, name string, signature string, id string, inheritable boolean"), frame(states, "type string, name string"), frame([(t,) for t in types], "type string"))
        return {tuple(r[c] for c in ("type", "name", "status", "node_id", "n", "own")) for r in got.collect()}

    circle = [*bases, ("t08", "t11"), ("t11", "t08")]
    assert found(circle) == plain(asked, circle, methods, states, set(types))
    for rounds in ("inherited", "spread"):
        monkeypatch.setattr(inheritance, rounds, lambda *a: pytest.fail("rounds without a circle"))
    assert found(bases) == plain(asked, bases, methods, states, set(types))

"""Callables through variables, against a walk of the definitions."""

import random

import pytest

from skein.engine import QueryEngine
from skein.operators import valueflow
from skein.sources import ingest

DEF = "scope string, position long, name string, kind string, value string, always boolean"
USE = "use_id string, scope string, position long, name string"


def plain(definitions, uses, up):
    def met(scope, position, name):
        mine = [d for d in definitions if d[0] == scope and d[2] == name]
        before = [d for d in mine if d[1] < position]
        kill = max((d[1] for d in before if d[5]), default=None)
        found = {d for d in before if kill is None or d[1] >= kill}
        if kill is None:
            at, seen = up.get(scope), {scope}
            while at and at not in seen:
                seen.add(at)
                outer = [d for d in definitions if d[0] == at and d[2] == name]
                if outer:
                    last = max((d[1] for d in outer if d[5]), default=None)
                    return found | {d for d in outer if last is None or d[1] >= last}
                at = up.get(at)
        return found

    out = set()
    for use_id, scope, position, name in uses:
        todo, seen = list(met(scope, position, name)), set()
        callables, unknown = set(), False
        some = bool(todo)
        while todo:
            d = todo.pop()
            if d in seen:
                continue
            seen.add(d)
            if d[3] == "callable":
                callables.add(d[4])
            elif d[3] == "name":
                more = met(d[0], d[1], d[4])
                unknown |= not more
                todo += more
            else:
                unknown = True
        if some:
            out.add((use_id, len(callables), min(callables) if len(callables) == 1 and not unknown else None, unknown))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    rng = random.Random(seed)
    up = {"f": "m", "g": "f", "h": "m"}
    definitions, taken = [], set()
    for k in range(40):
        scope, position, name = rng.choice("mfgh"), rng.randrange(30), rng.choice("abc")
        if (scope, position, name) in taken:
            continue
        taken.add((scope, position, name))
        kind = rng.choice(["callable", "callable", "name", "name", "other"])
        definitions.append((scope, position, name, kind, f"u{rng.randrange(4)}" if kind == "callable" else rng.choice("abcd"), rng.random() < 0.6))
    uses = [(str(k), rng.choice("mfgh"), rng.randrange(32), rng.choice("abcd")) for k in range(40)]
    got = valueflow.arriving(spark.createDataFrame(definitions, DEF), spark.createDataFrame(uses, USE), spark.createDataFrame(list(up.items()), "node string, up string"))
    assert {tuple(r[c] for c in ("use_id", "n", "node_id", "unknown")) for r in got.collect()} == plain(definitions, uses, up)


def test_edges_and_evidence(spark):
    graph = ingest.parse_text(spark, {"a.py": ("python", "def one():\n    pass\ndef two():\n    pass\ndef main(x):\n    pass\n")})
    definitions = spark.createDataFrame([("a", 1, "cb", "callable", "a:one", True), ("a:main", 10, "f", "name", "cb", True), ("a:main", 12, "g", "callable", "a:one", True), ("a:main", 13, "g", "callable", "a:two", False), ("a:main", 20, "f", "other", "", True)], DEF)
    uses = spark.createDataFrame([("1", "a:main", 11, "f", "a:main"), ("2", "a:main", 14, "g", "a:main"), ("3", "a:main", 21, "f", "a:main"), ("4", "a:main", 5, "none", "a:main")], USE + ", src string")
    engine = QueryEngine(graph)
    for _ in range(2):
        engine.flow_values(definitions, uses)
        assert [(r["src"], r["dst"]) for r in engine.graph.edges.where("kind = 'references'").collect()] == [("a:main", "a:one")]
        assert [(r["source_id"], r["symbol"], r["binding"]) for r in engine.graph.evidence.where("rule = 'value-flow'").collect()] == [("a:main", "g", "ambiguous")]


def test_definitions_of_one_place_hold_together(spark):
    """One that always happens ends what is before its place, not what is at it."""
    definitions = [("s", 1, f"n{k}", "callable", "old", True) for k in range(12)]
    definitions += [("s", 2, f"n{k}", "callable", value, always) for k in range(12) for value, always in (("a", True), ("b", False))]
    uses = [(str(k), "s", 3, f"n{k}") for k in range(12)]
    got = valueflow.arriving(spark.createDataFrame(definitions, DEF), spark.createDataFrame(uses, USE), spark.createDataFrame([("s", "t")], "node string, up string"))
    assert sorted(r["n"] for r in got.collect()) == [2] * 12


def test_uses_between_the_same_definitions_are_one(spark, monkeypatch):
    """What walks over the copies grows with the definitions, not with the uses."""
    walked = []
    closure = valueflow.traverse.closure
    monkeypatch.setattr(valueflow.traverse, "closure", lambda proj, roots, **more: walked.append(roots.distinct().count()) or closure(proj, roots, **more))
    definitions = [("s", 1, "f", "callable", "a", True), ("s", 2, "g", "name", "f", True)]
    uses = [(str(k), "s", 3 + k, "g") for k in range(200)] + [("0", "s", 5, "none")]
    got = valueflow.arriving(spark.createDataFrame(definitions, DEF), spark.createDataFrame(uses, USE), spark.createDataFrame([("s", "t")], "node string, up string"))
    assert {(r["n"], r["node_id"], r["unknown"]) for r in got.collect()} == {(1, "a", False)}
    assert got.count() == 200 and max(walked) <= 2

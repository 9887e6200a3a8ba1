"""Formal symbol linking: tiers, visibility, correspondence and what is evaluated, also against a plain version."""

import itertools
import random

import pytest

from skein.operators import formal


def tables(spark, refs=(), symbols=(), imports=(), arguments=()):
    make = spark.createDataFrame
    return make([*refs], formal.REFERENCES), make([*symbols], formal.SYMBOLS), make([*imports], "src string, dst string"), make([*arguments], formal.ARGUMENTS)


def symbol(id, module, name, signature=False, private=False, executable=True, ghosts=()):
    return (id, module, name, signature, private, executable, [*ghosts])


def plain(refs, symbols, imports, arguments, lenient):
    """The same, reference by reference."""
    sees = {}
    for module in {r[2] for r in refs}:
        found, todo = set(), [module]
        while todo:
            at = todo.pop()
            if at not in found:
                found.add(at)
                todo += [d for s, d in imports if s == at]
        sees[module] = found
    by_id = {s[0]: s for s in symbols}
    target = {}
    for ref, _, module, tiers, *_ in refs:
        for tier in tiers:
            found = [s for s in symbols if s[2] in tier and s[1] in sees[module] and (s[1] == module or not s[4])]
            rank = lambda s: (0 if not s[3] else 1) if s[1] == module else (2 if s[3] else 3)  # noqa: B023, E731
            if found:
                best = [s for s in found if rank(s) == min(map(rank, found))]
                if len(best) == 1:
                    target[ref] = best[0][0]
                break
    applied = {r[0] for r in refs if r[4]}
    scopes = {a[0]: a for a in arguments}

    def local(scope):
        _, _, callee, argument = scopes[scope]
        s = by_id.get(target.get(callee)) if callee in applied else None
        return None if s is None else s[5] and (not s[6] or argument not in s[6])

    out = {(None, s[0], min(d[0] for d in same), "corresponds_to", "inferred") for s in symbols if s[3] for same in [[d for d in symbols if d[2] == s[2] and not d[3]]] if len(same) == 1}
    for ref, src, _, _, application, context, enclosing in refs:
        if ref not in target:
            continue
        out.add((ref, src, target[ref], "references", "inferred"))
        runtime = context == "body"
        if context == "argument" and enclosing in scopes:
            values = []
            while enclosing in scopes:
                values.append(local(enclosing))
                enclosing = scopes[enclosing][1]
            runtime = False if False in values else None if None in values else True
        if application and by_id[src][5] and by_id[target[ref]][5] and (runtime or runtime is None and lenient):
            out.add((ref, src, target[ref], "calls", "inferred" if runtime else "uncertain"))
    return out


def test_tiers_and_ranks(spark):
    symbols = [symbol("a.f", "a", "f"), symbol("a.s", "a", "f", signature=True), symbol("b.g", "b", "g"), symbol("b.h", "b", "g", signature=True), symbol("c.k", "c", "k", private=True), symbol("b.m", "b", "m"), symbol("c.m", "c", "m"), symbol("d.z", "d", "z")]
    ask = lambda ref, *tiers: (ref, "a.f", "a", [*tiers], False, "proof", None)
    refs = [ask("own", ["f"]), ask("sig", ["g"]), ask("private", ["k"]), ask("twice", ["m"], ["f"]), ask("next", ["none"], ["f"]), ask("unseen", ["z"]), ask("empty"), ask("null", None, [None, "f"])]
    found = formal.bound(*tables(spark, refs, symbols, [("a", "b"), ("b", "c"), ("c", "a")])[:3])
    assert {tuple(r) for r in found.collect()} == {("own", "a.f", 1), ("sig", "b.h", 1), ("twice", None, 2), ("next", "a.f", 1), ("null", "a.f", 1)}


def test_what_is_evaluated(spark):
    symbols = [symbol("m.main", "m", "main"), symbol("m.id", "m", "id", ghosts=["g"]), symbol("m.spec", "m", "spec", executable=False)]
    ref = lambda name, called, context, enclosing=None: (name, "m.main", "m", [[called]], True, context, enclosing)
    refs = [ref("r0", "id", "body"), ref("r1", "id", "argument", "real"), ref("r2", "id", "argument", "ghost"), ref("r3", "id", "argument", "deep"), ref("r4", "id", "argument", "lost"), ref("r5", "id", "proof"), ref("r6", "spec", "body"), ref("r7", "gone", "body"), ref("r8", "id", "argument", "nowhere")]
    arguments = [("real", None, "r0", "x"), ("ghost", "real", "r0", "g"), ("deep", "ghost", "r0", "x"), ("lost", "real", "r7", "x")]
    own = tables(spark, refs, symbols, (), arguments)
    calls = lambda lenient: {(r.ref_id, r.confidence) for r in formal.linked(*own, lenient=lenient).where("kind = 'calls'").collect()}
    assert calls(False) == {("r0", "inferred"), ("r1", "inferred")}
    assert calls(True) == calls(False) | {("r4", "uncertain")}


def test_nothing_to_link(spark):
    assert formal.linked(*tables(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    modules, names = [f"m{k}" for k in range(6)], [f"n{k}" for k in range(9)]
    flip = lambda share: rng.random() < share
    symbols = [symbol(f"s{k}", rng.choice(modules), rng.choice(names), flip(0.4), flip(0.3), flip(0.8), ["g"] if flip(0.3) else []) for k in range(24)]
    imports = [pair for pair in itertools.permutations(modules, 2) if flip(0.15)]
    arguments = [(f"a{k}", f"a{rng.randrange(k)}" if k and flip(0.8) else None, f"r{rng.randrange(80)}", rng.choice("gx")) for k in range(30)]
    refs = [(f"r{k}", rng.choice(symbols)[0], rng.choice(modules), [rng.sample(names, rng.randint(0, 2)) for _ in range(rng.randint(0, 3))], flip(0.8), rng.choice(["body", "argument", "argument", "proof"]), f"a{rng.randrange(34)}") for k in range(80)]
    for lenient in (False, True):
        assert {tuple(r) for r in formal.linked(*tables(spark, refs, symbols, imports, arguments), lenient=lenient).collect()} == plain(refs, symbols, imports, arguments, lenient)


def test_what_is_seen_is_not_paired_with_who_sees_it(spark, monkeypatch):
    from skein.operators import components

    monkeypatch.setattr(components, "reach", lambda *a, **k: pytest.fail("pairs of components were made"))
    symbols = [symbol(f"m{k}.f", f"m{k}", "f") for k in range(3)] + [symbol("m2.g", "m2", "g")]
    refs = [("many", "m0.f", "top", [["f"]], False, "proof", None), ("one", "m0.f", "top", [["g"]], False, "proof", None)]
    own = tables(spark, refs, symbols, [("top", "m0"), ("m0", "m1"), ("m1", "m2")])
    assert {(r.ref_id, r.node_id, min(r.n, 2)) for r in formal.bound(*own[:3]).collect()} == {("many", None, 2), ("one", "m2.g", 1)}

import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import toxicity
from skein.llm.queries import op3_toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    words = [f"w{k}ord" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = k % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grobble", "snarkle", "flumpish"]))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_rows(spark, labelled):
    docs, labels = labelled
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").withColumn("h", toxicity.held_out(F.col("doc_id")))
    held = out.where("h")
    assert held.count() > 100
    assert held.where("predicted = toxic").count() >= 0.97 * held.count()
    assert out.where("(score >= 0.7) <> (predicted = 1)").count() == 0


def test_labels_of_held_out_rows_change_nothing(labelled):
    docs, labels = labelled
    twisted = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, twisted)


def test_folding_beginnings_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " lowei": 4.0, " clown ": 5.0}, 1.0, -2.0, ("class clown",))
    assert lexicon.density("an IDIOT!") == lexicon.density("an 1d10t") == lexicon.density("an іdiоt") > 4
    assert lexicon.density("das loweisp") > 3
    assert lexicon.density("idiotic") == 0
    assert lexicon.density("the class clown") == 0 < lexicon.density("the clown class")
    assert lexicon.density("idiot " + "word " * 2000) < lexicon.density("idiot")
    assert lexicon.score("") == pytest.approx(0.1192, abs=1e-3)


SPELLED = {"a": "aA@4аα", "b": "bB8", "c": "cCсС", "e": "eE3еε", "g": "gG69", "i": "iI1іι", "l": "lL1ⅼ", "o": "oO0оο", "s": "sS5$ѕ", "t": "tT7т", "z": "z2Z", "w": "wW", "r": "r", "n": "n", "d": "d", "u": "u"}


def plain_density(text, weights, exceptions, floor):
    """Every entry tried at every place, signs folded one at a time."""
    of = {}
    for letter, signs in SPELLED.items():
        for sign in signs:
            of.setdefault(sign, "i" if letter == "l" else letter)
    plain = lambda t: "".join(of.get(c, of.get(c.lower(), c.lower())) for c in t)
    best = None
    for reading in (text, re.sub(r"!(?=\w)", "i", text)):
        words = [w for w in re.split(r"[\W_\d]+", plain(reading)) if w]
        body = f" {' '.join(words)} "
        hits = {}
        for at in range(len(body)):
            for term, weight in weights.items():
                if body.startswith(plain(term), at):
                    hits[at] = max(weight, hits.get(at, weight))
        for phrase in exceptions:
            phrase = f" {' '.join(plain(phrase).split())} "
            for at in range(len(body)):
                if body.startswith(phrase, at):
                    hits = {k: w for k, w in hits.items() if not at <= k < at + len(phrase) - 1}
        size = math.log(math.e + body.count(" ") / 100)
        here = sum(w for w in hits.values() if w > floor) / size
        best = here if best is None else max(best, here)
    return best


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_densities_equal_a_naive_matcher(data):
    """Random lexicons over random spellings, against a matcher without automaton, sweep or shared folding."""
    letter = st.sampled_from("abcegilostzw")
    word = st.text(letter, min_size=1, max_size=5)
    terms = st.one_of(word.map(lambda w: f" {w} "), word.map(lambda w: f" {w}"))
    weights = data.draw(st.dictionaries(terms, st.floats(0.1, 6), max_size=12))
    exceptions = tuple(data.draw(st.lists(st.lists(word, min_size=2, max_size=3).map(" ".join), max_size=3)))
    known = sorted({t.strip() for t in weights} | {w for e in exceptions for w in e.split()}) or ["a"]
    spell = lambda w: "".join(data.draw(st.sampled_from(SPELLED[c])) for c in w)
    picked = data.draw(st.lists(st.one_of(st.sampled_from(known), st.sampled_from([t.strip() + "st" for t in weights] or ["a"]), word), max_size=12))
    glue = data.draw(st.sampled_from([" ", ", ", " !", "\n", "! "]))
    text = glue.join(spell(w) for w in picked)
    if exceptions and data.draw(st.booleans()):
        text += f" {exceptions[0]} "
    lexicon = toxicity.Lexicon(weights, exceptions=exceptions)
    floors = (-math.inf, 1.0, 3.0)
    want = [plain_density(text, weights, exceptions, f) for f in floors]
    assert lexicon.densities(text, floors) == pytest.approx(want)


def test_a_very_long_text_is_swept_once():
    lexicon = toxicity.Lexicon({" clown ": 5.0, " scum ": 4.0}, 1.0, -2.0)
    began = time.perf_counter()
    assert lexicon.density("class clown and scum line, " * 60_000) == 0
    assert time.perf_counter() - began < 5


def test_signs_that_stand_for_several_letters():
    lexicon = toxicity.Lexicon({" clown ": 5.0, " loser ": 5.0, " worthless ": 5.0, " garbage ": 5.0, " lazy ": 5.0, " idiot ": 5.0}, 1.0, -2.0)
    for text in ("c1own", "1oser", "wor7h1ess", "6arba9e", "la2y", "!d!ot", "id!ot", "c!own", "you idiot!moron"):
        assert lexicon.density(text) > 4, text
    assert lexicon.density("fine! really fine") == 0


def test_awkward_rows_and_no_labels(spark, awkward, nothing):
    none = toxicity.fit(awkward, spark.createDataFrame([], LABELS))
    rows = toxicity.scored(awkward, none).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (999, 1, 1)], LABELS)
    assert toxicity.scored(awkward, toxicity.fit(awkward, labels)).count() == awkward.count()
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert toxicity.passed(awkward, none).columns == awkward.columns


def test_query_schema(spark, sf):
    assert op3_toxicity(spark, sf).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_wrong_labels_do_not_flatten_the_curve():
    points = [(0.0, 0)] * 900 + [(1.0, 0)] * 40 + [(0.0, 1)] * 5 + [(5.0, 1)] * 55
    share = {0: 0.94, 1: 0.06}
    clean = toxicity.curve(points[:940] + points[945:], share)[:2]
    assert toxicity.curve(points, share)[:2] == pytest.approx(clean, rel=0.05)
    slope, offset = clean
    lexicon = toxicity.Lexicon({" idiot ": 5.0}, slope, offset, (), 5.0)
    assert lexicon.score("idiot idiot idiot") == lexicon.score("idiot idiot") > 0.9

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import fim


def plain(doc_id, text):
    """(n, form, prefix, middle, output) written down from the rules, by slices."""
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def test_awkward_rows(awkward):
    out = fim.restored(fim.transformed(awkward))
    n, form, prefix, middle, output, back = out.columns[-6:]
    assert n == "_n" and out.columns[: len(awkward.columns)] == awkward.columns
    rows = out.collect()
    want = sorted((plain(r["doc_id"], r["text"]) for r in awkward.collect()), key=repr)
    assert sorted(((r[n], r[form], r[prefix], r[middle], r[output]) for r in rows), key=repr) == want
    assert all(r[back] == (r["text"] or "") for r in rows)


def test_all_forms_over_many_ids(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é<P"), F.repeat(F.lit("a中🙂< "), (F.col("id") % 23).cast("int")), F.when(F.col("id") % 50 == 0, "x<M>y").otherwise("S>")).alias("text"))
    rows = fim.restored(fim.transformed(df)).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) and r["restored"] == r["text"] for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM ab\0é🙂", max_size=40), st.sampled_from(["psm", "spm"]), st.integers(0, 40), st.integers(0, 40))
def test_rotations_undo_each_other(text, form, a, b):
    recipe = fim.Recipe()
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    made = recipe.arrange(text, form, a, b)
    x, y, z = text[:a], text[a:b], text[b:]
    assert made.decode() == (f"<P>{x}<S>{z}<M>{y}" if form == "psm" else f"<S>{z}<P>{x}<M>{y}")
    assert recipe.restore(made, form).decode() == text


@given(st.binary(max_size=30), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
def test_three_reversals(data, i, j, k):
    lo, mid, hi = sorted(min(x, len(data)) for x in (i, j, k))
    buffer = bytearray(data)
    fim.exchange(buffer, lo, mid, hi)
    assert bytes(buffer) == data[:lo] + data[mid:hi] + data[lo:mid] + data[hi:]


def test_other_sentinels():
    recipe = fim.Recipe("⟦pre⟧", "⟦suf⟧", "⟦mid⟧")
    made = recipe.arrange("ab⟦cd", "spm", 1, 3)
    assert made.decode() == "⟦suf⟧cd⟦pre⟧a⟦mid⟧b⟦" and recipe.restore(made, "spm").decode() == "ab⟦cd"
    for marks in (("<P>", "<P>", "<M>"), ("<P", "<P>", "<M>"), ("<<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Recipe(*marks)


def test_an_output_that_was_changed_is_an_error():
    with pytest.raises(ValueError):
        fim.Recipe().restore(b"<S>a<P>b<M>c", "psm")


def test_empty_table(nothing):
    assert fim.restored(fim.transformed(nothing)).count() == 0


def test_no_shuffle(awkward):
    assert "Exchange" not in fim.restored(fim.transformed(awkward))._jdf.queryExecution().executedPlan().toString()

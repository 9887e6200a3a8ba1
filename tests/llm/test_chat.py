from pyspark.sql import functions as F

from skein.llm import chat, common

TURNS = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def plain(rows):
    """Every pair by comparing turn by turn."""
    convs = {}
    for c, k, r, t in rows:
        convs.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, turns in convs.items():
        others = sorted(x for x, y in convs.items() if x != c and x is not None and y[0] == turns[0])
        if not others:
            n, rejected, other = len(turns) - 1, None, []
        else:
            other = convs[rejected := others[0]]
            n = next((k for k, (a, b) in enumerate(zip(turns, other)) if a != b), min(len(turns), len(other)))
        out.append((c, rejected, n, render(turns[:n]), render(turns[n:]), render(other[n:])))
    return sorted(out, key=repr)


def got(df):
    rows = chat.formatted(chat.paired(chat.conversations(df))).collect()
    for r in rows:
        for body, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",") if s]
            assert all(body[a:b].endswith(chat.TAIL) for a, b in spans)
            assert len(spans) == body.count("<|im_start|>assistant\n")
    return sorted(((r["chosen_id"], r["rejected_id"], r["prefix_turns"], r["prompt"], r["chosen"], r["rejected"]) for r in rows), key=repr)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "fine"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "less"), (2, 3, "assistant", "é🙂"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
    (4, 0, "user", "alone"), (4, 1, "assistant", "yes"), (5, 0, "user", None), (6, 0, None, ""), (6, 0, None, ""),
    (7, None, "user", "hi"), (7, 0, "user", "hi"), (8, 0, "user", "hi"), (8, 1, "assistant", "hello"), (9, 0, "user", "x" * 100_000),
]


def test_pairs_equal_plain_comparison(spark):
    df = spark.createDataFrame(ROWS, TURNS).withColumn("chosen", F.lit("clash"))
    assert got(df) == plain(ROWS)


def test_openings_that_only_join_alike(spark):
    rows = [(1, 0, "a\0b", "c"), (2, 0, "a", "b\0c"), (3, 0, "1:a", "b"), (4, 0, "1", ":ab"), (5, 0, "a", ":b"), (6, 0, "a:", "b")]
    assert got(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_long_conversations(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", f"{k % 7}" * (k % 3)) for c, n in ((1, 256), (2, 257), (3, 700), (4, 0 + 1)) for k in range(n)]
    df = spark.createDataFrame(rows, TURNS)
    assert got(df) == plain(rows)
    for r in df.transform(chat.conversations).select("turns", chat.mask(F.col("turns")).alias("m")).collect():
        at, want = 0, []
        for t in r["turns"]:
            begin = at + len(chat.HEAD) + len(t["role"]) + len(chat.MIDDLE)
            at = begin + len(t["text"]) + len(chat.TAIL)
            want += [f"{begin}:{at}"] if t["role"] == "assistant" else []
        assert r["m"] == ",".join(want)


def test_awkward_turns(spark, awkward):
    """Clashing columns, ties, repeated rows, nulls in every column."""
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "hi"), (2, None, None, None), (2, 0, "user", "hi"), (3, 0, "user", "hi")]
    df = spark.createDataFrame(rows, TURNS)
    extra = df.withColumns({c: F.lit("clash") for c in awkward.columns if c not in df.columns})
    assert got(extra) == got(df)


def test_a_very_common_opening_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(c, k, "assistant" if k % 2 else "user", f"t{c % 5 if k else 0}") for c in range(300) for k in range(4)]
    rows += [(1000 + c, 0, "user", f"own {c}") for c in range(30)]
    assert got(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_a_very_common_opening(spark):
    rows = [(c, k, "assistant" if k % 2 else "user", f"t{c % 5 if k else 0}") for c in range(300) for k in range(4)]
    assert got(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_no_python_and_no_rows(spark):
    out = chat.formatted(chat.paired(chat.conversations(spark.createDataFrame([], TURNS))))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

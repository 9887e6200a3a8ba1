import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe

with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
    RANKS = f.read()
SMALL = bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf=5, window=1)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé ßs'rel1290.,!\n\t\r 　中🙂-_́A")), max_size=60))
def test_tree_equals_whole_encoding(text):
    assert SMALL.encode(text) == SMALL.plain.encode_ordinary(text)
    assert SMALL.decode(SMALL.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "0123456789" * 5000, "中" * 30_000, "it's " * 10_000, "<|endoftext|>" * 100])
def test_long_runs_without_seams(text):
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert own.encode(text) == own.plain.encode_ordinary(text)


SCRIPTS = {
    "Chinese": "中文文本没有空格，只有标点。第2句也是如此！",
    "Cyrillic": "Это длинный текст, в котором нет латинских букв: «да» и «нет» — 7 раз. ",
    "Thai": "ข้อความภาษาไทยไม่มีช่องว่างระหว่างคำ ๑๒๓ ",
    "Arabic": "هذا نص طويل، بلا حروف لاتينية؛ ١٢٣. ",
    "Hindi": "यह एक लंबा पाठ है। इसमें कोई लैटिन अक्षर नहीं ",
    "Korean": "띄어쓰기가 있는 한국어 문장입니다. ",
    "emoji": "🙂🙃 𝒳𝒴 𠀀𠀁 ",
    "marks": "e\u0301\u0323 'ſ ’s 's'll ʼn ",
}


@pytest.mark.parametrize("name", SCRIPTS)
@pytest.mark.parametrize("leaf", [5, 40, bpe.LEAF])
def test_scripts_without_ascii(name, leaf):
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf=leaf, window=4)
    rng = random.Random(leaf)
    text = SCRIPTS[name] * 60
    for _ in range(20):
        a, b = sorted(rng.sample(range(len(text)), 2))
        assert own.encode(text[a:b]) == own.plain.encode_ordinary(text[a:b])


def test_the_tree_encodes_leaves_and_windows_alone():
    """No call of the library gets more than a leaf or a few windows of a text that has breaks."""
    for text in ("some words of a text, " * 500, SCRIPTS["Chinese"] * 500, SCRIPTS["Cyrillic"] * 200):
        own, sizes = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
        plain = own.plain

        class Counting:
            def encode_ordinary(self, part):
                sizes.append(len(part))
                return plain.encode_ordinary(part)

        own.plain = Counting()
        assert own.encode(text) == plain.encode_ordinary(text)
        assert max(sizes) <= bpe.LEAF and sum(sizes) < 2 * len(text)


def test_breaks_split_in_every_context():
    rng = random.Random(9)
    signs = "aZéж中ก9²१'’-_.,!(«。 \t\n\r\u3000\u00a0\u0301\u200d🙂ſ"
    plain = SMALL.plain
    for _ in range(20_000):
        text = "".join(rng.choices(signs, k=rng.randint(2, 9)))
        for m in SMALL.breaks.finditer(text):
            if 0 < m.start() < len(text):
                assert plain.encode_ordinary(text) == plain.encode_ordinary(text[: m.start()]) + plain.encode_ordinary(text[m.start() :]), (text, m.start())


def test_another_pattern_has_no_known_breaks():
    own = bpe.Codec(RANKS, r"[^\s]+|\s+", leaf=4)
    text = "words of all-kinds 12, and  blanks\n" * 5
    assert own.encode(text) == own.plain.encode_ordinary(text)


def test_random_mixtures():
    rng = random.Random(3)
    parts = ["'ll", "'s", "re", " ", "  ", "\n\n", "x9", "9x", "!?", "é", "ñandú", "word", " word", " "]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert SMALL.encode(text) == SMALL.plain.encode_ordinary(text)


def test_query_columns(spark, awkward):
    rows = bpe.digests(awkward).collect()
    plain = SMALL.plain
    want = sorted((r["doc_id"] or 0, len(plain.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, plain.encode_ordinary(r["text"] or ""))).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in awkward.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want


def test_packed_ids_round_trip(spark, awkward):
    out = bpe.encoded(awkward)
    assert out.columns == [*awkward.columns, "_n_tokens", "_token_ids"]
    back = bpe.decoded(out, ids="_token_ids")
    assert back.columns == [*out.columns, "_decoded"]
    for r in back.collect():
        assert bytes(r["_decoded"]) == (r["text"] or "").encode() and r["decoded"] == r["n_tokens"] == "clash"
    plain = bpe.decoded(bpe.encoded(awkward.select("doc_id", "text")))
    assert plain.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in plain.collect())


def test_empty_table(nothing):
    assert bpe.digests(nothing).count() == 0

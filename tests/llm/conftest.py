import pytest

#: Names that the operators use within.
CLASHES = (
    "size", "kept", "key", "node", "score", "target", "bucket", "row", "best", "order", "n", "shared", "cell", "owner", "hot", "part", "parts", "word", "bits",
    "__id", "__t1", "__t2", "t1", "t2", "id", "label", "component_id", "n_tokens", "token_ids", "decoded", "decoded_sha256", "__ids", "__row", "__copy", "__rate",
    "__source", "copies", "source_size", "taken", "keep_id", "group_size", "text_sha256", "media_id", "chunk", "bytes", "names", "predicted", "held_out", "y", "base",
    "tokens", "spans", "a", "b", "html", "url", "turn", "role",
)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and a column with a clashing name."""
    long = " ".join(f"word{i % 977} token{i % 89}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 30),
        (2, "alpha beta gamma delta epsilon", "en", "b", 30),
        (2, "alpha beta gamma delta epsilon", "en", "b", 30),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (None, "no id here at all", "en", None, 17),
        (5, long, "en", "a", len(long)),
        (6, long + " tail", "en", "a", len(long) + 5),
        (7, " \t\n ", "en", "c", 4),
        (8, "é中🙂 \u0000 x", "fr", "c", 7),
        (8, "another text of a repeated id", "fr", "c", 7),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

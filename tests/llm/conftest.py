import pytest

LONG = "lorem ipsum dolor sit amet " * 6000

#: Nulls in every column, empty and blank texts, very long ones, ties and repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "ünïcödé wörds änd 漢字 \U0001f600 stay whole", "fr", "c"),
    (8, "one two", "en", "c"),
    (None, "a row without an id has words too, ten of them at least.", "en", None),
    (10, "repeated row", "en", "a"),
    (10, "repeated row", "en", "a"),
    (10, "another text with the same id", "en", "a"),
    (13, "null \x00 and control \x1f bytes <|endoftext|> café J̌", None, "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names clash with ones that operators make."""
    extra = ["id", "digest", "key", "n", "size", "shard", "row", "cell", "kept", "word", "h", "rank", "score", "prefix", "depth"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(extra)) for r in ROWS], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}

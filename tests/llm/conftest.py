import pytest

from pagelode.llm import common  # noqa: F401  the folder's tests go with the subpackage

LONG = "the quick brown fox jumps over a lazy dog and runs to the river " * 12_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    text = "The cat of the house was in the garden and the dog of the street was at the door. It is a fine day for a walk."
    data = [
        (1, text, "en", "b"), (2, text, "en", "b"), (2, text, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "a"), (6, LONG, "en", "c"), (7, "word", None, "a"),
        (8, text + " Today.", "en", None), (None, text, "en", "b"), (9, "\n".join(["same line here"] * 30), "fr", "a"), (10, "été \U0001f600 über \x00 x\x1fy 日本 ' 's <|endoftext|>", "fr", "a"), (11, "12 34", "en", "a"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "size", "source_size", "fp", "h", "length", "n", "target", "score", "_w", "_t", "_m", "first", "part", "piece", "shard", "_n"):
        df = df.selectExpr("*", f"cast(null as string) as {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

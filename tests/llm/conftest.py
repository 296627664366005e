"""Documents with everything that may go wrong in them."""

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, size string, hash string, key string"
#: No digits or punctuation, so that any operator's words are these.
LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(15_000))


def odd_rows():
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "b"),
        (4, "one", "en", None),
        (5, "one two\tthree", "fr", "b"),
        (6, "one  two three", "fr", "b"),
        (7, LONG, "en", "a"),
        (8, LONG + " tail", "en", "c"),
        (9, "né à l'été, <|endoftext|> ### Apache License 漢字 🙂", "fr", "c"),
        (9, "né à l'été, <|endoftext|> ### Apache License 漢字 🙂", "fr", "c"),
        (10, "one two three", "fr", "b"),
        (11, "One TWO three", "fr", None),
        (-5, "the MIT license and the mit license", "en", "a"),
        (12, "1234 5678", "en", "a"),
    ]
    return [(*t, len(t[1] or ""), i % 2 == 0, 99, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def nobody(spark):
    """A row without doc_id."""
    return spark.createDataFrame([(None, "one two three", "en", "a", 13, True, 1, "x", "y", "z")], ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}

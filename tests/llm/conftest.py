import pytest

from made_up import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n string, salt string, digest string, own string, word string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and blank texts, ties, repeated rows, a very long text, names that operators use themselves."""
    long = " ".join(words(1, 20_000))
    body = " ".join(words(2, 200))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, body), (5, body), (5, body), (6, body.replace(" ", "  ")), (None, body), (7, long),
            (8, long + " tail"), (9, "one two three"), (10, "one two  three"), (None, None), (11, "!!! ???"), (12, "été ça där"), (13, "<|endoftext|> x")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, 1, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

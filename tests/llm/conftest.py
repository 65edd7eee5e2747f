import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t\n ", None, "s", 5),
    (None, "a text without an id that is long enough to count", "en", None, 1),
    (None, "a text without an id that is long enough to count", "en", None, 1),
    (4, "one two three four five six seven", "en", "s", 1),
    (4, "one two three four five six seven", "en", "s", 1),
    (5, "One TWO three four\nfive six seven", "en", "s", 1),
    (6, "long " * 40_000, "en", "s", 200_000),
    (7, "ÀÉ ñandú 东京 🙂 <|endoftext|>   x", "fr", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "score", "rank", "h1", "h2", "c", "g", "pos", "line", "drop", "n_lines", "hash", "spans", "words", "length", "chunk", "_hash", "_doc", "_text", "label", "value", "kind")
    return lambda df: df.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, key string, n long, token string, id string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeated rows, other scripts."""
    rng = random.Random(3)
    long = words(rng, 30000)
    return [None, "", " \t\n", "a", "A b", "one two three four", "é ü ñ — „x“ 中文 🎈 end", "x" * 50000, long, long, words(rng, 60), "line\nline\nline\n" + words(rng, 55), "the the the the the", "a b c a b c a b c"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts, with nulls in any column and columns whose names clash with those within the operators."""
    rows = [(k, t, None if k % 2 else "en", "x", k if k % 3 else None, None, "y") for k, t in enumerate(odd_texts)]
    return spark.createDataFrame([*rows, rows[10], (None, "text without an id", None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __m string, m string, id string, comp long, w double"


def rows_of(texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s0"] * len(texts) if sources is None else sources
    return [(i, t, "en", s, len(t) if t else 0, "x", "y", "z", 1, 2.0) for i, t, s in zip(ids, texts, sources, strict=True)]


@pytest.fixture(scope="session")
def make(spark):
    """documents with columns whose names clash with the operators' own."""
    return lambda texts, ids=None, sources=None: spark.createDataFrame(rows_of(texts, ids, sources), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words, the same each time."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(900)]

    def words(n, seed):
        q = random.Random(seed)
        return [q.choice(vocab) for _ in range(n)]

    return words

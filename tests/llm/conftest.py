import random

import pytest

#: Columns that clash with names the operators use inside.
CLASHES = ["__row", "__n", "__id", "__key", "__text_key", "__language", "row", "n", "id", "no_id", "found", "digest"]
EXTRA = "key string, kept boolean, node string, score double, lang string, source string, copies int, row int, text_key string"
SCHEMA = "doc_id long, text string, " + EXTRA


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Frames from (doc_id, text) or (doc_id, text, lang, source) rows."""
        full = [(r[0], r[1], "k", True, "n", 0.5, *(r[2:] or ("en", "s")), 3, 4, "t") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 300)
    long_ = words(rng, 60_000, 5000)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, None), (None, base), (None, "lone words here"), (6, long_),
        (7, long_ + " end"), (8, "   \n\t "), (9, "short"), (10, "short"), (11, base + " and some more words"), (3, base),
        (12, "a" * 5000), (13, "ü€😀 " * 80), (14, words(rng, 300)),
    ]

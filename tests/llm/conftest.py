import random

import pytest

DOCS = "doc_id long, text string, id string, n long, label string"


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text), with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)

    return make


@pytest.fixture
def prose():
    """A function that gives n random words for a seed."""

    def words(seed, n, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return words

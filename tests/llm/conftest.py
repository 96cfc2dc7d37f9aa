import random

import pytest


@pytest.fixture(scope="session")
def words():
    """Deterministic invented words."""
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture
def frame(spark):
    """documents-like rows with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(d, t, "en", "s", 7, "x", 1) for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, label string, recipe int")

    return make

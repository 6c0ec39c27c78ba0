import random

import pytest

SYLLABLES = "th he in er an re nd on en at ou ed ha to or it is hi es ng".split()


@pytest.fixture()
def words():
    """A generator of invented words."""
    rng = random.Random(7)

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return ["".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(n)]

    return make


@pytest.fixture()
def documents(spark):
    """A table of documents from (doc_id, text) pairs, with the other columns and one of a clashing name."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp string")

    return make

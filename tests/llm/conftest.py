import random

import pytest

CLASHING = "n_words STRING, ids STRING, score STRING, kept STRING, spans STRING, cls STRING, id STRING, token STRING, path STRING, size STRING"


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""

    def build(rows, key="doc_id", text="text"):
        return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{key} BIGINT, {text} STRING, {CLASHING}")

    return build


@pytest.fixture(scope="session")
def prose():
    """Random prose: words of syllables, deterministic by seed."""

    def make(seed, words=120):
        rng = random.Random(seed)
        syllables = ["ta", "re", "mo", "lin", "ver", "sa", "ké", "dor", "un", "pel", "ri", "os"]
        out = []
        for i in range(words):
            w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
            out.append((w.capitalize() if i % 13 == 0 else w) + ("." if i % 13 == 12 else ""))
        return " ".join(out)

    return make


@pytest.fixture
def odd_rows(prose):
    """Null and empty texts, blanks only, a null id, a very long text, repeated rows."""
    long = " ".join(prose(s, 2000) for s in range(20))
    return [(1, None), (2, ""), (3, " \n\t "), (None, prose(1)), (4, long), (5, prose(2)), (5, prose(2)), (6, prose(2)), (None, None)]

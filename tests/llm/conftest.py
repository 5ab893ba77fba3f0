import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, row string, key string, low string"


@pytest.fixture(scope="session")
def table(spark):
    """Builds documents with columns whose names clash with those that operators use inside."""

    def build(rows):
        full = [(i, t, lang, s, len(t or ""), -1, "w", "r", "k", "l") for i, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and long texts, ties, repeated rows and copies, in a few sources."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "CHANGED"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, "en", "b"), (5, "", "de", None), (6, " \t\n ", None, "b"),
        (7, "one two", "en", "c"), (8, "one TWO", "en", "c"), (9, "One two three", "fr", "c"), (10, text(9000), "fr", "a"), (None, text(30), "en", "a"),
        (11, "é" * 50 + " ü 漢字 🎉", "de", "a"), (12, base + " tail", "en", None), (7, "one two", "en", "c"),
    ]
    return rows + [(100 + i, text(rng.randint(1, 80)), "en", rng.choice("abc")) for i in range(30)]

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, part int, fp long, n_tokens string"


def row(doc_id, text, source="s"):
    """A document with columns whose names the operators use inside."""
    return (doc_id, text, "en", source, len(text or ""), "k", 7, 1, "x")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ö"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long one, ties, repeated rows and ids, unusual characters."""
    base = prose(1, 300)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, base), (5, base), (6, base + " tail"), (7, prose(2, 6000)), (8, "a\nb\na\n\nA \n "), (8, "a\nb\na\n\nA \n ")]
    rows += [(None, base), (None, "nothing like it"), (9, "x" * 3000), (10, "日本語 テキスト ΑΣ İx   é́"), (11, "one two"), (12, "one two"), (-5, "negative id \U0001f600")]
    return rows

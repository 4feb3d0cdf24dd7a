from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko".split() for b in "ra re ri ro ru na ne ni no nu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, and
    columns whose names clash with those of the operators."""
    rng = random.Random(1)
    same = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 300_000), (5, prose(rng, 40_000)), (6, same), (6, same), (7, same), (None, prose(rng, 50)), (None, None), (8, "é ñ 漢字 <|endoftext|> " * 20)]
    return spark.createDataFrame([(i, t, "a", 1.0, 2, "n", "b") for i, t in rows], "doc_id long, text string, lang string, score double, n_words int, node string, blocks string")

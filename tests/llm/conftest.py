"""Small tables with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

from __future__ import annotations

import random

import pytest

WORDS = "the of river stone cloud and with under bridge lamp orange seven kite maple quiet north salt wind road glass".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", None), (6, " \t\n", "fr"), (7, "one two", "fr"), (7, "one two", "fr"), (8, "ONE  two", "de"),
        (9, "été à la plage ▁ 東京\x00\x1c​😀 " * 3, "fr"), (None, base, "en"), (None, None, None), (10, sentence(rng, 60_000), "en"), (11, "123 456 !!!", None), (12, "x" * 200_000, "de"),
    ]
    return rows + [(i, sentence(rng, rng.randint(1, 80)), rng.choice(["en", "fr"])) for i in range(100, 160)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, lang, "s", 0.5, "id", t, 1) for i, t, lang in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, id string, word string, row int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

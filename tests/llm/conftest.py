"""Small documents with hard cases."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component string, keys string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """A text of n words that depends on the seed alone."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % 24] + WORDS[(x >> 13) % 24][:3] + str((x >> 18) % 50))
    return " ".join(out)


def edited(text: str, *places: int) -> str:
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


HARD = [
    (None, prose(1, 80)), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "one two"), (7, prose(2, 120)), (8, prose(2, 120)), (9, edited(prose(2, 120), 50)),
    (10, edited(prose(2, 120), 10, 60, 90)), (11, prose(3, 70) + " " + prose(4, 60)), (12, prose(5, 70) + " " + prose(4, 60)), (13, "é" * 150 + prose(6, 30)), (14, "ab " * 400), (15, prose(7, 5000)),
    (16, edited(prose(7, 5000), 100, 2000)), (17, prose(8, 40).upper()), (18, prose(8, 40)), (18, prose(8, 40)), (20, "x" * 99), (21, "x" * 99), (22, "y" * 100), (23, "y" * 100),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty, short and long texts, ties, a repeated row, extra columns with names that operators use."""
    return spark.createDataFrame([(d, t, "en", f"src{(d or 0) % 4}", len(t or ""), 1, "x", "y") for d, t in HARD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)

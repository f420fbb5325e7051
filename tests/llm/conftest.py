import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Invented text of n words with sentences and lines."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + r.choice(WORDS) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.03 else ""))
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, key string, unit int, words string, first string, h1 int, start string, label string, score string, component string, features string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns with the operators' own names."""
    extra = (7, "n", "k", 3, "w", "f", 1, "s", "l", "sc", "c", "fe")
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 200), "en", "a", 10, *extra),
        (2, None, "en", "a", None, *extra),
        (3, "", None, "a", 0, *extra),
        (4, "  \n\t ", "en", None, 1, *extra),
        (5, long, "en", "a", len(long), *extra),
        (None, prose(3, 100), "en", "a", 5, *extra),
        (None, None, None, None, None, *([None] * len(extra))),
        (6, prose(4, 80), "de", "b", 5, *extra),
        (6, prose(4, 80), "de", "b", 5, *extra),
        (7, "x" * 50_000, "en", "a", 1, *extra),
        (8, "#" * 20_000 + " 1" * 5_000 + "@" * 3_000, "en", "a", 1, *extra),
        (9, "<|endoftext|> é ß 漢字 \U0001f600 " * 30, "zz", "c", 1, *extra),
        (10, prose(2, 200), "en", "a", 10, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)

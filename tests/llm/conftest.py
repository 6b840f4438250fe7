import random

import pytest

WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()

#: Names that operators use inside, or once used, and one with a dot.
CLASHES = "__text __score __k __part __id __salt a.b c0 c1 own row at first kept id no_id node spans part path html skeleton".split()


def prose(n, seed=0):
    """n words of invented prose that differ by seed."""
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORD)}{rng.randrange(97)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, prose(60), "en", "s", 1, 0.5, 7, "x", "y"),
        (1, prose(60), "en", "s", 1, 0.5, 7, "x", "y"),
        (2, prose(60), None, None, None, None, None, None, None),
        (3, None, "en", "s", 1, 0.1, 1, "x", "y"),
        (4, "", "en", "s", 1, 0.1, 1, "x", "y"),
        (None, prose(60, 5), "en", "s", 1, 0.1, 1, "x", "y"),
        (None, None, None, None, None, None, None, None, None),
        (7, prose(30_000, 3), "en", "s", 1, 0.1, 1, "x", "y"),
        (8, "a\tb  c\n\nd", "en", "s", 1, 0.1, 1, "x", "y"),
        (9, "a b c d", "en", "s", 1, 0.1, 1, "x", "y"),
        (10, "x" * 5000, "en", "s", 1, 0.1, 1, "x", "y"),
        (11, "É à 日本 🙂 <|endoftext|> don't", "en", "s", 1, 0.1, 1, "x", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id int, digest string, host string").selectExpr("*", *(f"{i} AS `{n}`" for i, n in enumerate(CLASHES)))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

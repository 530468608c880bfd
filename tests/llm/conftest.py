import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "va") for b in ("n", "r", "st", "l", "m", "nd", "x", "p")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, lane int, fp string, n_words long, k int, n long"


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made_docs(seed=1, n=40):
    """Texts with near and exact copies, shared passages, nulls, blanks, repeated rows and one very long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(5, 200)) for _ in range(n)]
    shared = words(rng, 60)
    texts = base[:]
    texts += [base[3], base[3], base[4] + " extra", base[5].upper()]
    texts += [words(rng, 20) + " " + shared + " " + words(rng, 20) for _ in range(4)]
    texts += [None, "", "  \t\n ", "one", "one two", "a\x0bb\x0cc\rd", shared + "\n" + shared, words(rng, 30_000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (rows[-1][0] + 1, base[3]), (None, base[7]), (None, None)]
    return [(i, t, "en", f"src{(i or 0) % 3}" if i != 5 else None, None, 7, 1, 2, "x", 3, 4, 5) for i, t in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

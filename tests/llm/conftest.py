import random

import pytest

WORDS = "the of and to in that with for stone river garden light music paper winter table bridge window forest engine silver market".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".")) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, key string, class long, blob binary"


def docs_of(spark, texts):
    """A documents table with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, 0.5, 1, "k", 7, b"x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, a null id, repeated rows, ties, near copies, a long text."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:40] + ["changed"] + words[41:])
    long_text = prose(rng, 20_000)
    texts = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, "  \n"), (6, "one"), (7, "one"), (8, long_text), (8, long_text), (9, long_text[1000:30_000]), (None, base), (10, "aa " * 300), (11, "é" * 150)]
    return docs_of(spark, texts + [(20 + i, prose(rng, rng.randint(1, 60))) for i in range(40)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

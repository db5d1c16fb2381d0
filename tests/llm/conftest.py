import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text) pairs."""

    def of(rows, extra=""):
        full = [(i, t, "en", "src0", None if t is None else len(t), *(["x"] if extra else [])) for i, t in rows]
        return spark.createDataFrame(full, DOCS + (f", {extra} string" if extra else "")).repartition(3)

    return of


@pytest.fixture(scope="session")
def prose():
    """Sentences of drawn words."""

    def of(n, seed):
        rng = random.Random(seed)
        words = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(400)]
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    return of

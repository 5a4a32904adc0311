import itertools

import pytest

BENIGN = "extra column whose name clashes with nothing an operator adds"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) pairs, with the other columns of documents and one more."""

    def make(pairs, **more):
        rows = [(i, t, more.get("lang", "en"), "src0", len(t or ""), BENIGN) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


WORDS = [a + b + c for a, b, c in itertools.product(["ka", "lo", "mi", "ru", "se"], ["ta", "ne", "po"], ["n", "s", "", "ri"])]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words."""
    import random

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make

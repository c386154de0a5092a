import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefghij"):
    return [("".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))) for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def docs_of(spark):
    """A documents table from (id, text) pairs, with sources dealt in turn."""

    def make(rows, partitions=3):
        full = [(i, t, "en", f"s{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return make


#: Rows that every operator must stand: null and empty texts, a null id, blank text.
ODD = [(901, None), (902, ""), (903, " \n\t "), (None, "some text without an id to go by")]


@pytest.fixture
def odd():
    return list(ODD)

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sample_rows() -> list[tuple]:
    """Plain, long, empty, null, repeated and near-copied texts; null ids, languages and sources."""
    rng = random.Random(7)
    rows = [(i, words(rng, rng.choice((1, 2, 5, 40, 200, 700))), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, "  \n\t ", "fr", "s1", 5)]
    rows += [(103, words(rng, 30_000), "en", "s2", 0), (104, "Grüße, naïve café 日本語 \U0001f600 x" * 3, "de", None, 0)]
    rows += [(5, rows[5][1], "en", "s2", 0)] * 2 + [(None, "one of none", "en", "s1", 0), (None, None, None, None, None)]
    rows += [(200 + i, rows[3][1], "en", "s0", 0) for i in range(40)]
    rows += [(300 + i, " ".join(w for j, w in enumerate(rows[103 - 40][1].split()[:400]) if j != i), "en", "s0", 0) for i in range(30)]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

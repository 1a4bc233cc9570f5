from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import resemblance
from tests.llm.conftest import words


def shingles(text):
    w = [x.lower() for x in (text or "").split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def classes(texts):
    """Least index reachable over all pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_copies():
    rng = random.Random(11)

    def edit(text, times):
        w = text.split()
        for _ in range(times):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return " ".join(w)

    texts = [None, "", " \n", "One two", "one TWO", "one two three"]
    for _ in range(25):  # few copies of texts, near the border and beyond it
        base = words(rng, rng.choice((6, 12, 30, 80, 300)), 10**6)
        texts += [base, *(edit(base, max(1, round(len(base.split()) * x))) for x in (0.0, 0.01, 0.02, 0.03, 0.05))]
    shared = words(rng, 60, 10**6)
    texts += [f"{shared} {words(rng, rng.choice((3, 6, 9, 15, 60)), 10**6)}" for _ in range(60)]  # a common passage
    base = words(rng, 100, 10**6)
    texts += [base, *(edit(base, rng.choice((1, 1, 2, 3, 5))) for _ in range(60))]  # a large group
    return texts


@pytest.mark.parametrize("dense", [4, 10_000])
def test_groups_are_those_of_all_pairs(spark, dense):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = dict(resemblance.near_duplicates(df, dense=dense).select("doc_id", "component_id").collect())
    want = classes(texts)
    assert len(set(want)) < len(want) - 60
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("salt", [0, 1])
def test_stars_gather_a_group_around_its_most_linked_set(spark, salt):
    sets = [(key, fp, 100, fp, 5 * (fp == 17)) for key in (1, 2) for fp in range(40)]
    found = resemblance._stars(spark.createDataFrame(sets, "key long, fp long, n int, root long, links long"), salt).collect()
    assert sorted(tuple(r) for r in found) == [(fp, 17) for fp in range(40) if fp != 17]


def test_stage_removes_near_copies_that_simhash_does_not_see(spark):
    df = spark.createDataFrame(list(enumerate(near_copies())), "doc_id long, text string").repartition(5)
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == set(classes(near_copies()))


def test_repeated_ids_and_empty_table(spark, docs, rows, empty):
    kept = resemblance.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({classes([r[1] for r in rows])[i] for i in range(len(rows))})
    assert resemblance.deduplicate(empty).collect() == []
    assert not kept.groupBy(F.col("doc_id")).count().where("count > 1").count()

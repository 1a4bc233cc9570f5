from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality as Q


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4, 2])
    slots, grades = rng.integers(0, 8, sizes.sum()), np.array([0, 2, 1, 2])
    w, t = rng.normal(size=8), np.array([-0.3, 0.8])
    _, gw, gt = Q._loss_gradient(slots, sizes, grades, w, t)
    for v, g, i in [(w, gw, i) for i in range(8)] + [(t, gt, i) for i in range(2)]:
        d = np.zeros_like(v)
        d[i] = 1e-6
        up = Q._loss_gradient(slots, sizes, grades, w + d if v is w else w, t + d if v is t else t)[0]
        down = Q._loss_gradient(slots, sizes, grades, w - d if v is w else w, t - d if v is t else t)[0]
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def corpus(n=800):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        low, toxic = i % 6 in (0, 4), i % 6 in (1, 4)
        if low:
            words = [w + "###" for w in words]
        if toxic:
            words[3] = "nastyword"
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_classifier_on_held_out_rows(spark):
    docs, labels = corpus()
    docs += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \n", "en", "s", 0), (3, docs[3][1], "en", "s", 0), (None, docs[2][1], "en", "s", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("quality", F.lit(1)).withColumn("keep", F.lit(1))
    fit = [x for x in labels if x[0] % 5] + [(None, 1, 0), (7, None, None), (5000, 1, 0), labels[2], labels[2]]
    out = Q.classify(d, spark.createDataFrame(fit, "doc_id long, quality int, toxic int"), n_features=1 << 14)
    assert out.columns == [*d.columns, "quality_", "keep_"] and out.count() == len(docs)
    rows = {r.doc_id: r for r in out.collect()}
    held = [i for i, *_ in labels if i % 5 == 0]
    assert sum(rows[i]["keep_"] == (i % 6 in (2, 3, 5)) for i in held) / len(held) > 0.95
    grade = lambda k: np.mean([rows[i]["quality_"]["expected_grade"] for i in held if i % 6 == k])
    assert grade(4) < min(grade(0), grade(1)) and max(grade(0), grade(1)) < grade(2)
    assert not any(rows[i]["keep_"] for i in (9000, 9001, 9002)) and rows[None]["quality_"] == rows[2]["quality_"]


def test_bounded_sample_and_ordered_thresholds(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    ratings = Q.grades_of_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    f = Q.labelled_features(d, ratings, "doc_id", "text", 100, 1 << 12)
    assert 50 < f.count() < 150
    model = Q.fit(f, 3, 1 << 12, steps=5)
    assert model.thresholds[0] < model.thresholds[1] and model.n_grades == 3


def test_no_labels_and_no_documents(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(empty, none, n_features=64).collect() == []
    tails = {round(r["quality"]["tail"], 6) for r in Q.classify(docs, none, n_features=64).collect() if r.text and r.text.strip()}
    assert tails == {0.333333}


def test_query_against_a_plain_fit(spark):
    """The same penalised likelihood, summed row by row in one process and brought down by small steps."""
    from fieldloom.llm import quality as Q
    from fieldloom.llm.queries import op1_quality

    root = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    grades = {}
    for r in Q.grades_of_labels(spark.read.parquet(f"{root}/labels.parquet")).collect():
        if r.grade is not None and r.doc_id is not None:
            grades[r.doc_id] = min(r.grade, grades.get(r.doc_id, 9))
    hasher = Q.Hasher(Q.N_FEATURES)
    slots = {i: hasher.slots(t) for i, t in docs.items()}
    used = sorted({int(s) for i in slots for s in slots[i]})
    at = {s: k for k, s in enumerate(used)}
    x = np.zeros((len(docs), len(used)))
    ids = sorted(docs)
    for row, i in enumerate(ids):
        if len(slots[i]):
            x[row, [at[int(s)] for s in slots[i]]] = len(slots[i]) ** -0.25
    rated = [row for row, i in enumerate(ids) if i in grades and len(slots[i])]
    y = np.array([grades[ids[row]] for row in rated])
    a = x[rated]

    def loss(w, t):
        edges = np.column_stack([np.zeros(len(y)), 1 / (1 + np.exp(-(t[None, :] - (a @ w)[:, None]))), np.ones(len(y))])
        p = np.maximum(edges[np.arange(len(y)), y + 1] - edges[np.arange(len(y)), y], 1e-12)
        slope = edges * (1 - edges)
        up, down = slope[np.arange(len(y)), y + 1] / p, slope[np.arange(len(y)), y] / p
        gw = a.T @ (up - down) / len(y) + 1e-4 * w
        gt = np.array([-(up[y == k]).sum() + down[y == k + 1].sum() for k in (0, 1)]) / len(y)
        return -np.log(p).mean() + 0.5e-4 * w @ w, gw, gt

    w, t, vw, vt = np.zeros(len(used)), np.array([-np.log(2), np.log(2)]), 0.0, 0.0
    for _ in range(4000):
        value, gw, gt = loss(w, t)
        vw, vt = 0.95 * vw + gw, 0.95 * vt + gt
        w, t = w - 0.3 * vw, np.sort(t - 0.3 * vt)
    chance = 1 / (1 + np.exp(-(t[None, :] - (x @ w)[:, None])))
    expected = 2 - chance.sum(axis=1)
    got = {r.doc_id: r for r in op1_quality(spark, root).collect()}
    some = [row for row, i in enumerate(ids) if len(slots[i])]
    apart = np.abs([got[ids[row]].expected_grade - expected[row] for row in some])
    assert apart.mean() < 0.05 and np.quantile(apart, 0.95) < 0.2
    assert all(got[i].expected_grade == got[i].tail == 0 for i in ids if not len(slots[i]))

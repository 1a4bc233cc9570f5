from __future__ import annotations

import numpy as np
import pytest

from fieldloom.operators import disagreement as D
from fieldloom.operators import evaluation as E
from fieldloom.operators import shift


def frame(spark, pairs):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "pixel_id long, gt_class int, pred_class int")


def test_absent_classes_are_undefined(spark):
    df = frame(spark, [(0, 0), (1, 1), (1, 2), (2, 1), (3, 0)])
    counts = E.class_counts(df, 5)
    ious = {r.class_id: r.iou for r in E.iou(counts).collect()}
    assert ious == {1: pytest.approx(1 / 3), 2: 0.0, 3: 0.0, 4: None}
    f1 = {r.class_id: r.f1 for r in E.f1(counts).collect()}
    assert f1[1] == pytest.approx(0.5) and f1[2] is None and f1[3] is None and f1[4] is None, "both 0, or precision undefined"
    one = E.overall(df, 5).first()
    assert one.miou == pytest.approx(1 / 9) and one.mean_f1 == pytest.approx(0.5) and one.overall_accuracy == pytest.approx(0.4)
    empty_row = {(r.gt_class, r.pred_class): r.share for r in E.confusion_matrix(df, 5).collect()}
    assert empty_row[4, 0] == 0.0 and len(empty_row) == 25


def test_iou_never_exceeds_f1(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(int(a), int(b)) for a, b in rng.integers(0, 6, (400, 2))])
    counts = E.class_counts(df, 6)
    for r in E.iou(counts).join(E.f1(counts), "class_id").collect():
        assert r.f1 is None or r.iou <= r.f1


def test_nothing_in_common(spark):
    assert E.binary_iou(frame(spark, [(0, 0)]), 3).first()[0] == 0.0
    assert E.overall(frame(spark, [(0, 0)]), 3).first().miou == 0.0


def test_support_of_100_pixels_and_constant_series(spark):
    pairs = [(1, 1)] * 100 + [(2, 2)] * 99 + [(3, 3)] * 120 + [(1, 3), (3, 1), (1, 2)]
    pred = frame(spark, pairs).selectExpr("*", "'p' AS patch_id")
    value = lambda i, d: {1: 0.1 + 0.5 * d, 2: 0.3, 3: 0.4}[pairs[i][0]] if i < 319 else 0.1 + 0.5 * d
    index = spark.createDataFrame([(i, f"d{d}", value(i, d)) for i in range(len(pairs)) for d in range(2)], "pixel_id long, date8 string, ndvi double")
    series = D.characteristic_series(index, pred)
    assert {r.class_id: r["var"] for r in series.collect()} == {1: pytest.approx(0.0625), 3: pytest.approx(0)}
    scores = D.disagreement_scores(index, pred, series)
    assert scores.count() == 0, "class 3 is constant and class 2 has 99 pixels"
    codes = {r.pixel_id: r.verdict for r in D.verdict_map(pred, scores).collect()}
    assert [codes[i] for i in (0, 319, 320, 321)] == [0, 3, 3, 3]


def test_prediction_wins_only_if_strictly_better(spark):
    pairs = [(1, 1)] * 100 + [(2, 2)] * 100 + [(1, 2), (2, 1), (1, 2)]
    ref = {1: (0.0, 1.0), 2: (1.0, 0.0)}
    px = [ref[g] for g, _ in pairs[:200]] + [(1.0, 0.0), (0.5, 0.5), (0.0, 1.0)]
    index = spark.createDataFrame([(i, f"d{d}", px[i][d]) for i in range(len(px)) for d in range(2)] + [(200, "d9", 5.0), (201, "d0", None)], "pixel_id long, date8 string, ndvi double").where("not (pixel_id = 201 and ndvi is null)")
    pred = frame(spark, pairs)
    got = {r.pixel_id: r.verdict for r in D.disagreement_scores(index, pred, D.characteristic_series(index, pred)).collect()}
    assert got == {200: "pred", 201: "gt", 202: "gt"}


def test_divergence_is_symmetric_and_not_negative(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 400), rng.normal(0.5, 2, 300)
    rows = [("train", "B2", float(x)) for x in a] + [("other", "B2", float(x)) for x in b] + [("same", "B2", float(x)) for x in a]
    df = spark.createDataFrame(rows, "area string, band string, value double")
    one = {r.area: r.kl for r in shift.sym_kl(df).collect()}
    back = {r.area: r.kl for r in shift.sym_kl(df, train="other").collect()}
    assert one["other"] == pytest.approx(back["train"]) and one["other"] > 0 and one["same"] == pytest.approx(0, abs=1e-9)
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 101)
    p, q = (np.histogram(x, edges, density=True)[0] + 1e-10 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    assert one["other"] == pytest.approx(0.5 * ((p * np.log(p / q)).sum() + (q * np.log(q / p)).sum()), rel=1e-6)

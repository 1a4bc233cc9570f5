"""Forest operators on samples whose class one channel tells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import direct, evaluation, forest

NAMES = ["B2_20240101", "B4_20240101", "B8_20240101", "B11_20240101"]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        label = (1, 3, 24)[i % 3]
        x = [rng.random(), rng.random(), {1: 0.0, 3: 1.0, 24: 2.0}[label] + 0.3 * rng.random(), None if i % 7 == 0 else rng.random()]
        rows.append((i, label, x))
    return spark.createDataFrame(rows, "pixel_id long, class_label int, features array<double>").persist()


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame([(c, i) for i, c in enumerate(NAMES)], "channel string, channel_idx int")


@pytest.fixture(scope="module")
def trained(samples):
    return forest.train_forest(samples, 4, trees=8, depth=4)


def test_accuracy_and_importance(trained, channels, tmp_path):
    model, classes, accuracy = trained
    assert classes == [1, 3, 24] and accuracy > 0.95
    imp = {r.channel: r.importance for r in forest.forest_importance(model, channels).collect()}
    assert imp["B8_20240101"] == pytest.approx(1, abs=1e-6) and max(v for k, v in imp.items() if k != "B8_20240101") < 0.5
    by = {(r.crop_id, r.channel): r.score for r in forest.class_importance(model, classes, channels, f"file://{tmp_path}").collect()}
    for crop in classes:
        assert sum(by[crop, c] for c in NAMES) == pytest.approx(1) and by[crop, "B8_20240101"] > 0.6
    assert all(by[69, c] == 0 for c in NAMES)


def test_combinations_with_the_channel_are_best(samples):
    rows = forest.evaluate_combinations(samples, NAMES, NAMES[:3], max_size=3, folds=2, trees=5).collect()
    assert len(rows) == 4 and all("B8_20240101" in r.combo for r in rows[:3]) and rows[0].mean_f1 > 0.95 > 0.6 > rows[3].mean_f1


def test_band_ranking_and_forward_selection(samples, channels, tmp_path):
    best = forest.rank_bands_forest(samples, channels, channels, f"file://{tmp_path}", trees=8, top=1, depth=4).where("crop_id in (1, 3, 24)").collect()
    assert {r.band for r in best} == {"B8"} and len(best) == 3
    chosen, history = forest.forward_select(samples, NAMES, ["B2_20240101", "B8_20240101", "B4_20240101"], 24, delta=0.02, trees=5)
    assert "B8_20240101" in chosen and [h["channel"] for h in history][:2] == ["B2_20240101", "B8_20240101"]
    assert max(h["iou"] for h in history) > 0.95


def test_clusters_keep_the_best_of_alike_channels(spark):
    rng = random.Random(2)
    rows = [(i, 1, [a, 2 * a + 1e-3 * rng.random(), rng.random()]) for i in range(200) for a in [rng.random()]]
    df = spark.createDataFrame(rows, "pixel_id long, class_label int, features array<double>")
    assert forest.cluster_channels(df, {"a": 0.1, "b": 0.9, "c": 0.5}, ["a", "b", "c"]) == ["b", "c"]


def test_direct_selector(samples, channels, tmp_path):
    got = direct.rf_direct(samples, channels, f"file://{tmp_path}", top_k=1, trees=8, depth=4).where("crop_id in (1, 3, 24)").collect()
    assert {(r.crop_id, r.channel) for r in got} == {(c, "B8_20240101") for c in (1, 3, 24)}
    with pytest.raises(ValueError):
        direct.rf_direct(samples, channels, "x")


def test_tiles_by_a_callable_and_by_a_model(spark, trained):
    rng = np.random.default_rng(0)
    x = {p: rng.random((4, h, w)) * 2.3 for p, h, w in (("a", 2, 3), ("b", 5, 5), ("c", 1, 1))}
    df = spark.createDataFrame([(p, v.shape[1], v.shape[2], v.ravel().tolist()) for p, v in x.items()], "patch_id string, height int, width int, values array<double>")
    got = {r.patch_id: r["values"] for r in evaluation.predict_tiles(df, lambda t: t, 5, 4, batch=2).collect()}
    assert got == {p: v.argmax(axis=0).ravel().tolist() for p, v in x.items()}
    model = trained[0]
    seen = {r.patch_id: r["values"] for r in evaluation.classify_tiles(df, model, 4).collect()}
    from pyspark.ml.linalg import Vectors

    assert seen == {p: [int(model.predict(Vectors.dense(v.reshape(4, -1)[:, i]))) for i in range(v[0].size)] for p, v in x.items()}


def test_erasing_blanks_one_rectangle_in_all_channels(spark):
    from fieldloom.operators import patches as P

    cells = [(f"p{k}", b, f"{b}_1", r, c, 0.5) for k in range(40) for b in ("B2", "B4") for r in range(20) for c in range(20)]
    df = spark.createDataFrame(cells, "patch_id string, band string, channel string, r int, c int, value double")
    out = P.augment(df, 20, noise=0.0, drop=0.0, scale=0.0, offset=0.0, gamma=0.0).where("value = 0")
    boxes = out.groupBy("patch_id").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).collect()
    assert 8 < len(boxes) < 32
    assert all(b.n == 2 * (b.r1 - b.r0 + 1) * (b.c1 - b.c0 + 1) and 2 <= b.r1 - b.r0 + 1 <= 4 and 2 <= b.c1 - b.c0 + 1 <= 4 for b in boxes)
    bright = P.augment(df, 20, noise=0.0, drop=0.0, scale=0.0, offset=0.0, gamma=0.0, erase=0.0).groupBy("patch_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    assert all(abs(b.lo - b.hi) < 1e-12 and 0.45 <= b.lo <= 0.55 for b in bright) and len({b.lo for b in bright}) > 30


def test_out_of_bag_accuracy_against_a_loop(samples):
    """Draws by another implementation of the hash, and each tree asked row by row."""
    import math
    import struct

    import xxhash
    from pyspark.ml.linalg import Vectors

    some = samples.where("pixel_id < 150").withColumn("class_label", F.when(F.col("pixel_id") % 5 == 0, 3).otherwise(F.col("class_label")))
    models, classes, accuracy = forest.bagged_forest(some, 4, trees=5, depth=3, per_pass=2)
    filled = {r.pixel_id: (list(r.x), classes.index(r.class_label)) for r in forest.impute(some, 4).collect()}

    def draws(pixel, tree):
        h = 42
        for part in (struct.pack("<q", pixel), struct.pack("<i", tree), struct.pack("<i", 42)):
            h = xxhash.xxh64_intdigest(part, h)
        unit, k, below = h % (1 << 53) / (1 << 53), 0, math.exp(-1)
        while unit >= below:
            k += 1
            below += math.exp(-1) / math.factorial(k)
        return k

    right = seen = 0
    for pixel, (x, label) in filled.items():
        votes = np.zeros(3)
        for t, m in enumerate(models):
            if draws(pixel, t) == 0:
                votes += m.predictProbability(Vectors.dense(x)).toArray()
        if votes.max() > 0:
            seen += 1
            right += int(votes.argmax()) == label
    assert 0 < seen < 150 and accuracy == pytest.approx(right / seen) and 0.6 < accuracy < 1


@pytest.mark.parametrize("patience, at_once", [(1, 1), (2, 4), (3, 2)])
def test_trials_side_by_side_choose_as_one_by_one(samples, patience, at_once):
    order = ["B2_20240101", "B4_20240101", "B8_20240101", "B11_20240101"]
    data = forest.impute(samples, 4).withColumn("label", (F.col("class_label") == 24).cast("double"))
    chosen, best, idle, tried = [], 0.0, 0, []
    for c in order:
        if idle < patience:
            iou = forest._iou(data, [NAMES.index(x) for x in (*chosen, c)], 5)
            tried.append((c, round(iou, 4), iou - best >= 0.02))
            if iou - best >= 0.02:
                chosen, best, idle = [*chosen, c], iou, 0
            else:
                idle += 1
    got, history = forest.forward_select(samples, NAMES, order, 24, delta=0.02, patience=patience, trees=5, at_once=at_once)
    assert got == chosen and [(h["channel"], h["iou"], h["accepted"]) for h in history] == tried


def test_models_are_loaded_once_for_each_worker(spark, tmp_path):
    """Ten megabytes of weights: the tasks' closure holds a handle, and a worker makes its model once."""
    import os

    weights = np.random.default_rng(1).random((3, 400_000))
    df = spark.createDataFrame([(f"p{i}", 2, 2, [float(i + j) for j in range(12)]) for i in range(60)], "patch_id string, height int, width int, values array<double>").repartition(12)

    def make():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda x: x * weights[:, :1, None, None].reshape(1, 3, 1, 1)

    out = evaluation.predict_tiles(df, make, 2, 3, load=True)
    assert out.count() == 60
    pids = (tmp_path / "loads").read_text().split()
    assert len(pids) == len(set(pids)) <= 12
    again = evaluation.predict_tiles(df, make(), 2, 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_forest_on_dates_makes_its_samples_once(spark, monkeypatch):
    """What the forest's passes read is a table: no join, grouping or generator of observations is behind it."""
    days, bands = ["20240105", "20240405", "20240706"], ["B2", "B4"]
    obs = spark.createDataFrame([(p, d, b, float(100 * p + 10 * i + j) if p % 9 else None) for p in range(1500) for i, d in enumerate(days) for j, b in enumerate(bands)], "pixel_id long, date8 string, band string, value double")
    labels = spark.createDataFrame([(p, (1, 3, 0)[p % 3]) for p in range(1500)], "pixel_id long, cdl_id int")
    names = spark.createDataFrame([(f"{b}_{d}", d, 2 * i + j) for i, d in enumerate(days) for j, b in enumerate(bands)], "channel string, date8 string, channel_idx int")
    seen = []
    monkeypatch.setattr(forest, "rank_bands_forest", lambda samples, channels, domain, *rest: seen.extend((samples, channels, domain)))
    direct.scoped_forest(obs, labels, names, spark.createDataFrame([("20240105",), ("20240706",), ("20240105",)], "date8 string"), "x", top=1, frac=1.0)
    for df in seen:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and not any(x in plan for x in ("Join", "Aggregate", "Generate", "LocalRelation", "Window"))
    assert {(r.channel, r.channel_idx) for r in seen[1].collect()} == {("B2_20240105", 0), ("B4_20240105", 1), ("B2_20240706", 2), ("B4_20240706", 3)}
    want = {p: ((1, 3)[p % 3], [float(100 * p + k) if p % 9 else None for k in (0, 1, 20, 21)]) for p in range(1500) if p % 3 < 2}
    assert {r.pixel_id: (r.class_label, r.features) for r in seen[0].collect()} == want

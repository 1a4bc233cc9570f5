from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import catalog, forest
from fieldloom.sources import outputs


def test_scene_files(spark, tmp_path):
    for name, data in {
        "S2H_2024_2024_01_16.tif": b"II*\0....", "2024/S2H_2024_2024_03_31_processed.tif": b"", "2024/s2/S2H_2024_2024_03_31.tif": b"MM\0*xx",
        "._S2H_2024_2024_05_01.tif": b"junk", "2024/notes.tif": b"??", "2024/S2H_2024_2024_03_31.txt": b"x", "big.tif": b"II+\0", "other.tif": b"MM\0+",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = catalog.list_files(spark, str(tmp_path))
    scenes = catalog.scene_catalog(files)
    assert sorted((r.date8, r.processed, r.length) for r in scenes.collect()) == [("20240116", False, 8), ("20240331", False, 6)], "readers pass over files without bytes"
    pending = catalog.pending_scenes(scenes.where("not processed"), scenes.where("processed"))
    assert {r.date8 for r in pending.collect()} == {"20240116", "20240331"}, "a file without bytes counts as absent"
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(str(tmp_path))
    ok = {r.path.rsplit("/", 1)[1]: r.ok for r in catalog.check_magic(binary).collect()}
    assert ok["big.tif"] and ok["other.tif"] and ok["S2H_2024_2024_01_16.tif"] and not ok["notes.tif"]


def test_selection_roundtrip_and_fallback(spark, tmp_path):
    rows = [(1, 0, 1, "B2_20240101", 0.5), (1, 0, 2, "B4_20240101", 0.4), (3, 1, 1, "B4_20240101", 0.9)]
    sel = spark.createDataFrame(rows, "crop_id int, crop_order int, rank int, channel string, score double")
    outputs.write_selection(sel, f"{tmp_path}/a", {"selector": "s"})
    back = outputs.read_selection(spark, f"{tmp_path}/a")
    assert sorted(map(tuple, back.collect())) == [(1, 0, 1, "B2_20240101"), (1, 0, 2, "B4_20240101"), (3, 1, 1, "B4_20240101")]
    assert [r.value for r in spark.read.text(f"{tmp_path}/a/bands").collect()] == ["B2_20240101", "B4_20240101"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/selection").write_text('{"top_k": [{"k": 1, "per_crop": [{"crop": "1", "channels": ["x_1"]}]}, {"k": 2, "per_crop": [{"crop": "1", "channels": ["x_1", "y_1"]}]}]}')
    assert outputs.read_selection(spark, f"{tmp_path}/b").count() == 2
    outputs.write_candidates(spark.createDataFrame([(1, "date", "20240101", 0.5, 1)], "crop_id int, kind string, value string, score double, rank int"), f"{tmp_path}/c")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c/rows").first()["value"] == "20240101"


def test_average_linkage():
    d = np.array([[0, 0.05, 0.9, 0.8], [0.05, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.02], [0.8, 0.9, 0.02, 0]])
    assert forest.average_linkage(d, 0.1) == [0, 0, 1, 1]
    assert forest.average_linkage(d, 0.01) == [0, 1, 2, 3] and len(set(forest.average_linkage(d, 0.9))) == 1


def test_class_importance_against_a_loop(spark):
    # one tree: root splits on 0, its left child on 1
    nodes = spark.createDataFrame(
        [
            (0, 0, 0.5, 100, [50.0, 50.0], 1, 2, 0), (0, 1, 0.3, 60, [45.0, 15.0], 3, 4, 1), (0, 2, 0.2, 40, [5.0, 35.0], -1, -1, -1),
            (0, 3, 0.1, 40, [40.0, 0.0], -1, -1, -1), (0, 4, 0.4, 20, [5.0, 15.0], -1, -1, -1),
        ],
        "tree int, id int, impurity double, n long, stats array<double>, left int, right int, feature int",
    )
    g0, g1 = 0.5 - 0.6 * 0.3 - 0.4 * 0.2, 0.3 - 40 / 60 * 0.1 - 20 / 60 * 0.4
    raw = {(0, 0): g0, (0, 1): 45 / 50 * 0.6 * g1, (1, 0): g0, (1, 1): 15 / 50 * 0.6 * g1}
    got = {(r.class_idx, r.feature): r.importance for r in forest.node_importance(nodes).collect()}
    for c in (0, 1):
        total = raw[c, 0] + raw[c, 1]
        assert abs(got[c, 0] - raw[c, 0] / total) < 1e-12 and abs(got[c, 1] - raw[c, 1] / total) < 1e-12


def test_plans_prune_and_stay_in_the_engine(spark):
    from fieldloom.operators import series
    from fieldloom.plans import registry

    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr("o_orderkey AS pixel_id", "'d' AS date8", "o_orderstatus AS band", "o_totalprice AS value", "o_orderpriority AS extra")
    plan = series.ndvi(df, red="O", nir="F")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_orderstatus" in plan and "o_orderpriority" not in plan
    for name in ("flagship_union", "i3_disagreement_scores", "g17_build_chips", "b12_majority_filter"):
        plan = registry.load()[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def exchanges_above(plan: str, scan: str) -> int:
    """Exchanges of the tree string that stand above a line with ``scan``."""
    path, n = [], 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        path = [x for x in path if x[0] < depth]
        path.append((depth, line))
        if scan in line:
            n += sum("Exchange" in x and "Broadcast" not in x for _, x in path)
    return n


def test_stored_observations_are_not_exchanged_again(spark):
    from fieldloom.operators import patches as P
    from fieldloom.sources import storage

    obs = spark.range(400).selectExpr("id AS pixel_id", "id div 20 AS r", "id % 20 AS c", "'20240101' AS date8", "'B2' AS band", "CAST(id AS DOUBLE) AS value")
    channels = spark.createDataFrame([("B2_20240101", 0)], "channel string, ordinal int")
    corners = obs.selectExpr("r div 5 * 5 AS r0", "c div 5 * 5 AS c0").distinct()
    plain = P.build_chips(obs, corners, channels, 5)
    stored = storage.write_by_patch(obs, "obs_by_patch", 5, 4)
    by_pixel = storage.write_by_pixel(obs, "obs_by_pixel", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            chips = P.build_chips(stored, corners, channels, 5)
            assert exchanges_above(chips._jdf.queryExecution().executedPlan().toString(), "obs_by_patch") == 0
            assert sorted(map(tuple, chips.collect())) == sorted(map(tuple, plain.collect()))
            samples = by_pixel.join(obs.select("pixel_id", F.lit(1).alias("k")).distinct(), "pixel_id").groupBy("pixel_id").agg(F.collect_list("value"))
            assert exchanges_above(samples._jdf.queryExecution().executedPlan().toString(), "obs_by_pixel") == 0
        plan = P.build_chips(spark.range(9).selectExpr("id AS r", "id AS c", "'a' AS date8", "'b' AS band", "1D AS value"), corners, channels, 5)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Range (0, 9") == 1 and exchanges_above(plan, "Range (0, 9") == 1, "values move once"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in ("obs_by_patch", "obs_by_pixel"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_chips_with_missing_pixels(spark):
    from fieldloom.operators import patches as P

    obs = spark.createDataFrame([(0, 0, "20240101", "B2", 5.0), (1, 1, "20240101", "B2", None), (1, 0, "20240101", "B2", 7.0)], "r long, c long, date8 string, band string, value double")
    chips = P.build_chips(obs, spark.createDataFrame([(0, 0)], "r0 long, c0 long"), spark.createDataFrame([("B2_20240101", 0)], "channel string, ordinal int"), 2)
    assert [r["values"] for r in chips.collect()] == [[5.0, 0.0, 7.0, 0.0]]
    assert P.normalise_chips(chips).first()["values"] == pytest.approx([5 / 7, 0.0, 1.0, 0.0], abs=1e-8)


def test_samples_have_no_single_task(spark):
    from fieldloom.operators import sampling

    df = spark.range(5000).selectExpr("id AS pixel_id", "CASE WHEN id < 4500 THEN 'a' WHEN id < 4998 THEN 'b' END AS area", "1 AS cdl_id")
    for out in (sampling.sample_ids(df), sampling.cap_rows(df, 77), sampling.first_of_each(df, "area", 50, 42, "pixel_id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    hashed = {r.pixel_id: r.h for r in df.select("pixel_id", sampling.hash_order("pixel_id", 42).alias("h")).collect()}
    want = {p for lo, hi in ((0, 4500), (4500, 4998), (4998, 5000)) for p in sorted(range(lo, hi), key=lambda p: (hashed[p], p))[:50]}
    assert {r.pixel_id for r in sampling.first_of_each(df, "area", 50, 42, "pixel_id").collect()} == want
    assert {r.pixel_id for r in sampling.cap_rows(df, 77).collect()} == set(sorted(range(5000), key=lambda p: (hashed[p], p))[:77])

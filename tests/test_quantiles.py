from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import disagreement, patches, quantiles, scoring, shift

SHARES = {"p0": 0.0, "p2": 0.02, "mid": 0.5, "p95": 0.95, "top": 1.0}


def values(rng: random.Random, kind: str, n: int) -> list:
    if kind == "even":
        return [rng.random() for _ in range(n)]
    if kind == "few":
        return [float(rng.choice((1, 1, 1, 7))) for _ in range(n)]
    if kind == "steep":
        return [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "huge":
        return [rng.choice((-1.7e308, 1.7e308, 0.0, -0.5)) for _ in range(n)]
    return [None if i % 3 else float(i) for i in range(n)]


@pytest.mark.parametrize("cells", [2, 4096])
def test_percentiles_are_those_of_spark_bit_by_bit(spark, cells):
    rng = random.Random(cells)
    rows = [("even", v) for v in values(rng, "even", 3000)] + [("few", v) for v in values(rng, "few", 40)] + [("steep", v) for v in values(rng, "steep", 101)]
    rows += [("huge", v) for v in values(rng, "huge", 50)] + [("gaps", v) for v in values(rng, "gaps", 30)] + [("none", None)] * 3 + [(None, 5.0), ("one", -0.25)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ours = quantiles.exact_percentiles(df, ["g"], "v", SHARES, cells)
    theirs = df.groupBy("g").agg(*(F.percentile("v", p).alias(k) for k, p in SHARES.items()))
    bits = lambda out: {r["g"]: tuple(None if r[k] is None else struct.pack(">d", r[k] + 0.0) for k in SHARES) for r in out.collect()}
    assert bits(ours) == bits(theirs)
    whole = quantiles.exact_percentiles(df.where("g = 'even'"), [], "v", SHARES, cells).first()
    assert tuple(whole) == tuple(df.where("g = 'even'").agg(*(F.percentile("v", p).alias(k) for k, p in SHARES.items())).first())


def test_one_group_that_holds_nearly_all_rows(spark):
    df = spark.range(40_000).selectExpr("IF(id % 20 = 0, id % 7, 99) AS g", "CAST(xxhash64(id) AS DOUBLE) AS v")
    ours = quantiles.exact_percentiles(df, ["g"], "v", {"mid": 0.5})
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, df.groupBy("g").agg(F.median("v")).collect()))
    assert quantiles.exact_percentiles(df.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []
    assert tuple(quantiles.exact_percentiles(df.limit(0), [], "v", {"mid": 0.5}).first()) == (None,)


def test_stored_sketches(spark, tmp_path):
    df = spark.range(30_000).selectExpr("CAST(id % 3 AS STRING) AS scene", "IF(id % 2 = 0, 'B2', 'B4') AS band", "IF(id % 50 = 0, NULL, CAST(pmod(xxhash64(id), 100000) AS DOUBLE)) AS v")
    quantiles.sketch_table(df.where("scene < '2'"), ["scene", "band"], "v").write.partitionBy("scene").parquet(f"{tmp_path}/k")
    quantiles.sketch_table(df.where("scene = '2'"), ["scene", "band"], "v").write.mode("append").partitionBy("scene").parquet(f"{tmp_path}/k")
    table = spark.read.schema("n long, sketch binary, band string, scene string").parquet(f"{tmp_path}/k")
    for scenes in (("0", "1", "2"), ("1",)):
        some = df.where(F.col("scene").isin(*scenes))
        got = {r["band"]: r for r in quantiles.sketch_percentiles(table.where(F.col("scene").isin(*scenes)), ["band"], {"lo": 0.02, "mid": 0.5, "hi": 0.98}).collect()}
        for band in ("B2", "B4"):
            own = sorted(r[0] for r in some.where(F.col("band") == band).where("v is not null").select("v").collect())
            assert got[band]["n"] == len(own)
            for name, p in (("lo", 0.02), ("mid", 0.5), ("hi", 0.98)):
                rank = sum(v < got[band][name] for v in own) / len(own)
                assert abs(rank - p) < 0.014


def test_operators_count_their_percentiles(spark):
    rng = random.Random(2)
    obs = spark.createDataFrame([(i, "a" if i % 3 else "train", rng.choice(("B2", "B4")), None if i % 11 == 0 else rng.random() * 100) for i in range(900)], "pixel_id long, area string, band string, value double")
    want = {r["band"]: (r["lo"], r["hi"]) for r in obs.groupBy("band").agg(F.percentile("value", 0.02).alias("lo"), F.percentile("value", 0.98).alias("hi")).collect()}
    assert {r["band"]: (r["lo"], r["hi"]) for r in patches.norm_stats(obs).collect()} == want
    got = {(r["area"], r["band"]): (r["p5"], r["p95"]) for r in shift.area_stats(obs).collect()}
    assert got == {(r["area"], r["band"]): (r["a"], r["b"]) for r in obs.groupBy("area", "band").agg(F.percentile("value", 0.05).alias("a"), F.percentile("value", 0.95).alias("b")).collect()}
    index = obs.select("pixel_id", F.col("band").alias("date8"), (F.col("value") / 100).alias("ndvi"))
    pred = obs.select("pixel_id", F.lit(1).alias("gt_class"), F.lit(1).alias("pred_class"))
    got = {r["date8"]: r["ref"] for r in disagreement.characteristic_series(index, pred).collect()}
    assert got == {r["date8"]: r["m"] for r in index.groupBy("date8").agg(F.median("ndvi").alias("m")).collect()}


def test_spread_of_the_rest_around_a_large_mean(spark):
    """Three crops near 1e8 whose values differ by one: squares of the values alone lose that."""
    rows = [(c * 100 + i, c, "B2_20240101", 0, 1e8 + i % 2 + c) for c in (1, 3, 24) for i in range(40)]
    df = spark.createDataFrame(rows, "pixel_id long, crop_id int, channel string, channel_idx int, value double")
    got = {r.crop_id: r.score for r in scoring.gsi_one_vs_rest(df, (1, 3, 24)).collect()}
    for crop in (1, 3, 24):
        own, rest = ([v - 1e8 for _, c, _, _, v in rows if (c == crop) == mine] for mine in (True, False))
        mean, sd = (lambda x: sum(x) / len(x)), lambda x: (sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x)) ** 0.5
        assert got[crop] == pytest.approx(abs(mean(own) - mean(rest)) / (1.96 * (sd(own) + sd(rest)) + 1e-6), rel=1e-6)

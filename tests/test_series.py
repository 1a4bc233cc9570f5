from __future__ import annotations

import random

import pytest

from fieldloom.operators import series as S
from fieldloom.operators import shift

# Mean index by date of the published 2024 run; two dates have none
MEANS = {
    "20240101": 0.27271, "20240116": 0.32246, "20240131": None, "20240215": 0.36052, "20240301": 0.4208, "20240316": 0.42637, "20240331": 0.43893,
    "20240415": 0.43075, "20240430": 0.41463, "20240515": 0.39576, "20240530": 0.48698, "20240614": 0.60001, "20240629": 0.64341, "20240714": 0.66014,
    "20240729": 0.64281, "20240813": 0.60492, "20240828": 0.5506, "20240912": 0.4737, "20240927": 0.40938, "20241012": 0.35086, "20241027": 0.31471,
    "20241111": 0.27119, "20241126": 0.27018, "20241211": None, "20241226": 0.28635,
}


def frame(spark, means):
    return spark.createDataFrame(list(means.items()), "date8 string, mean_ndvi double")


def test_published_dates(spark):
    df = frame(spark, MEANS)
    assert S.peak_ndvi_date(df).first()[0] == "20240714"
    assert [r.date8 for r in S.quarterly_dates(df).orderBy("quarter").collect()] == ["20240331", "20240629", "20240714", "20241012"]


def test_fallbacks_without_means(spark):
    none = frame(spark, dict.fromkeys(MEANS))
    assert S.peak_ndvi_date(none).first()[0] == "20240714"
    # nearest to 0215, 0516, 0815 and 1115 by the difference of MMDD
    assert [r.date8 for r in S.quarterly_dates(none).orderBy("quarter").collect()] == ["20240215", "20240515", "20240813", "20241111"]
    assert S.peak_ndvi_date(frame(spark, {"20240101": None, "20240305": None})).first()[0] == "20240305"


def test_index_modes(spark):
    rows = [(1, "d", "B4", 0.0), (1, "d", "B8", 0.0), (2, "d", "B4", 1.0), (2, "d", "B8", 3.0), (3, "d", "B4", 1.0), (3, "d", "B8", None), (4, "d", "B4", 0.0), (4, "d", "B8", 2.0)]
    df = spark.createDataFrame(rows, "pixel_id long, date8 string, band string, value double")
    get = lambda m: {r.pixel_id: r.ndvi for r in S.ndvi(df, m).collect()}
    assert get("null") == {1: None, 2: 0.5, 3: None, 4: 1.0}
    assert get("eps") == {1: 0.0, 2: 0.5, 3: None, 4: 1.0}
    add = get("add_eps")
    assert add[1] is add[3] is add[4] is None and add[2] == pytest.approx(2 / (4 + 1e-6))


def test_reference_dates(spark):
    one = lambda *d: shift.reference_date(spark.createDataFrame([(x,) for x in d], "date8 string")).first()[0]
    assert one("20240101", "20240710", "20240720", "20240730", "20240801") == "20240720"
    assert one("20240701", "20240710") == "20240710" and one("20240101", "20240201", "20240301", "20240401") == "20240301"


@pytest.mark.parametrize("mode, per_pass", [("null", 8), ("eps", 2), ("add_eps", 1)])
def test_means_for_one_exchange_equal_those_of_the_joined_index(spark, mode, per_pass):
    """Values that are missing, repeated or negative, pixels without a label or with several, a date with one band, one without crops, null pixels."""
    rng = random.Random(per_pass)
    days = ["20240105", "20240302", "20240405", "20240706", "20241001"]
    rows = [(p, d, b, rng.choice((None, 0.0, -1.0, 1.0, rng.random(), 3 * rng.random()))) for p in (*range(60), None) for d in days for b in ("B2", "B4", "B8") for _ in range(rng.choice((0, 1, 1, 1, 2)))]
    rows = [r for r in rows if (r[1] != days[1] or r[2] == "B4") and (r[1] != days[3] or (r[0] or 0) % 4 == 0)]
    obs = spark.createDataFrame(rows, "pixel_id long, date8 string, band string, value double").repartition(5)
    labels = spark.createDataFrame([(p, (24, 1, 3, 1)[p % 4] if p % 4 else 0) for p in (*range(50), *range(5, 9), 70)] + [(None, 1)], "pixel_id long, cdl_id int")
    for floor in (0.0, 0.7):
        want = {r.date8: r for r in S.mean_ndvi_by_date(S.ndvi(obs, mode), labels, (1, 3, 24), floor).collect()}
        got = S.mean_ndvi_of(obs, labels, (1, 3, 24), [*days, "20251231"], floor, mode, per_pass=per_pass)
        assert len(want) == 4 and {r.date8 for r in got.collect()} == set(want)
        for r in got.collect():
            assert (r.valid_frac, r.mean_ndvi) == pytest.approx((want[r.date8].valid_frac, want[r.date8].mean_ndvi), nan_ok=True)
    assert S.mean_ndvi_of(obs, labels, (1,), []).collect() == []


def test_means_move_pixels_once(spark):
    from fieldloom.plans import registry

    plan = registry.load()["d2_mean_ndvi_by_date"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pixel_id") == 1 and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")

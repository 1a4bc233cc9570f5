from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from fieldloom.operators import scoring as S
from fieldloom.operators import selection as L

SCHEMA = "pixel_id long, crop_id int, channel string, channel_idx int, value double"


def samples(spark, seed=1, rows=40):
    rng = random.Random(seed)
    out = []
    for p in range(rows * 3):
        crop = (1, 3, 24)[p % 3]
        for j, ch in enumerate(("B2_20240101", "B4_20240101", "B2_20240301", "B4_20240301")):
            v = None if rng.random() < 0.1 or (crop == 24 and j == 3) else rng.gauss(crop * (j + 1), 2)
            out.append((p, crop, ch, j, v))
    out += [(9000 + i, 36, "B2_20240101", 0, 5.0) for i in range(9)]
    return out, spark.createDataFrame(out, SCHEMA)


def arrays(rows):
    out = {}
    for _, crop, ch, _, v in rows:
        out.setdefault((crop, ch), []).append(np.nan if v is None else v)
    return {k: np.array(v) for k, v in out.items()}


def test_pairwise_with_few_rows_and_a_missing_channel(spark):
    rows, df = samples(spark)
    got = {(r.crop_id, r.channel): r.score for r in S.gsi_pairwise(df, (1, 3, 24, 36)).collect()}
    a = arrays(rows)
    si = lambda s, o, c: abs(np.nanmean(a[s, c]) - np.nanmean(a[o, c])) / (1.96 * (np.nanstd(a[s, c]) + np.nanstd(a[o, c])) + 1e-6)
    for c in ("B2_20240101", "B4_20240101", "B2_20240301"):
        for s in (1, 3, 24):
            assert got[s, c] == pytest.approx(np.mean([si(s, o, c) for o in (1, 3, 24) if o != s]))
    assert all(got[s, "B4_20240301"] == 0 for s in (1, 3, 24)), "a channel missing for one crop scores 0 for all"
    assert all(got[36, c] == 0 for c in {c for _, c in got})


def test_one_vs_rest_from_merged_moments(spark):
    rows, df = samples(spark, 2)
    got = {(r.crop_id, r.channel): r.score for r in S.gsi_one_vs_rest(df, (1, 3, 24, 36)).collect()}
    a = arrays(rows)
    for s, c in itertools.product((1, 3), ("B2_20240101", "B4_20240101", "B4_20240301")):
        rest = np.concatenate([v for (k, ch), v in a.items() if ch == c and k != s])
        want = abs(np.nanmean(a[s, c]) - np.nanmean(rest)) / (1.96 * (np.nanstd(a[s, c]) + np.nanstd(rest)) + 1e-6)
        assert got[s, c] == pytest.approx(want)
    assert got[36, "B2_20240101"] == 0


def test_nearest_date_over_years_and_ties(spark):
    scores = "crop_id int, channel string, channel_idx int, score double"
    primary = spark.createDataFrame([(1, "B2_20240110", 0, 1.0), (1, "B2_20241231", 1, 4.0), (1, "B4_20240110", 2, 7.0)], scores)
    extra = spark.createDataFrame([(1, "B2_20230105", 0, 10.0, 2023), (1, "B2_20230115", 1, 20.0, 2023), (1, "B2_20230228", 2, 30.0, 2023)], scores + ", year int")
    got = {r.channel: r.score for r in S.adjust_multi_year(primary, extra).collect()}
    # both neighbours are five days away: the first in channel order; 31 December isn't next to January
    assert got == {"B2_20240110": 5.5, "B2_20241231": 17.0, "B4_20240110": 7.0}


def crop_scores(spark, table):
    rows = [(k, f"B{j}_20240101", j, float(v)) for k, vs in table.items() for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, "crop_id int, channel string, channel_idx int, score double")


def test_selection_modes_and_first_seen_union(spark):
    df = crop_scores(spark, {3: (0.1, 0.9, 0.9, 0.3), 1: (0.5, 0.5, 0.5, 0.5)})
    top = {(r.crop_id, r.rank): r.channel for r in L.select_top_k(df, 2).collect()}
    assert top == {(1, 1): "B0_20240101", (1, 2): "B1_20240101", (3, 1): "B1_20240101", (3, 2): "B2_20240101"}
    union = [r.channel for r in L.union_channels(L.select_top_k(df, 2)).orderBy("ordinal").collect()]
    assert union == ["B0_20240101", "B1_20240101", "B2_20240101"]
    assert {r.crop_id for r in L.select_threshold(df, 0.5).collect()} == {3}, "a constant crop scales to 0"
    cut = np.percentile([0.1, 0.9, 0.9, 0.3] + [0.5] * 4, 60)
    assert L.select_percentile(df, 60).count() == sum(x >= cut for x in [0.1, 0.9, 0.9, 0.3] + [0.5] * 4)
    with pytest.raises(ValueError):
        L.subset_selection(L.select_top_k(df, 2), 3)
    with pytest.raises(ValueError):
        L.sweep(df, ks=(1,), percentiles=(50,))


def test_projection_on_other_dates(spark):
    local = spark.createDataFrame([(f"{b}_{d}", b, d, d[4:], i * 2 + j) for i, d in enumerate(("20240101", "20240229", "20241226")) for j, b in enumerate(("B2", "B4"))], "channel string, band string, date8 string, mmdd string, channel_idx int")
    union = spark.createDataFrame([("B2_20220101", 0), ("B4_20220305", 1), ("B2_20221231", 2), ("B1_20220101", 3), ("odd", 4), ("B4_20220115", 5)], "channel string, ordinal int")
    got = {r.channel: (r.local_channel, r.status) for r in L.project_selection(union, local).collect()}
    assert got == {
        "B2_20220101": ("B2_20240101", "ok"), "B4_20220305": ("B4_20240229", "ok"), "B2_20221231": ("B2_20241226", "ok"),
        "B1_20220101": (None, "unknown band"), "odd": (None, "malformed"), "B4_20220115": ("B4_20240101", "ok"),
    }

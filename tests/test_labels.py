from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fieldloom.operators import cleaning as C
from fieldloom.operators import tiles as T


def raster(spark, grid):
    cells = [(i * len(grid[0]) + j, i, j, v) for i, row in enumerate(grid) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "pixel_id long, r long, c long, cdl_id int")


def grid_of(df):
    cells = {(r.r, r.c): r.cdl_id for r in df.collect()}
    h, w = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
    return [[cells[i, j] for j in range(w)] for i in range(h)]


def neighbours(grid, i, j):
    return [(a, b) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < len(grid) and 0 <= b < len(grid[0])]


def eroded(grid, rounds):
    inside = {(i, j) for i in range(len(grid)) for j in range(len(grid[0]))}
    for _ in range(rounds):
        inside = {(i, j) for i, j in inside if len(n := neighbours(grid, i, j)) == 4 and all(p in inside and grid[p[0]][p[1]] == grid[i][j] for p in n)}
    return inside


def noisy(seed, n=12):
    rng = random.Random(seed)
    return [[rng.choice((1, 1, 1, 1, 3, 0)) for _ in range(n)] for _ in range(n)]


def test_full_class_erodes_at_the_image_edge(spark):
    out = grid_of(C.erode_boundaries(raster(spark, [[1] * 5] * 5)))
    assert out == [[255 if i in (0, 4) or j in (0, 4) else 1 for j in range(5)] for i in range(5)]


def test_hole_takes_its_ring(spark):
    g = [[1] * 7 for _ in range(7)]
    g[3][3] = 0
    out = grid_of(C.erode_boundaries(raster(spark, g)))
    assert out[3][3] == out[2][3] == out[3][4] == 255 and out[2][2] == 1


@pytest.mark.parametrize("seed, rounds", [(1, 1), (2, 2), (3, 3), (3, 5), (4, 10)])
def test_erosion_against_a_loop(spark, seed, rounds, monkeypatch):
    monkeypatch.setattr(T, "SIDE", 5)
    monkeypatch.setattr(T.side_for, "__defaults__", (1,))
    g = noisy(seed) if seed < 3 else [[1 if 2 < i < 31 and not (seed == 3 and i == j == 20) else 3 for j in range(34)] for i in range(34)]
    inside = eroded(g, rounds)
    want = [[v if (i, j) in inside else 255 for j, v in enumerate(row)] for i, row in enumerate(g)]
    assert grid_of(C.erode_boundaries(raster(spark, g), rounds)) == want


def test_components_of_1_3_and_4_pixels(spark):
    mask = [(0, 0), (2, 0), (2, 1), (3, 1), (5, 3), (5, 4), (6, 3), (6, 4)]
    df = spark.createDataFrame([(r, c, 1) for r, c in mask], "r long, c long, cdl_id int")
    assert {(r.r, r.c) for r in C.small_components(df, 4).collect()} == {(0, 0), (2, 0), (2, 1), (3, 1)}


def component_sizes(g):
    """By a search from every pixel."""
    out = {}
    for i in range(len(g)):
        for j in range(len(g[0])):
            if (i, j) not in out:
                seen, todo = {(i, j)}, [(i, j)]
                while todo:
                    for p in neighbours(g, *todo.pop()):
                        if p not in seen and g[p[0]][p[1]] == g[i][j]:
                            seen.add(p)
                            todo.append(p)
                out |= dict.fromkeys(seen, len(seen))
    return out


def spiral(n):
    """One path of 1 through a square of 3, whose parts in a tile are many."""
    g = [[3] * n for _ in range(n)]
    r, c, dr, dc = 0, 0, 0, 1
    for side in [n - 1, *(x for k in range(n - 1, 0, -2) for x in (k, k))]:
        for _ in range(side):
            g[r][c] = 1
            r, c = r + dr, c + dc
        dr, dc = dc, -dr
    return g


@pytest.mark.parametrize("size", [1, 2, 4, 6, 20, 60, 200])
def test_components_against_a_search(spark, size, monkeypatch):
    g = noisy(9, 40)
    want = {p for p, n in component_sizes(g).items() if n < size}
    monkeypatch.setattr(T, "SIDE", 16)
    assert {(r.r, r.c) for r in C.small_components(raster(spark, g), size).collect()} == want


@pytest.mark.parametrize("grid", [noisy(9, 30), spiral(41), [[i % 2 for _ in range(21)] for i in range(21)]])
def test_components_over_many_tiles(spark, grid):
    found = T.components(raster(spark, grid), side=8).collect()
    assert {(r.r, r.c): r["size"] for r in found} == component_sizes(grid)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add((r.r, r.c))
    assert all(len({component_sizes(grid)[p] for p in ps}) == 1 and len(ps) == component_sizes(grid)[next(iter(ps))] for ps in groups.values())
    small = T.components(raster(spark, grid), side=8, least=30).where("size < 30").collect()
    assert {(r.r, r.c) for r in small} == {p for p, n in component_sizes(grid).items() if n < 30}


def test_sizes_beyond_a_halo(spark, monkeypatch):
    g = noisy(2, 30)
    df, sizes = raster(spark, g), component_sizes(g)
    monkeypatch.setattr(C, "WIDEST_HALO", 5)
    assert {(r.r, r.c) for r in C.small_components(df, 40).collect()} == {p for p, n in sizes.items() if n < 40}
    beyond = grid_of(C.drop_small_components(df, 7))
    monkeypatch.undo()
    assert grid_of(C.drop_small_components(df, 7)) == beyond


@pytest.mark.parametrize("k", [3, 5, 9, 31])
def test_majority_against_a_loop(spark, k, monkeypatch):
    monkeypatch.setattr(T, "SIDE", 5)
    monkeypatch.setattr(T.side_for, "__defaults__", (1,))
    g, h = noisy(4), k // 2
    want = []
    for i in range(12):
        row = []
        for j in range(12):
            seen = Counter(g[a][b] for a in range(max(0, i - h), min(12, i + h + 1)) for b in range(max(0, j - h), min(12, j + h + 1)))
            row.append(min(seen, key=lambda v: (-seen[v], v)))
        want.append(row)
    assert grid_of(C.majority_filter(raster(spark, g), k)) == want


def test_majority_tie_goes_to_the_least_class(spark):
    out = grid_of(C.majority_filter(raster(spark, [[3, 3, 1], [1, 5, 3], [1, 3, 1]])))
    assert out[1][1] == 1 and out[0][0] == 3


def test_orders_of_the_two_clean_ups_differ(spark):
    df = raster(spark, noisy(6)).selectExpr("*", "90 AS confidence")
    a, b = C.process_labels(df, legacy=True), C.refine_labels(df.drop("confidence"), erode=1, majority=3)
    assert grid_of(a) != grid_of(b)
    with pytest.raises(ValueError):
        C.refine_labels(df)


def test_unlisted_unknown_and_out_of_range_labels(spark):
    df = spark.createDataFrame([(1, 1), (2, 76), (3, 204), (4, 255), (5, 300), (6, -4), (7, None)], "pixel_id long, cdl_id int")
    assert {r.pixel_id: r.model_id for r in C.remap_labels(df).collect()} == {1: 1, 2: 8, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_nodata_and_missing(spark):
    bad = [float("nan"), float("inf"), float("-inf"), -1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*bad, 0.0, 5.0])], "pixel_id long, value double")
    assert [r.value for r in C.assign_nodata(df).orderBy("pixel_id").collect()] == [-9999.0] * 5 + [0.0, 5.0]
    assert [r.value for r in C.to_null(df).orderBy("pixel_id").collect()] == [None] * 5 + [0.0, 5.0]


def test_albers_origin_and_symmetry(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-96.0, 23.0), (-95.0, 23.0), (-97.0, 23.0), (-121.5, 38.5)], "lon double, lat double")
    row, col = C.albers_row_col(F.col("lon"), F.col("lat"), (0.0, 1.0, 0.0, 1.0))
    got = [tuple(r) for r in df.select(row, col).collect()]
    assert abs(got[0][0]) <= 1 and abs(got[0][1]) <= 1 and got[1][1] == -got[2][1] - 1
    # a point of the Sacramento valley lies some 2,170 km west and 1,970 km north of the origin
    assert -2_250_000 < got[3][1] < -2_100_000 and -2_080_000 < got[3][0] < -1_900_000


@pytest.mark.parametrize("halo", [1, 3, 15])
def test_rows_moved(spark, halo):
    n = 3 * T.side_for(halo)
    moved = T.dealt(spark.range(n * n).selectExpr(f"id div {n} AS r", f"id % {n} AS c"), T.side_for(halo), halo).count()
    assert moved <= 1.2 * n * n


def test_null_classes_and_gaps(spark):
    cells = [(0, 0, 0, None), (1, 0, 1, None), (2, 0, 2, 1), (3, 5, 5, 1), (4, -3, -3, 3)]
    df = spark.createDataFrame(cells, "pixel_id long, r long, c long, cdl_id int")
    assert {(r.pixel_id, r.cdl_id) for r in C.majority_filter(df).collect()} == {(0, None), (1, None), (2, None), (3, 1), (4, 3)}
    assert {(r.r, r.c) for r in C.small_components(df, 2).collect()} == {(0, 2), (5, 5), (-3, -3)}
    assert C.majority_filter(df.limit(0)).collect() == []


def test_resampling_reads_the_rows_under_the_target(spark, tmp_path):
    spark.range(10_000).selectExpr("id AS pixel_id", "id div 100 AS r", "id % 100 AS c", "CAST(id % 7 AS INT) AS cdl_id").write.parquet(f"{tmp_path}/src")
    src = spark.read.parquet(f"{tmp_path}/src")
    dst = spark.range(25).selectExpr("id AS pixel_id", "id div 5 AS r", "id % 5 AS c")
    out = C.resample_labels(src, dst, 0.5, 40, -1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(r,39)" in plan and "LessThanOrEqual(r,43)" in plan
    want = {(i, j): ((40 + int((i + 0.5) / 2)) * 100 + x) % 7 if (x := int(np.floor((j + 0.5) / 2 - 1))) >= 0 else 0 for i in range(5) for j in range(5)}
    assert {(r.r, r.c): r.cdl_id for r in out.collect()} == want
    assert C.resample_labels(src, dst.limit(0), 0.5).collect() == []

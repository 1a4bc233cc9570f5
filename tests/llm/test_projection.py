from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import projection, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows: list[tuple]) -> list[tuple]:
    """All pairs of rows."""
    units = []
    for _, v, label in rows:
        fine = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.abs(v).max() if fine else None)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            u, v = units[i], units[j]
            if u is not None and v is not None and rows[i][2] == rows[j][2] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[i].add(j), links[j].add(i)
    root = list(range(n))
    for start in range(n):
        if root[start] == start:
            open_ = [start]
            while open_:
                for k in links[open_.pop()]:
                    if root[k] != start:
                        root[k] = start
                        open_.append(k)
    least = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], len(links[i]), least[root[i]], rows[i][0] is not None and rows[i][0] == least[root[i]]) for i in range(n)), key=repr)


def near(rng, v: np.ndarray, cosine: float) -> np.ndarray:
    side = rng.normal(size=v.shape)
    side -= v * (side @ v) / (v @ v)
    return v * cosine + side * np.linalg.norm(v) / np.linalg.norm(side) * np.sqrt(1 - cosine**2)


def rows(n: int = 600) -> list[tuple]:
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, 64))
    out = [(i, v, i % 3) for i, v in enumerate(base)]
    out += [(10_000 + i, near(rng, base[i], c), i % 3) for i, c in enumerate(rng.uniform(0.97, 0.9999, 200))]
    hub = rng.normal(size=64)
    out += [(20_000 + i, near(rng, hub, 0.994) * rng.uniform(0.1, 9), 1) for i in range(220)]
    out += [(30_000 + i, base[5], 2) for i in range(50)] + [(40_000, base[5], 0), (40_001, base[5] * 2, None), (None, base[5], 2), (7, base[7], 1), (7, base[7], 1)]
    out = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in out]
    out += [(50_000, None, 1), (50_001, [], 1), (50_002, [0.0] * 64, 1), (50_003, [0.0] * 64, 1), (50_004, [None, 1.0], 1), (50_005, [float("nan")] * 64, 1), (50_006, [float("inf"), 1.0], 1)]
    out += [(50_007, [1e30, 1e-30], 1), (50_008, [1e-38, 0.0], 1), (50_009, [-0.0, 2.0], 1), (50_010, [0.0, 2.0], 1), (None, None, None)]
    return out


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_agrees_with_brute_force(spark, tmp_path):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).withColumns({"node": F.lit(1), "digest": F.lit("taken"), "v": F.lit(2)})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuples(queries.op12_vectors(spark, str(tmp_path))) == brute_force(given)


@pytest.mark.parametrize("block", [20, 70])
def test_blocks_of_large_groups(spark, block):
    given = rows(200)
    assert tuples(projection.near_duplicates(spark.createDataFrame(given, SCHEMA), block=block)) == brute_force(given)


def test_recall_at_the_limit(spark):
    """Pairs at a cosine of 0.98 to 0.982 that nothing else connects."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 64))
    pairs = [near(rng, v, c) for v, c in zip(base[:1000], rng.uniform(0.9801, 0.982, 1000), strict=True)]
    given = [(i, v.tolist(), 1) for i, v in enumerate([*base, *pairs])]
    found = projection.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").repartition(4))
    assert found.where("n_links > 0").count() >= 1990


def test_forest_connects_the_same_rows():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = 60
        i, j = np.sort(rng.integers(0, n, (2, rng.integers(0, 80))), axis=0)
        i, j = i[i < j], j[i < j]

        def labels(a, b):
            own = np.arange(n)
            for _ in range(n):
                for x, y in zip(a, b, strict=True):
                    own[x] = own[y] = min(own[x], own[y])
            return own.tolist()

        assert labels(*projection.forest(n, i, j)) == labels(i, j)
        assert len(projection.forest(n, i, j)[0]) < 2 * n


def test_empty_table_and_keeping(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert projection.near_duplicates(empty).collect() == []
    given = rows(200)
    kept = projection.deduplicate(spark.createDataFrame(given, SCHEMA).withColumn("_kept", F.lit(3)))
    assert kept.columns == ["vec_id", "embedding", "label", "_kept"]
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in brute_force(given) if r[3])

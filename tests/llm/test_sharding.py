from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import sharding


@pytest.mark.parametrize("n, piece", [(3, 16 << 20), (5, 4000), (24, 16 << 20)])
def test_shards_hold_every_row_once(docs, rows, n, piece):
    out = [r.asDict() for r in sharding.shard_by_bytes(docs, n, piece_bytes=piece).collect()]
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((a, b) for a, b, *_ in rows)
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sizes_are_near_equal_with_a_hot_group(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(6000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sizes = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8 + 2 * 70


def test_equal_texts_are_neighbours(spark):
    out = sharding.shard_by_bytes(spark.createDataFrame([(i, f"t{i % 7}") for i in range(700)], "doc_id long, text string"), 4)
    order = [r["text"] for r in out.orderBy("shard", "slot").collect()]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == 6


def test_boundaries_compare_both_halves():
    import numpy as np

    b = sharding.Boundaries([((5 << 64) + 3) << 64, (((5 << 64) + 9) << 64) + 256, ((7 << 64) + 1) << 64])
    high, low = np.array([4, 5, 5, 5, 6, 7, 7, 9, 5, 5], np.uint64), np.array([9, 2, 3, 10, 0, 0, 1, 0, 9, 9], np.uint64)
    assert b.place(high, low, np.array([0] * 8 + [255, 256], np.uint64)).tolist() == [0, 0, 1, 2, 2, 2, 3, 3, 1, 2]


def test_empty_and_clashing_columns(spark, empty):
    assert sharding.shard_by_bytes(empty, 24).collect() == []
    df = spark.createDataFrame([(1, None, 7, "a"), (2, "é", 8, "b")], "doc_id long, text string, size int, shard string")
    assert {(r.doc_id, r["size"], r["size_"], r["shard"]) for r in sharding.shard_by_bytes(df, 2).collect()} == {(1, 7, 8, "a"), (2, 8, 10, "b")}


@pytest.mark.parametrize("id_", [1, None, "a"])
def test_equal_rows_are_cut_too(spark, id_):
    df = spark.createDataFrame([(id_, "x" * 100)] * 5000, f"doc_id {'string' if id_ == 'a' else 'long'}, text string").repartition(4)
    by = sharding.shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert len(by) == 8 and max(r.s for r in by) - min(r.s for r in by) <= 3 * 108
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in by) and sum(r.n for r in by) == 5000


def test_pieces_follow_the_keys_and_split_hot_texts(spark, monkeypatch):
    """A third of the rows one text, a sixth one row: no piece holds much more than its share."""
    rows = [(7 if i % 6 == 0 else i, "x" * 40 if i % 3 == 0 else f"{i:040}") for i in range(6000)]
    df = spark.createDataFrame(rows, "_size long, _piece string").repartition(3)
    seen = []
    monkeypatch.setattr(sharding.Pieces, "share", lambda self, b, own=sharding.Pieces.share: (own(self, b), seen.append(self)))
    out = sharding.shard_by_bytes(df, 4, "_size", "_piece", piece_bytes=48 * 60)
    order = [tuple(r) for r in out.orderBy("shard", "slot").collect()]
    assert Counter(r[:2] for r in order) == Counter(rows) and out.columns == ["_size", "_piece", "size", "shard", "slot"]
    assert sum(a[1] != b[1] for a, b in zip(order, order[1:], strict=False)) == 4000
    import pyspark.sql.functions as f

    held = [r["count"] for r in out.groupBy(f.spark_partition_id()).count().collect()]
    assert seen[0].count.sum() > 80 and max(held) < 5 * 60


def test_query(spark, tmp_path, docs, rows):
    from fieldloom.llm.queries import op2_sharding

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in out) == Counter((a, zlib.crc32((b or "").encode())) for a, b, *_ in rows)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}

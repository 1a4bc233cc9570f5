from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight with a ceiling, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def size(text):
    return len(WORDS.findall(text or ""))


def sizes_of(rows):
    out = defaultdict(int)
    for _, t, _, s, _ in rows:
        out[s] += size(t)
    return dict(out)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 0}, {None: 50, "é": 5, "z": 500, "Z": 3}, {"a": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


@pytest.mark.parametrize("block", [7, 256])
def test_mix_meets_targets_word_for_word(docs, rows, block):
    out = [r.asDict() for r in M.mix(docs, block=block).collect()]
    assert sorted((r["doc_id"] or -1, r["size"], r["source"] or "") for r in out) == sorted((i or -1, size(t), s or "") for i, t, _, s, _ in rows)
    want, taken = targets(sizes_of(rows)), defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes_of(rows)[r["source"]]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert taken[s] == int(t + 0.5)


def test_reruns_and_partitions_agree(docs):
    key = lambda df: sorted(map(str, M.mix(df).collect()))
    assert key(docs) == key(docs.repartition(3)) == key(docs.coalesce(1))


def test_slots_take_each_block_once_a_pass(spark):
    t = spark.createDataFrame([("a", 0, 1000, 2300.0), ("b", 1, 50, 20.0), ("c", 2, 700, 700.0)], "source string, rank long, source_size long, target double")
    slots = M.slots(t, 100).collect()
    seen = defaultdict(list)
    for r in slots:
        seen[r.source, r["pass"]].append(r.block)
    assert sorted(seen["a", 0]) == sorted(seen["a", 1]) == list(range(10)) and len(set(seen["a", 2])) == 3
    assert seen["a", 0] != seen["a", 1] and seen["b", 0] == [0] and sorted(seen["c", 0]) == list(range(7))
    assert {s: sum(r.words for r in slots if r.source == s) for s in "abc"} == {"a": 2300, "b": 20, "c": 700}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000])
def test_permutations(spark, size):
    df = spark.range(size).select(*(M.permute(F.col("id"), F.lit(size).cast("long"), F.lit(k)).alias(f"k{k}") for k in range(3)))
    cols = list(zip(*df.collect(), strict=True))
    assert all(sorted(c) == list(range(size)) for c in cols)
    if size == 1000:
        assert len(set(cols)) == 3 and all(sum(abs(a - b) == 1 for a, b in zip(c, c[1:], strict=False)) < 10 for c in cols)


@pytest.mark.parametrize("size", [2**31, 10**12, 2**62])
def test_permutations_of_many(spark, size):
    got = [r[0] for r in spark.range(2000).select(M.permute(F.lit(size) - 1 - F.col("id"), F.lit(size), F.lit("x"))).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) < size // 100 and size - size // 100 < max(got) < size


def test_draws_follow_the_targets(spark):
    t = spark.createDataFrame([("a", 0, 2_000_000, 2_000_000.0), ("b", 1, 1_000_000, 1_000_000.0)], "source string, rank long, source_size long, target double")
    by, drawn = defaultdict(dict), M.shard_draws(t, 100).collect()
    for r in drawn:
        by[r.shard][r.source] = r.n
    assert len(by) == 8 and all(0.6 < d["a"] / (d["a"] + d["b"]) < 0.73 for d in by.values()) and len({d["a"] for d in by.values()}) > 4
    assert {s: sum(d[s] for d in by.values()) for s in "ab"} == {"a": 20_000, "b": 10_000}
    # the slots, and so the blocks, go where the draws say
    got = defaultdict(int)
    for r in M.slots(t, 100).collect():
        got[r.shard, r.source] += 1
    assert got == {(r.shard, r.source): r.n for r in drawn}


def test_words_go_to_the_shards_that_drew_them(docs):
    from unittest import mock

    one = {r.doc_id: r.shards for r in M.mix(docs, block=16).collect()}
    with mock.patch.object(M.slots, "__defaults__", (16, "mix", 20)), mock.patch.object(M.shard_draws, "__defaults__", (16, "mix", 20)):
        many = {r.doc_id: r.shards for r in M.mix(docs, block=16).collect()}
    assert {tuple(x) for x in one.values()} <= {(), (0,)} and len({s for x in many.values() for s in x}) > 20


def test_large_sources_do_not_overflow(spark):
    n = 10**13
    t = spark.createDataFrame([("a", 0, n, 1000.0)], "source string, rank long, source_size long, target double")
    got = M.slots(t, 256).collect()
    assert len(got) == 4 and len({r.block for r in got}) == 4 and max(r.block for r in got) > n // 256 // 1000


def test_documents_of_the_mix(docs, rows):
    out = M.mix_documents(docs.withColumn("_parts", F.lit(1)).withColumn("_id", F.lit(2)))
    assert out.columns == [*docs.columns, "_parts", "_id"]
    texts, taken = defaultdict(set), defaultdict(int)
    for i, t, *_ in rows:
        texts[i].add(t)
    for r in out.collect():
        taken[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
        assert r.text in texts[r.doc_id] or any(set(WORDS.findall(r.text)) <= set(WORDS.findall(t or "")) for t in texts[r.doc_id])
    assert dict(taken) == {s: int(t + 0.5) for s, t in targets(sizes_of(rows)).items() if t >= 0.5}


def test_empty_and_wordless(spark, empty):
    assert M.mix(empty).collect() == [] and M.mix_documents(empty).collect() == []
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.taken) for r in M.mix(df).collect()} == {(1, 0, 0), (2, 0, 0)}
    assert M.mix_documents(df).collect() == []

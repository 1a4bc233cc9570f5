from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import packing as P
from fieldloom.llm.queries import op7_packing, tokenizer_path

ODD = [
    "Hello  world\n\n  it's I'LL we've 42 x² ½ ªº ŉ",
    "tabs\t\tand \x1c\x1d odd \x85 spaces \xa0\xa0here",
    "naïve ÀÉ ß ˁ ʰ ˂ ÷×  日本語 \U0001f600 ﬁ Ǆ",
    " leading and trailing  ",
    "a" * 5000,
    "'s'S 's''ll 1'd",
    "",
    "​zero line　wide",
    "<|endoftext|> <|im_end|>",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers(reference):
    bpe, rng = P.ByteBpe(tokenizer_path()), random.Random(5)
    chars = "ab Zé1²½'\n\t \xa0\x85\x1c!?.ªßˁ×日s"
    for text in ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(1500)]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference(text), text


@pytest.mark.parametrize("seed", range(20))
def test_assignment_fills_the_least_number_of_sequences(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 200))]
    n, places = P.assign(lengths, 100)
    assert n == -(-sum(lengths) // 100)
    used = defaultdict(int)
    for want, pieces in zip(lengths, places, strict=True):
        assert sum(x for _, x in pieces) == want
        for s, x in pieces:
            used[s] += x
    assert max(used.values()) <= 100 and set(used) <= set(range(n))


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(10, 600) for _ in range(4000)]
    n, places = P.assign(lengths)
    costs = [0.0] * n
    for pieces in places:
        for s, x in pieces:
            costs[s] += P.cost(x)
    assert np.std(costs) < 0.15 * np.mean(costs)


def test_query_covers_every_id_once(spark, docs, rows, tmp_path, reference):
    docs.withColumn("start", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = op7_packing(spark, str(tmp_path)).collect()
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id].append((r.offset, r.length))
    waste = 0
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        waste += 2048 - at
    assert waste < 2048 * docs.sparkSession.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t or "")
    assert set(by_id) == set(texts)
    for i, own in texts.items():
        if len(own) > 1:
            assert sum(r.length for r in by_id[i]) == sum(len(reference(t)) + 1 for t in own)
            continue
        ids = np.array([*reference(own[0]), 1], "<u4")
        at = 0
        for r in sorted(by_id[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_small_groups_and_empty_table(docs, empty):
    many = P.pack(docs, tokenizer_path(), group_tokens=3000)
    assert many.agg(F.sum("length")).first()[0] == P.pack(docs, tokenizer_path()).agg(F.sum("length")).first()[0]
    assert P.pack(empty, tokenizer_path()).collect() == []


@pytest.mark.parametrize("mean", [4.0, 5.5, 6.5])
def test_each_item_goes_to_the_cheapest_of_all_with_room(mean):
    rng = random.Random(3)
    lengths = [min(2047, max(1, int(rng.lognormvariate(mean, 1)))) for _ in range(1500)]
    n, places = P.assign(lengths)
    room, costs = [P.CAPACITY] * n, [0.0] * n
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fits = [(costs[i], i) for i in range(n) if room[i] >= size]
        if not fits:
            assert len(places[item]) > 1
            continue
        i = min(fits)[1]
        assert places[item] == [(i, size)]
        room[i] -= size
        costs[i] += P.cost(size)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "\n" * 1_000_000 + "x", "日" + " " * 1_000_000 + "y"])
def test_long_runs_have_the_tokenizers_ids(reference, text):
    assert np.frombuffer(P.ByteBpe(tokenizer_path()).encode(text), "<u4").tolist() == reference(text)


def test_ids_of_every_document_are_the_tokenizers(spark, reference):
    bpe = P.ByteBpe(tokenizer_path())
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert np.frombuffer(bpe.encode(r.text or ""), "<u4").tolist() == reference(r.text or "")


def test_string_ids_are_an_error(spark):
    with pytest.raises(TypeError):
        P.pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"), tokenizer_path())

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.components import components


def plain(text):
    """The fingerprint bit by bit."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least index reachable over all pairs within two bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a B", "One two THREE", "É À four five six seven\x0beight", "x " * 3000])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain(text)


def check(found, ids, prints):
    roots = classes(prints)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{p:016x}", least.get(r)) for i, p, r in zip(ids, prints, roots, strict=True))
    assert Counter((r[0], r[1], r[2]) for r in found) == want


def test_near_duplicates_against_all_pairs(docs, rows):
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    check(found, [r[0] for r in rows], [plain(r[1]) for r in rows])


def near_prints(n, seed):
    """Clouds of fingerprints around a few centres, dense in shared segments."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            p ^= 1 << rng.choice((rng.randrange(32), rng.randrange(64)))
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("dense", [1, 4, 32, 10_000])
def test_dense_entries_lose_no_link(spark, dense):
    prints = near_prints(500, dense)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df, dense)
    pairs = edges.collect()
    for a, b in pairs:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    got = {r.node: r.root for r in components(edges).collect()}
    roots = classes(prints)
    size = Counter(roots)
    for i, r in enumerate(roots):
        assert (signed[i] in got) == (size[r] > 1)
        if size[r] > 1:
            assert got[signed[i]] == got[signed[r]]
    assert len({got[s] for s in signed if s in got}) == sum(n > 1 for n in size.values())


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and got[0] != got[1000]


def test_deduplicate_keeps_one_of_each_group(spark, docs, rows):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = classes([plain(r[1]) for r in rows])
    assert kept.count() == len(set(groups))
    again = simhash.near_duplicates(kept).groupBy("class_fingerprint").count().where("count > 1")
    assert again.isEmpty()


def test_an_id_of_two_texts_keeps_only_heads(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "other words here")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicate(df).collect())) == [(3, a), (5, b), (9, "other words here")]


def test_empty_and_clashing_columns(spark, empty, docs):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.deduplicate(empty).collect() == []
    odd = docs.withColumn("_id", F.lit(1)).withColumn("_fp_hex", F.lit("x")).withColumn("fingerprint", F.lit(2))
    assert simhash.deduplicate(odd).columns == odd.columns


def test_rows_of_frequent_fingerprints_are_split(spark, docs, monkeypatch):
    want = sorted(map(repr, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "COPIES", 10)
    assert sorted(map(repr, simhash.near_duplicates(docs).collect())) == want

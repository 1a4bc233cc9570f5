"""The registered queries on a small table, against versions that share no code with the operators."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest
import xxhash

from fieldloom.llm import queries
from tests.llm.test_mixing import size, sizes_of, targets
from tests.llm.test_simhash import classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def bits(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_op1(spark, folder, rows):
    out = queries.op1_quality(spark, folder).collect()
    assert len(out) == len(rows) and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 and r.keep == (r.tail >= 0.7) for r in out)
    assert sorted(map(str, out)) == sorted(map(str, queries.op1_quality(spark, folder).collect()))


def test_grades_are_ordered_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    from fieldloom.llm import quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rated = quality.classify(docs.join(labels, "doc_id", "left_semi"), labels.where(~held)).join(quality.grades_of_labels(labels.where(held)), "doc_id")
    by = {r.grade: r for r in rated.groupBy("grade").agg(F.avg("quality.expected_grade").alias("e"), F.avg(F.col("keep").cast("double")).alias("kept")).collect()}
    assert by[0].e < by[1].e - 0.1 < by[2].e - 0.5
    assert by[2].kept > 0.96 and by[1].kept < 0.25 and by[0].kept < 0.2


def test_op3(spark, folder, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [bits(t) for _, t, *_ in order]
    want = sorted(str((r[0], f"{p:016x}", order[k][0])) for r, p, k in zip(order, prints, classes(prints), strict=True))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in queries.op3_simhash(spark, folder).collect()) == want


def test_op4(spark, folder, rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))

    def sets(text):
        w = [x.lower() for x in text.split()]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want, exact = [], {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        a, b, c = sets(t), sets(e), sets(n)
        j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append(str((i, len(t), hashlib.sha256(e.encode()).hexdigest())))
        exact[i, len(t)] = (j(a, b), j(a, c), len(a))
    got = queries.op4_sketch(spark, folder).collect()
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(want)
    large = [(r, exact[r.doc_id, r.n_chars]) for r in got if exact[r.doc_id, r.n_chars][2] > 300]
    assert len(large) > 10 and all(abs(r.near_edited - x) < 0.15 and abs(r.near_next - y) < 0.15 for r, (x, y, _) in large)


def test_op10(spark, folder, rows):
    out = queries.op10_mixing(spark, folder).collect()
    want, taken = targets(sizes_of(rows)), defaultdict(int)
    assert sorted(str((r.doc_id, r["size"], r.source)) for r in out) == sorted(str((i, size(t), s)) for i, t, _, s, _ in rows)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.target == pytest.approx(want[r.source]) and (r.taken > 0) == bool(r.shards)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


def test_op8_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op8_chat"]).df()
    got = queries.op8_chat(spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = list(got.columns)
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from fieldloom.llm.tables import materialise, read

    docs, out = read(spark, ROOT, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = materialise(stage(spark, docs, ROOT))
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, *_ in steps] == ["quality", "near-duplicates", "pii", "mixing", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert not after.where("n_chars <> length(text)").count()


def test_quality_rejects_bad_and_keeps_good_documents(spark, steps):
    kept = {r[0] for r in steps[0][2].select("doc_id").collect()}
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0 or r.toxic == 1]
    assert sum(i in kept for i in good) / len(good) > 0.97 and sum(i in kept for i in bad) / len(bad) < 0.4


def test_near_duplicates_leave_one_of_each_class(steps):
    from tests.llm.test_resemblance import classes

    _, before, after = steps[1]
    rows = sorted((r.doc_id, r.text) for r in before.select("doc_id", "text").collect())
    heads = {rows[i][0] for i in classes([t for _, t in rows])}
    assert {r[0] for r in after.select("doc_id").collect()} == heads


def test_pii_is_gone_and_the_rest_stays(steps):
    from fieldloom.llm.pii import find, redact_text

    before = {r.doc_id: r.text for r in steps[2][1].collect()}
    after = {r.doc_id: r.text for r in steps[2][2].collect()}
    assert after == {i: redact_text(t, find(t)) for i, t in before.items()}


def test_mix_meets_its_targets(steps):
    from tests.llm.test_mixing import size, targets

    sizes, taken = Counter(), Counter()
    for r in steps[3][1].collect():
        sizes[r.source] += size(r.text)
    for r in steps[3][2].collect():
        taken[r.source] += size(r.text)
    assert dict(taken) == {s: int(t + 0.5) for s, t in targets(dict(sizes)).items()}


def pieces_whole(texts, packed):
    """Whether the pieces, put together, are the ids of the texts, and sequences have neither gaps nor more than 2048."""
    from tokenizers import Tokenizer

    from fieldloom.llm.queries import tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, got = Counter(), Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, len(ids), at, x) for at, x in enumerate(ids))
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        got.update((r.doc_id, r.doc_tokens, r.start + at, x) for at, x in enumerate(ids))
    assert got == want
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = [a + n for a, n in sorted(p)]
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return True


def test_packing_covers_the_mix(spark, steps):
    assert pieces_whole([(r.doc_id, r.text) for r in steps[4][1].collect()], steps[4][2].collect())
    assert corpus_pipeline.run(spark, ROOT).columns == steps[4][2].columns


def test_awkward_rows_and_clashing_columns(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and names that the stages use, in every stage; then a table without rows."""
    names = ("quality", "keep", "_fp", "fingerprint", "size", "shard", "start", "pii", "words", "block")
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    for folder, rows in (("some", docs), ("none", empty)):
        for n in names:
            rows = rows.withColumn(n, F.lit("own"))
        rows.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, rows, f"{tmp_path}/{folder}")
            assert made.columns == rows.columns
            assert not made.where(" or ".join(f"{n} <> 'own'" for n in names)).count()
            assert (made.count() == 0) == (folder == "none")
        out = corpus_pipeline.STAGES[-1][1](spark, rows, f"{tmp_path}/{folder}").collect()
        assert pieces_whole([(r.doc_id, r.text) for r in rows.collect()], out)

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from fieldloom.llm import sketch as S


def test_sketch_keeps_every_hash_below_the_threshold():
    text = " ".join(f"Word{i}" for i in range(3000))
    full, part = S.sketch(text, scale=1), S.sketch(text)
    assert len(full) == 2997 and full[0] == full[1] == part[0]
    assert list(part[1:]) == [h for h in full[1:] if int(h) < (1 << 64) // S.SCALE]
    assert abs(len(part) / len(full) - 1 / S.SCALE) < 0.03
    assert (S.decode(S.encode(part)) == part).all()


def test_containment_of_unequal_texts_and_merging():
    words = [f"w{i}" for i in range(20_000)]
    long, short = " ".join(words), " ".join(words[5000:5800])
    assert S.containment(S.sketch(short), S.sketch(long)) == 1.0
    assert S.jaccard(S.sketch(short), S.sketch(long)) < 0.06
    half = S.merge(S.sketch(" ".join(words[:10_000])), S.sketch(" ".join(words[9996:])))
    assert (half == S.sketch(long)).all()
    tiny = S.sketch("a b c")
    assert len(S.merge(tiny, S.sketch(long))) in (len(S.sketch(long)), len(S.sketch(long)) + 1)


def test_contained_short_texts_never_get_zero():
    words = [f"w{i}" for i in range(2000)]
    long = S.sketch(" ".join(words))
    got = [S.containment(S.sketch(" ".join(words[i : i + 8])), long) for i in range(0, 1900, 9)]
    assert set(got) == {1.0, None} and sum(x == 1.0 for x in got) > 100


def test_likeness_is_near_the_exact_one(spark):
    def exact(a, b):
        x, y = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in (a.lower().split(), b.lower().split()))
        return len(x & y) / len(x | y) if x | y else 1.0

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    off = []
    for a, b in zip(texts, texts[1:] + texts[:1], strict=True):
        e = S.edited_text(a, b)
        off.append(abs(S.jaccard(S.sketch(a), S.sketch(e)) - exact(a, e)))
    assert np.mean(off) < 0.06, np.mean(off)


def test_empty_texts():
    assert len(S.sketch(None)) == len(S.sketch(" \n")) == 0
    assert S.jaccard(S.sketch(""), S.sketch("")) == 1.0 and S.jaccard(S.sketch("a"), S.sketch("")) == 0.0


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 3000])
def test_edits_against_a_loop(docs, rows, bucket_bytes, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(S.with_next, "__defaults__", (bucket_bytes,))
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = S.edited_text(t, n)
        a, b, c = S.sketch(t), S.sketch(e), S.sketch(n)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), S.encode(a), S.encode(b), round(S.jaccard(a, b), 9), round(S.jaccard(a, c), 9)))
    got = S.sketch_with_edits(docs).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(want, key=key)


def test_one_row_empty_table_and_extra_columns(spark, empty):
    assert S.sketch_with_edits(empty).collect() == []
    one = S.sketch_with_edits(spark.createDataFrame([(1, "abcdefgh", 3, 4)], "doc_id long, text string, _id int, _bucket int")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0


def test_edited_texts_are_likelier_than_next_ones(docs):
    rows = [r for r in S.sketch_with_edits(docs).collect() if r.n_chars > 500 and (r.doc_id or 999) < 60]
    assert np.mean([r.near_edited for r in rows]) > 0.4 > 0.35 > np.mean([r.near_next for r in rows])

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    """The base spans as the patterns say."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def found(text):
    return [(k, s, e) for k, s, e, _ in pii.find(text) if k in pii.KINDS[:4]]


SAMPLES = [
    "write to a.b+c@mail.example.org, b@c.d@e.f.g or @x.y, q@-.-.- a@b a@b. é@x.de",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004 1.2.3 10.0.0.255.9",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 5500005555555559 12345678901234",
    "+1 (555) 010-9999 +49 30 123456 +1-2 +12345678901234567 + 3 +4(5)6.7-8 9012",
    "\U0001f600 tel +33 1 23 45 67 89; 192.168.0.1; x@y.zz",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans(text):
    assert found(text) == base(text)


def test_random_texts():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("01259 .-+@ab()%_é 4111") for _ in range(rng.randrange(60)))
        assert found(text) == base(text), text


def test_iban_and_context():
    spans = pii.find("Konto DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432, DE89 3704 0044 0532 0130 01")
    ibans = [(s, e, x) for k, s, e, x in spans if k == "iban"]
    assert len(ibans) == 2 and ibans[0][2] == 1.0
    assert [pii.find(f"DE89 3704 0044 0532 0130 00{x}")[0][1:3] for x in ("", " OK", " BANK NOW")] == [(0, 27)] * 3


def test_context_counts_whole_words_by_distance_and_lowers_too():
    score = lambda t: pii.find(t)[0][3]
    plain = score("zzz +1 555 010 9999")
    assert score("call +1 555 010 9999") > score("call me, if you like, at +1 555 010 9999") > plain > score("order +1 555 010 9999")
    assert score("see the ship at 10.0.0.1") == score("see the boat at 10.0.0.1") < score("see the ip 10.0.0.1")
    assert score("hotel +1 555 010 9999") == plain


def test_context_decides_added_kinds():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds(f'token = "{key}" x') == ["secret"] and kinds(f"commit {key} x") == kinds(f"so {key} x") == []
    assert kinds("order DE89370400440532013000") == [] and kinds("DE89370400440532013000") == ["iban"]
    assert kinds("token abcdefghijklmnopqrstuvwxyz") == [] and kinds(f"key: a.b@{key}.org") == ["email"]


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1." * 150_000, "9" * 300_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 150_000, "AB12 " + "A" * 300_000, "AB12" * 80_000, "key " + "a1" * 150_000, "a-" * 150_000, "token " * 50_000])
def test_long_runs_take_linear_time(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 5


def test_columns(spark, docs, rows, empty):
    df = spark.createDataFrame([(1, SAMPLES[0]), (2, None), (3, ""), (1, SAMPLES[0])], "doc_id long, text string").withColumn("pii", F.lit(1))
    got = [(r.doc_id, [tuple(s)[:3] for s in r["pii_"]]) for r in pii.with_spans(df).orderBy("doc_id").collect()]
    assert got[0] == got[1] == (1, base(SAMPLES[0])) and got[2][1] == got[3][1] == []
    assert pii.with_spans(empty).collect() == []


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd or 4111 1111 1111 1111.", 0), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact_documents(df).collect()}
    assert got == {1: ("mail [EMAIL] or [CARD].", 23), 2: (None, None), 3: ("clean", 5)}


def test_query(spark, tmp_path, docs, rows):
    import hashlib

    from fieldloom.llm.queries import op9_pii

    some = spark.createDataFrame([(i, t) for i, t in enumerate([*SAMPLES, None, "", "IBAN DE89370400440532013000"])], "doc_id long, text string")
    some.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_pii(spark, str(tmp_path)).collect():
        text = [*SAMPLES, "", "", "IBAN DE89370400440532013000"][r.doc_id]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base(text))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base(text)) for k in pii.KINDS[:4])
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.find(text))


SHAPES = ("token = \"{}\"", "token: {}", "api_key={}", "API_KEY={}", "AWS_SECRET_ACCESS_KEY={}", "export DB_PASSWORD='{}'", "\"accessToken\": \"{}\"", "password={};", "Authorization: Bearer {}", "clé : {}", "?key={}&page=2")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.mark.parametrize("shape", SHAPES)
def test_recall_of_secrets_by_shape(shape):
    rng = random.Random(shape)
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(100) for alphabet, n in (("0123456789abcdef", 40), (LETTERS, 32), (LETTERS, 20))]
    caught = sum(any(x[0] == "secret" and t[x[1] : x[2]] == k for x in pii.find(t)) for k in keys for t in [f"lorem ipsum {shape.format(k)} dolor"])
    assert caught >= 0.95 * len(keys)


def test_windows_do_not_cut_words():
    for gap in range(60):
        blanks = " " * gap
        assert pii.find(f"discard{blanks} 4111 1111 1111 1111")[0][3] == pii.find(f"the{blanks} 4111 1111 1111 1111")[0][3]
        assert pii.find(f"monkey{blanks} 04dbebab91ab85687d33eeaaf9ac699e1188f962") == []
        assert pii.find(f"4111 1111 1111 1111 {blanks}cardinal")[0][3] == pii.find("4111 1111 1111 1111")[0][3]
    assert pii.find("key " + "a" * 60 + "1234567890" + "b" * 10)[0][0] == "secret", "the first digit may come late"

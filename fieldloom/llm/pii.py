"""Personal data in texts: proposed by pattern, confirmed by checksum, scored by context.

Kinds: email, ip (four parts up to 255), card (14 to 19 digits, Luhn), phone
(+, 10 to 15 digits), and beyond those iban (mod 97) and secret (a word of 16 or
more letters and digits, at least an eighth of them digits or in both cases, that looks like a key). Matches of a kind are the
leftmost ones that don't overlap; one that fails its check is dropped. Every
span has a score: a base for its kind, raised or lowered by whole words that
stand near it, the nearer the more. Spans of the first four kinds are kept
whatever their score; the added kinds need ``MIN_ADDED``, so context decides. All
scans take time linear in the text, however long its runs of digits or letters.
Offsets count code points.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import fresh

# Fixed values of the base patterns, and the order of kinds at equal starts
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?>[0-9]+(?:\.[0-9]+)*)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# A word that looks like a key; its context decides
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
# Whole words that speak for or against a kind nearby, in the languages of the corpus
CONTEXT = {
    "email": (frozenset("mail email e-mail contact kontakt correo courriel write reach".split()), frozenset("example sample".split())),
    "ip": (frozenset("ip host server address serveur servidor adresse dirección".split()), frozenset("version release section chapter kapitel capítulo chapitre".split())),
    "card": (frozenset("card visa mastercard karte carte tarjeta credit pay paid kreditkarte".split()), frozenset("order invoice isbn serial bestellung commande pedido".split())),
    "phone": (frozenset("phone call tel fax mobile telefon teléfono téléphone handy".split()), frozenset("order invoice isbn serial bestellung commande pedido".split())),
    "iban": (frozenset("iban bank account konto compte cuenta bic".split()), frozenset("order invoice isbn serial bestellung commande pedido".split())),
    "secret": (frozenset("token key secret password passwort apikey api_key access_key secret_key auth credential bearer clave contraseña clé".split()), frozenset("commit hash checksum sha1 sha256 md5 revision digest".split())),
}
WORDS = re.compile(r"[^\W\d](?:[\w-]*\w)?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WINDOW = 40
WEIGHT = 0.4
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "secret": 0.3}
MIN_ADDED = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
            at = text.find("@", free)
        else:
            free, at = max(free, at + 1), text.find("@", at + 1)


def _ips(text: str):
    for m in DOTTED.finditer(text):  # whole dotted runs; four parts at a time are a match
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _cards(text: str):
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    free = 0
    for m in IBAN.finditer(text):
        start = m.start()
        if start < free:
            continue
        at = [i for i in range(start, m.end()) if text[i] != " "]
        for n in range(len(at), 14, -1):  # words in capitals may follow; the longest that passes is the number
            end = at[n - 1] + 1
            if not text[end : end + 1].isalnum() and mod97(text[start:end].replace(" ", "")):
                yield start, end
                free = end
                break


def _secrets(text: str):
    for m in SECRET.finditer(text):
        word = m.group()
        digits = sum(map(str.isdigit, word))
        mixed = digits and any(map(str.isupper, word)) and any(map(str.islower, word))
        if (mixed or digits * 8 >= len(word)) and any(map(str.isalpha, word)):
            yield m.span()


def _names(word: str) -> set[str]:
    """A word, and the parts of a compound name such as ``AWS_SECRET_KEY`` or ``accessToken``; all in lower case."""
    return {word.lower(), *(p.lower() for p in PARTS.findall(word))} if "_" in word or not (word.islower() or word[1:].islower()) else {word.lower()}


def context(text: str, kind: str, start: int, end: int) -> float:
    """From -1 to 1: the nearest word that speaks for the kind less the nearest that speaks against it.

    Words count whose nearer end is less than ``WINDOW`` characters away, and
    only whole: one that even twice the window cuts is longer than any of ``CONTEXT``.
    """
    found = [0.0, 0.0]
    low, high = max(0, start - 2 * WINDOW), min(len(text), end + 2 * WINDOW)
    for a, b, near in ((low, start, True), (end, high, False)):
        side = text[a:b]
        for m in WORDS.finditer(side):
            gap = len(side) - m.end() if near else m.start()
            cut = (near and m.start() == 0 and a > 0 and _in_word(text[a - 1])) or (not near and m.end() == len(side) and b < len(text) and _in_word(text[b]))
            if gap < WINDOW and not cut:
                names = _names(m.group())
                for i in (0, 1):
                    if not names.isdisjoint(CONTEXT[kind][i]):
                        found[i] = max(found[i], 1 - gap / (2 * WINDOW))
    return found[0] - found[1]


def _in_word(c: str) -> bool:
    return c.isalnum() or c in "_-"


_FINDERS = {"email": ("@", _emails), "ip": (".", _ips), "card": ("", _cards), "phone": ("+", _phones), "iban": ("", _ibans), "secret": ("", _secrets)}


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of ``KINDS``.

    The score is the kind's base plus ``WEIGHT`` times :func:`context`, within 0
    and 1. Spans of the added kinds below ``MIN_ADDED`` are left out, and so are
    secrets that overlap another span.
    """
    if not text:
        return []
    out = []
    for order, kind in enumerate(KINDS):
        needs, finder = _FINDERS[kind]
        if needs and needs not in text:
            continue
        for start, end in finder(text):
            score = min(1.0, max(0.0, BASE_SCORE[kind] + WEIGHT * context(text, kind, start, end)))
            if order < 4 or score >= MIN_ADDED:
                out.append((start, order, end, round(score, 6)))
    if any(o == 5 for _, o, *_ in out):
        taken = sorted((s, e) for s, o, e, _ in out if o < 5)
        ends = list(itertools.accumulate((e for _, e in taken), max))
        out = [x for x in out if x[1] < 5 or (i := bisect.bisect_left(taken, (x[2],))) == 0 or ends[i - 1] <= x[0]]
    return [(KINDS[o], s, e, x) for s, o, e, x in sorted(out)]


def redact_text(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each stretch of overlapping spans gives way to its first span's kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` plus the spans of each text; none for a null or empty one. Repeated rows get equal spans."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find(t.as_py())] for t in texts], ARROW_SPANS)

    return docs.withColumn(fresh(docs, name), spans(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """``docs`` with spans of ``min_score`` or more replaced by their kind, such as ``[EMAIL]``. Null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            spans = [x for x in find(t) if x[3] >= min_score]
            return redact_text(t, spans) if spans else t

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`redact`, with ``n_chars`` counted anew where there is such a column; the columns of ``docs``."""
    out = redact(docs, text_col)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*docs.columns)

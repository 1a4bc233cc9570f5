"""Language identification by cross-parsing entropy.

From a bounded sample of labelled text, a suffix automaton is built for every
language. A text is cut greedily into the longest phrases that occur in a
language's sample (a symbol that doesn't occur there begins the phrase after
it); with ``c`` phrases over ``n`` symbols and a sample of ``m``
symbols its cost is ``c log2(m) / n`` bits a symbol. The language of the least
cost wins (ties: the first by name).

An automaton has a column of its table for each of the ``COMMON`` most frequent
letters of all samples; transitions by other letters, of which large alphabets
have thousands, are kept as sorted pairs and searched.

Texts are parsed side by side: one step moves every unfinished text by one
symbol in the automata of all languages, as array lookups. The few longest
texts are finished one by one.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.tables import fresh, materialise

SAMPLE_CHARS = 32_000  # of each language
TOTAL_CHARS = 1_000_000  # of all languages together; their automata then take less than 1 GB
COMMON = 120
DOC_CHARS = 8_000  # of each text at most
SALTS = 256  # parts of a language that are sorted apart
ALONE = 64  # texts left when the rest is parsed one by one
TOGETHER = 12_000_000  # characters parsed side by side


class Automata:
    """The suffix automata of all languages in one table: state x symbol -> state, or -1."""

    def __init__(self, samples: dict[str, list[str]], common: int = COMMON):
        self.langs = sorted(samples)
        seen = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        # symbol 0: no letter; the letters of the samples; one for any other letter; one between texts
        self.n_symbols = len(letters) + 3
        own = {c: i + 1 for i, c in enumerate(letters)}
        other = len(letters) + 1
        self.width = min(common, len(letters)) + 1  # symbols from here on are searched
        table = np.zeros(0x110000, np.int32 if self.n_symbols > 0xFFFF else np.uint16)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                table[code] = own.get(c.lower(), other)
        self.table = table
        parts, roots, sizes, rare = [], [], [], {}
        base = 0
        for lang in self.langs:
            joined: list[int] = []
            for t in samples[lang]:
                joined += [*self.symbols(t).tolist(), other + 1]
            grown = self._suffix_automaton(joined)
            dense = np.full((len(grown), self.width), -1, np.int32)
            for s, edges in enumerate(grown):
                for c, to in edges.items():
                    if c < self.width:
                        dense[s, c] = base + to
                    else:
                        rare[(base + s) * self.n_symbols + c] = base + to
            roots.append(base)
            base += len(grown)
            parts.append(dense)
            sizes.append(max(2, len(joined)))
        self.next = np.concatenate(parts).ravel() if parts else np.empty(0, np.int32)
        self.rare = rare
        self.rare_at = np.array(sorted(rare), np.int64)
        self.rare_to = np.array([rare[k] for k in self.rare_at.tolist()], np.int32)
        self.roots = np.array(roots, np.int32 if len(self.next) < 1 << 31 else np.int64)
        self.bits = np.log2(sizes)
        every = np.arange(self.n_symbols)
        start = np.stack([self.step(np.full(self.n_symbols, r, self.roots.dtype)[None, :], every)[0] for r in self.roots]) if roots else np.empty((0, self.n_symbols), np.int32)
        self.restart = np.where(start < 0, self.roots[:, None], start).astype(self.roots.dtype)
        self.known = start >= 0

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next state, or -1, of each state (languages x texts) by its text's symbol."""
        plain = symbols < self.width
        if plain.all():
            return self.next[states * self.width + symbols]
        to = self.next[states * self.width + np.where(plain, symbols, 0)]
        at = np.flatnonzero(~plain)
        to[:, at] = -1
        if len(self.rare_at):
            key = states[:, at].astype(np.int64) * self.n_symbols + symbols[at]
            i = np.minimum(np.searchsorted(self.rare_at, key), len(self.rare_at) - 1)
            to[:, at] = np.where(self.rare_at[i] == key, self.rare_to[i], -1)
        return to

    def symbols(self, text: str) -> np.ndarray:
        """Runs of what isn't a letter count once."""
        s = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        return s[(s > 0) | np.concatenate([[1], s[:-1]]).astype(bool)] if len(s) else s

    @staticmethod
    def _suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
        edges, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            new, p = len(edges), last
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[q] != length[p] + 1:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = copy
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    q = copy
                link[new] = q
            last = new
        return edges

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language (languages x texts)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lens = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if order else np.empty(0, np.uint16)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if order else lens
        # every miss begins a phrase, and so does a first symbol that isn't one
        first = np.array([texts[i][0] if len(texts[i]) else 0 for i in order], np.int32)
        count = self.known[:, first].astype(np.int32)
        state = np.repeat(self.roots[:, None], len(order), axis=1)
        live, step = int((lens > 0).sum()), 0
        while live > ALONE:
            c = flat[starts[:live] + step].astype(self.roots.dtype)
            here = state[:, :live]
            to = self.step(here, c)
            miss = to < 0
            count[:, :live] += miss
            np.copyto(here, np.where(miss, self.restart[:, c], to))
            step += 1
            while live and lens[live - 1] <= step:
                live -= 1
        if live:
            table, rare, width, every = memoryview(self.next), self.rare, self.width, self.n_symbols
            for k in range(live):
                rest = flat[starts[k] + step : starts[k] + lens[k]].tolist()
                for j in range(len(self.langs)):
                    s, n, restart = int(state[j, k]), 0, self.restart[j].tolist()
                    for c in rest:
                        s = table[s * width + c] if c < width else rare.get(s * every + c, -1)
                        if s < 0:
                            n += 1
                            s = restart[c]
                    count[j, k] += n
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known: dict[str, int] = {}
        for t in texts:
            if t is not None and t not in known and any(map(str.isalpha, t)):
                known[t] = len(known)
        if not known or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        parts, group, held = [], [], 0
        for t in [*known, None]:
            if t is not None:
                group.append(self.symbols(t))
                held += len(t)
            if group and (t is None or held >= TOGETHER):
                parts.append(self.phrases(group) * self.bits[:, None] / np.array([max(1, len(c)) for c in group]))
                group, held = [], 0
        bits = np.concatenate(parts, axis=1)
        best = bits.argmin(axis=0)
        ranked = np.sort(bits, axis=0)
        margin = 1 - ranked[0] / ranked[1] if len(ranked) > 1 else np.ones(bits.shape[1])
        at = [known.get(t, -1) if t is not None else -1 for t in texts]
        return [self.langs[best[i]] if i >= 0 else "und" for i in at], np.array([min(1.0, max(0.0, float(margin[i]))) if i >= 0 else 0.0 for i in at])


_BUILT: dict[str, Automata] = {}


def _built(key: str, samples: dict[str, list[str]]) -> Automata:
    """Once for each Python worker and call of :func:`identify`."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automata(samples)
    return _BUILT[key]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def draw_samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, list[str]]:
    """Texts of each language in the order of a hash of text, until ``sample_chars`` are reached.

    More than ``total_chars / sample_chars`` languages (31) share ``total_chars``
    alike, whatever their number, so the sample is bounded by both parameters. Of a text over ``DOC_CHARS``, or a
    language's share where that is less, so many symbols from its first letter on are taken. Copies count once: they are gathered first. Then each
    of ``SALTS`` parts of a language gives its own first texts, and the sample is drawn
    from those.
    """
    text = F.col(text_col)
    fit = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    n_langs = docs.where(~held_out(id_col)).select(lang_col).where(F.col(lang_col).isNotNull()).distinct().count()
    sample_chars = max(1, min(sample_chars, total_chars // max(1, n_langs)))
    longest = min(DOC_CHARS, sample_chars)
    piece = F.when(F.length(text) <= longest, text).otherwise(F.substring(F.regexp_replace(text, r"^\P{L}+", ""), 1, longest))
    texts = fit.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), piece.alias("t"))
    distinct = materialise(texts.groupBy("lang", "h").agg(F.max(F.length("t")).alias("n")))

    def first(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("h")) - F.col("n")).where(F.col("before") < sample_chars)

    salted = first(distinct.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS))), "lang", "salt")
    chosen = materialise(first(salted, "lang").select("lang", "h"))
    rows = texts.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("t").alias("t")).collect()  # bounded: see above
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_id``: struct<lang_pred string, score double>.

    ``score`` is how far the best language's cost lies below the second's, 0 to
    1. A null text or one without a letter is ``und`` with the score 0, and so
    is every text where no language was learned.
    """

    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(samples)  # bounded: see draw_samples

    @F.pandas_udf("struct<lang_pred string, score double>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        model = _built(key, sent.value)
        langs, scores = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(fresh(docs, "lang_id"), parse(F.col(text_col)))

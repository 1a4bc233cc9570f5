"""Quality classifier: ordinal cumulative-link regression on hashed text.

The model is ``P(grade <= k) = sigmoid(threshold_k - w . x)``: one weight
vector over hashed text shared by all grades, and ordered thresholds. ``x``
holds a text's distinct lower-cased words and word shapes and a few coarse
counts (share of repeated words, of capitals, of symbols, of repeated lines),
each hashed to one of ``n_features`` slots; every slot that occurs has the
value ``nnz ** -0.25``.

The fit maximises the exact cumulative-link likelihood with an L2 penalty on
the weights. Each step is one Spark job over the written feature table: every
task returns the gradient of its rows, and the driver adds one such vector per
task. The number of labelled rows is bounded by ``max_fit_rows``; prediction
covers every row.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import fresh, materialise

N_FEATURES = 1 << 18
MAX_FIT_ROWS = 20_000
FIT_TASKS = 6
MIN_TAIL = 0.7  # most rows are good, so a text is kept only where that is rather sure
CACHE = 50_000

_SYMBOL = re.compile(r"[^\w\s]")
_SHAPES = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+")


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # increasing, one fewer than the grades

    @property
    def n_grades(self) -> int:
        return len(self.thresholds) + 1


def _word_slots(word: str, n: int) -> tuple[int, ...]:
    low = zlib.crc32(word.lower().encode("utf-8", "replace")) % n
    if word.isalpha() and not (word.isupper() and len(word) > 1):
        return (low,)
    # words with symbols or in capitals also count by shape and without symbols
    shape = _RUN.sub(r"\1", word.translate(_SHAPES))[:12]
    bare = _SYMBOL.sub("", word.lower())
    return (low, zlib.crc32(b"s:" + shape.encode("utf-8", "replace")) % n, zlib.crc32(bare.encode("utf-8", "replace")) % n)


class Hasher:
    """A text's distinct feature slots. Words seen before are looked up."""

    def __init__(self, n: int):
        self.n, self.seen = n, {}

    def slots(self, text: str | None) -> np.ndarray:
        """Empty for a null text or one without words."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32)
        distinct, seen, out = set(words), self.seen, set()
        if len(seen) > CACHE:
            seen.clear()
        for w in distinct:
            s = seen.get(w)
            if s is None:
                s = seen[w] = _word_slots(w, self.n)
            out.update(s)
        n_words, n_chars = len(words), len(text)
        lines = text.split("\n")
        capitals = sum(map(str.isupper, words)) / n_words
        symbols = len(_SYMBOL.findall(text)) / n_chars
        coarse = (
            f"t:{int(16 * len(distinct) / n_words)}:{min(5, n_words.bit_length() // 2)}",
            f"c:{int(10 * capitals)}",
            f"y:{min(12, int(40 * symbols))}",
            f"l:{int(5 * (1 - len(set(lines)) / len(lines)))}",
            f"w:{min(12, int(n_chars / n_words))}",
        )
        out.update(zlib.crc32(x.encode()) % self.n for x in coarse)
        return np.fromiter(out, np.int32, len(out))


def _probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Rows by grade."""
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -500, 500)))
    edges = np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))])
    return np.diff(edges, axis=1)


def _loss_gradient(slots, sizes, grades, weights, thresholds):
    """Negative log likelihood of some rows, and its gradient by weight and by threshold."""
    value = sizes.clip(1) ** -0.25
    row = np.repeat(np.arange(len(sizes)), sizes)
    score = value * np.bincount(row, weights[slots], len(sizes))
    k = len(thresholds)
    cdf = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -500, 500)))
    edges = np.hstack([np.zeros((len(score), 1)), cdf, np.ones((len(score), 1))])
    density = edges * (1 - edges)
    at = np.arange(len(score))
    p = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-12)
    upper, lower = density[at, grades + 1] / p, density[at, grades] / p
    by_threshold = np.zeros(k + 2)
    np.add.at(by_threshold, grades + 1, -upper)
    np.add.at(by_threshold, grades, lower)
    by_row = (upper - lower) * value
    by_weight = np.bincount(slots, by_row[row], len(weights))
    return -np.log(p).sum(), by_weight, by_threshold[1:-1]


def _unpack(theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and thresholds as a first value plus positive steps, which keeps them ordered."""
    raw = theta[-k:]
    return theta[:-k], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _threshold_chain(by_threshold: np.ndarray, raw: np.ndarray) -> np.ndarray:
    tails = np.cumsum(by_threshold[::-1])[::-1]
    return np.concatenate([[tails[0]], tails[1:] * np.exp(raw[1:])])


def labelled_features(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, max_fit_rows: int, n_features: int) -> DataFrame:
    """``slots array<int>, grade int`` of about ``max_fit_rows`` rated rows at most.

    Rows are drawn by a hash of the id, so the draw is the same on every run.
    An id rated more than once counts by its lowest grade; null ids and grades
    are left out.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    n = rated.count()
    if n > max_fit_rows:
        share = int(max_fit_rows / n * (1 << 30))
        rated = rated.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 30)) < share)
    # bounded: max_fit_rows pairs of numbers
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(F.broadcast(rated), id_col).select("_text", "grade")

    def featurise(batches):
        hasher = Hasher(n_features)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([hasher.slots(t.as_py()) for t in b.column(0)], pa.list_(pa.int32())), b.column(1).cast(pa.int32())], ["slots", "grade"]
            )

    return texts.mapInArrow(featurise, "slots array<int>, grade int").where(F.size("slots") > 0)


def fit(features: DataFrame, n_grades: int, n_features: int = N_FEATURES, l2: float = 0.01, steps: int = 40, memory: int = 8) -> OrdinalModel:
    """L-BFGS on the likelihood summed over the tasks of ``features``.

    Without rows, the weights are zero and the grades equally likely.
    """
    k = n_grades - 1
    features = materialise(materialise(features).coalesce(FIT_TASKS)).coalesce(FIT_TASKS)  # the corpus is read at full width
    count = features.count()
    raw = np.concatenate([[-np.log(max(k, 1))], np.zeros(k - 1)])
    theta = np.concatenate([np.zeros(n_features), raw])
    if count == 0:
        even = np.arange(1, k + 1) / n_grades
        return OrdinalModel(np.zeros(n_features), np.log(even / (1 - even)))

    def gradient_at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights, thresholds = _unpack(theta, k)
        sent = features.sparkSession.sparkContext.broadcast((weights.astype(np.float32), thresholds))

        def partial(batches):
            loss, gw, gt = 0.0, np.zeros(n_features), np.zeros(k)
            w, t = sent.value
            for b in batches:
                lists = b.column(0)
                a, x, y = _loss_gradient(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), b.column(1).to_numpy(), w, t)
                loss, gw, gt = loss + a, gw + x, gt + y
            at = np.flatnonzero(gw).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"loss": [loss], "at": [at.tobytes()], "gw": [gw[at].astype(np.float32).tobytes()], "gt": [gt.tobytes()]})

        loss, gw, gt = 0.0, np.zeros(n_features), np.zeros(k)
        for r in features.mapInArrow(partial, "loss double, at binary, gw binary, gt binary").collect():  # one row for each of FIT_TASKS tasks
            loss += r["loss"]
            gw[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["gw"], np.float32)
            gt += np.frombuffer(r["gt"])
        sent.unpersist()
        loss = loss / count + 0.5 * l2 * float(weights @ weights) / 100
        return loss, np.concatenate([gw / count + l2 / 100 * weights, _threshold_chain(gt, theta[-k:]) / count])

    loss, g = gradient_at(theta)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, rate = float(g @ q), 1.0
        for _ in range(6):
            new = theta - rate * q
            new_loss, new_g = gradient_at(new)
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 3
        else:
            break
        s, y = new - theta, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        gain, theta, loss, g = loss - new_loss, new, new_loss, new_g
        if gain < 1e-4 * abs(loss):
            break
    weights, thresholds = _unpack(theta, k)
    return OrdinalModel(weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", tail_grade: int | None = None) -> DataFrame:
    """``docs`` plus ``quality``: struct<expected_grade double, tail double>.

    ``tail`` is the probability of ``tail_grade`` or better (the best grade by
    default). A null text, or one without words, has 0 for both.
    """
    tail_grade = model.n_grades - 1 if tail_grade is None else tail_grade
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    hashers: list[Hasher] = []

    @F.pandas_udf("struct<expected_grade double, tail double>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        if not hashers:
            hashers.append(Hasher(len(sent.value)))
        slots, w, known = hashers[0].slots, sent.value, {}
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            if t not in known:
                at = slots(t)
                known[t] = (float(w[at].sum()) * len(at) ** -0.25, True) if len(at) else (0.0, False)
            out[i] = known[t]
        p = _probabilities(out[:, 0], thresholds)
        some = out[:, 1] > 0
        return pd.DataFrame({"expected_grade": np.where(some, p @ np.arange(p.shape[1]), 0.0), "tail": np.where(some, p[:, tail_grade:].sum(axis=1), 0.0)})

    return docs.withColumn(fresh(docs, "quality"), rate(F.col(text_col)))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: how many of the two ratings are good, 0 to 2.

    Low quality and toxicity count alike, so the grades are ordered: two faults,
    one, none. A missing rating counts as good, and a row with neither has no grade.
    """
    low, toxic = F.col("quality") < 1, F.col("toxic") >= 1
    faults = F.coalesce(low, F.lit(False)).cast("int") + F.coalesce(toxic, F.lit(False)).cast("int")
    return labels.select("doc_id", F.when(low.isNotNull() | toxic.isNotNull(), 2 - faults).alias("grade"))


def classify(docs: DataFrame, labels: DataFrame, min_tail: float = MIN_TAIL, max_fit_rows: int = MAX_FIT_ROWS, n_features: int = N_FEATURES) -> DataFrame:
    """Fit on the rated part of ``docs`` and rate every row of ``docs``.

    Adds ``quality`` (see :func:`score`; an underscore is appended while the
    name is taken) and ``keep``: whether the tail probability of the best grade
    reaches ``min_tail``. Null texts and texts without words aren't kept.
    Repeated rows get equal values. Without labels all texts with words have
    the tail probability 1/3.
    """
    model = fit(labelled_features(docs, grades_of_labels(labels), "doc_id", "text", max_fit_rows, n_features), 3, n_features)
    rated = score(docs, model)
    quality = rated.columns[-1]
    return rated.withColumn(fresh(rated, "keep"), F.col(f"`{quality}`.tail") >= min_tail)

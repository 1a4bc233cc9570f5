"""Whitening of embeddings by components from a FEAST contour integration.

Sums and centred products are Spark jobs over all vectors; what comes to the
driver is one covariance matrix, whose size depends on the dimension alone.

Its spectrum is cut where Sturm counts of the tridiagonal form (the inertia of
the shifted matrix) say that few eigenvalues lie between two cuts, at the widest
gaps near by. Each interval is a task of its own: Gauss-Legendre points on the
circle over the interval give complex shifted solves of a random block, whose
weighted sum is that block's projection on the interval's eigenvectors;
Rayleigh-Ritz in the projected space takes them out, and this repeats until the
residuals are down and as many values lie within the interval as the inertia of
its ends demands. A last Rayleigh-Ritz over all intervals' vectors makes them
orthogonal across the cuts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.projection import by_length
from fieldloom.llm.tables import fresh, materialise

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
FARTHEST = 1 << 40  # entries of greater size are taken for this one
PER_INTERVAL = 6
POINTS = 12
ROUNDS = 40
WIDEST = 8.0  # greatest to least value of an interval
MAX_DIMENSION = 4096  # a matrix of 134 MB


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a matrix that is similar to the symmetric ``v`` (Householder)."""
    a = v.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if size := np.linalg.norm(x):
            x /= size
            p = a[k + 1 :, k + 1 :] @ x
            w = p - x * (x @ p)
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
            a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_below(shift: float, diagonal: np.ndarray, side: np.ndarray) -> int:
    """The negative pivots of the shifted matrix: how many eigenvalues are less than ``shift``."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    below, pivot = 0, 1.0
    for d, e in zip(diagonal, [0.0, *side], strict=True):
        pivot = d - shift - e * e / pivot
        if abs(pivot) < least:
            pivot = -least
        below += pivot < 0
    return below


def eigenvalue(rank: int, low: float, high: float, diagonal: np.ndarray, side: np.ndarray, close: float) -> tuple[float, float]:
    """An interval no wider than ``close`` that holds the ``rank``-th least eigenvalue, from 0, by bisection of the counts."""
    while high - low > close:
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if count_below(mid, diagonal, side) > rank else (mid, high)
    return low, high


def intervals(v: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """``low, high, count``: cuts of the spectrum that hold the ``wanted`` greatest eigenvalues.

    A cut lies in the widest gap among those that leave half to all of
    ``per_interval`` values on its side, fewer where they fall steeply; equal eigenvalues are never parted.
    """
    diagonal, side = tridiagonal(v)
    n = len(v)
    reach = np.abs(np.concatenate([[0], side])) + np.abs(np.concatenate([side, [0]]))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    slack = n * 4 * np.finfo(float).eps * max(abs(low), abs(high)) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    places = [eigenvalue(r, low, high, diagonal, side, slack) for r in range(n - 1, max(-1, n - wanted - per_interval - 2), -1)]
    values = [sum(p) / 2 for p in places]  # falling

    def beside(value: float) -> float:
        return max(abs(value) / 20, 8 * slack)

    out, start, top = [], 0, values[0] + beside(values[0])
    while start < min(wanted, len(values)):
        # no interval is much wider than its least value, which would lie at the circle's very edge
        ends = [e for e in range(start + 1, min(start + per_interval, len(values)) + 1) if values[e - 1] * WIDEST >= values[start]] or [start + 1]
        ends = [e for e in ends if e - start >= per_interval // 2] or ends
        gap = lambda e: values[e - 1] - values[e] if e < len(values) else beside(values[e - 1])
        end = max(ends, key=gap)
        while end < len(values) and gap(end) <= 8 * slack:  # equal values stay together
            end += 1
        bottom = values[end - 1] - (gap(end) / 2 if end < len(values) else beside(values[end - 1]))
        count = count_below(top, diagonal, side) - count_below(bottom, diagonal, side)
        if count:
            out.append((float(bottom), float(top), int(count)))
        start, top = start + max(count, 1), bottom
    return out


def feast(v: np.ndarray, low: float, high: float, count: int, points: int = POINTS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their unit vectors as columns."""
    n = len(v)
    rng = np.random.default_rng(n)
    size = min(n, count + max(4, count))
    block = rng.normal(size=(n, size))
    angle, weight = np.polynomial.legendre.leggauss(points)
    middle, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(0.5j * np.pi * (angle + 1))  # the upper half; the lower one is its mirror image
    norm = np.abs(v).sum(axis=1).max()
    done = False
    for turned in range(1, rounds + 1):
        projected = np.zeros_like(block)
        for turn, w in zip(turns, weight, strict=True):
            solved = np.linalg.solve((middle + radius * turn) * np.eye(n) - v, block)
            projected += (w * radius / 2 * turn * solved).real
        q, _ = np.linalg.qr(projected)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ inner
        residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        inside = (values > low) & (values < high)
        settled = inside & (residual <= 1e-13 * norm)
        if settled.sum() == count:  # orthogonal and as many as the inertia says; other values within are no eigenvalues yet
            if done:
                return values[settled], vectors[:, settled]
            done = True  # once more, which takes the vectors to rounding
        # fewer values within than the inertia says, or neighbours that fade slowly, need a wider block
        block = vectors if size == n or inside.sum() >= count and turned % 8 else np.hstack([vectors, rng.normal(size=(n, min(n, size + count) - size))])
        size = block.shape[1]
    raise RuntimeError(f"{count} eigenvalues lie between {low} and {high}, and {settled.sum()} were found")


def components(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest ``wanted`` eigenvalues that aren't zero, falling, and their unit vectors as columns."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / trace
    cuts = intervals(scaled, min(wanted, len(v)))

    def solve(batches):
        for b in batches:
            for low, high, count in zip(b["low"], b["high"], b["count"], strict=True):
                values, vectors = feast(scaled, low, high, int(count))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    rows = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts)).mapInPandas(solve, "value double, vector array<double>").collect()  # one row for each component
    q, _ = np.linalg.qr(np.array([r["vector"] for r in rows]).T)
    values, inner = np.linalg.eigh(q.T @ scaled @ q)
    last = np.argsort(-values)[:wanted]
    last = last[values[last] > len(v) * np.finfo(float).eps * values.max()]
    return values[last] * trace, (q @ inner)[:, last]


def _long(x: np.ndarray) -> np.ndarray:
    """Entries as integers, without the offset that centring takes away again."""
    return np.clip(np.floor(SCALE * x), -FARTHEST, FARTHEST).astype(np.int64)


def _usable(batch, d: int | None = None):
    for length, at, x in by_length(batch.column("v")):
        fine = np.isfinite(x).all(axis=1)
        if length and (d is None or length == d) and fine.any():
            yield length, at[fine], _long(x[fine])


def _summed(rows: DataFrame) -> tuple[int, int, list[int]]:
    """The usual length of vectors, their number, and the sum of each place without offset; exact."""

    def sums(batches):
        total: dict = {}
        for b in batches:
            for d, at, x in _usable(b):
                n, s = total.get(d, (0, np.zeros(d, object)))
                total[d] = (n + len(at), s + x.sum(axis=0))
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([str(n), *map(str, s)])], ["d", "place", "total"]
            )

    found = rows.mapInArrow(sums, "d int, place int, total string").groupBy("d", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = materialise(found)
    most = found.where("place = -1").orderBy(F.col("total").desc(), F.col("d").desc()).first()
    if most is None:
        return 0, 0, []
    if most["d"] > MAX_DIMENSION:
        raise ValueError(f"vectors of {most['d']} entries; a covariance of more than {MAX_DIMENSION} columns is not for one machine")
    places = {r["place"]: int(r["total"]) for r in found.where(F.col("d") == most["d"]).collect()}  # as many as places
    return most["d"], places[-1], [places[i] for i in range(most["d"])]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S``, exactly, and its squares summed over the places; an integer beyond a long is null."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if (np.abs(apart).max(initial=0) + 1.0) ** 2 * x.shape[1] < 2.0**62:
            return apart.astype(float), (apart * apart).sum(axis=1)
    apart = n * x.astype(object) - np.array(sums, object)
    squares = (apart * apart).sum(axis=1)
    return apart.astype(float), np.array([s if s < 1 << 63 else None for s in squares], object)


def _products(rows: DataFrame, column: str, d: int, prepare) -> np.ndarray:
    """The sum over all rows of the outer products of what ``prepare`` makes of a batch."""

    def gram(batches):
        total = np.zeros((d, d))
        for b in batches:
            for x in prepare(b):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = rows.select(column).mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s")).where("j <= i")
    out = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():  # as many as cells of a matrix
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> tuple[DataFrame, int, np.ndarray]:
    """``id_col, deviation long, whitened array<double>``, the number of vectors, and the share of the variance of each component.

    Rows whose vector is null, empty or holds a null or non-finite entry are
    left out, and so are those of another length than most have (of equally many, the longer).
    An entry ``c`` counts as ``floor(64 * c)``, at most ``FARTHEST`` from 0. Components of no variance (a
    constant place, fewer vectors than components) aren't returned, so equal
    vectors, or one alone, get empty arrays. Repeated rows and ids count each; an empty table gives no rows.
    ``deviation`` beyond a long is null.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(T.ArrayType(T.DoubleType())).alias("v"))
    d, n, sums = _summed(rows.select("v"))
    covariance = _products(rows, "v", d, lambda b: (_centred(x, n, sums)[0] / n for _, _, x in _usable(b, d))) / n if n else np.zeros((0, 0))
    values, axes = components(vectors.sparkSession, covariance, wanted)
    scaled = axes / np.sqrt(values)

    def project(batches):
        for b in batches:
            for _, at, x in _usable(b, d):
                apart, squares = _centred(x, n, sums)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(squares.tolist(), pa.int64()), pa.array(list((apart / n) @ scaled), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    out = rows.mapInArrow(project, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)
    return out, n, values / np.trace(covariance) if len(values) else values


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened array<double>`` of ``k`` entries, minus the identity."""
    if not n or not k:
        return 0.0
    means = [0.0] * k
    for r in whitened.select(F.posexplode("whitened").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect():  # one row for each component
        means[r["i"]] = r["m"]

    def prepare(batch):
        for _, _, x in by_length(batch.column("whitened")):
            yield x - np.array(means)

    return float(np.abs(_products(whitened, "whitened", k, prepare) / n - np.eye(k)).max())


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """:func:`whiten` with a row for each vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    table, n, explained = whiten(vectors, id_col, vector_col, wanted)
    table = materialise(table)
    error = identity_error(table, n, len(explained))
    shares = F.array(*(F.lit(float(e)) for e in explained)) if len(explained) else F.array().cast("array<double>")
    name = fresh(table, "_at")
    out = table.select(id_col, "deviation", F.posexplode("whitened").alias(name, "value"))
    return out.select(id_col, (F.col(name) + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col(name)).alias("explained"), F.lit(error).alias("identity_error"))

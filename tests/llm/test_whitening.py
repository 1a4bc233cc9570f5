from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def spectrum(values, seed: int = 0) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "even": np.arange(1.0, 65),
    "close": 1 + np.arange(64) * 1e-6,
    "equal": np.ones(50),
    "two groups": np.repeat([1.0, 3.0], 20),
    "few of rank": np.r_[np.zeros(40), 5.0, 5.0, 5.0 + 1e-9, 7.0],
    "steep": 10.0 ** -np.arange(0, 12),
    "one large": np.r_[np.linspace(1, 1.1, 63), 400.0],
    "one": np.array([3.0]),
    "two": np.array([3.0, 1.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts(name):
    v = spectrum(SPECTRA[name])
    diagonal, side = whitening.tridiagonal(v)
    own = np.linalg.eigvalsh(v)
    for shift in np.linspace(own[0] - 1, own[-1] + 1, 41):
        if np.abs(own - shift).min() > 1e-9:
            assert whitening.count_below(shift, diagonal, side) == (own < shift).sum()


@pytest.mark.parametrize("name", SPECTRA)
def test_intervals_and_contours_find_all(name):
    v = spectrum(SPECTRA[name])
    own = np.linalg.eigvalsh(v)[::-1]
    wanted = min(32, len(v))
    cuts = whitening.intervals(v / np.trace(v), wanted)
    assert sum(c for *_, c in cuts) >= wanted
    assert all(a[0] == b[1] for a, b in zip(cuts, cuts[1:], strict=False))
    found = np.concatenate([whitening.feast(v / np.trace(v), *c)[0] for c in cuts])
    assert np.allclose(np.sort(found)[::-1][:wanted] * np.trace(v), own[:wanted], rtol=1e-12, atol=1e-13 * own[0])


def brute_force(rows: list[tuple]) -> dict:
    """Exact sums by fractions, and another eigensolver."""
    fit = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(fit), len(fit[0][1])
    s = [sum(x[k] for _, x in fit) for k in range(d)]
    v = np.array([[float(sum(Fraction((n * x[a] - s[a]) * (n * x[b] - s[b]), n * n) for _, x in fit) / n) for b in range(d)] for a in range(d)])
    values, axes = np.linalg.eigh(v)
    out = {}
    for i, x in fit:
        apart = [n * x[k] - s[k] for k in range(d)]
        for k in range(min(32, d)):
            e, axis = values[d - 1 - k], axes[:, d - 1 - k]
            out[i, k + 1] = (n, sum(a * a for a in apart), sum(a / n * c for a, c in zip(apart, axis, strict=True)) / np.sqrt(e), e / np.trace(v))
    return out


def test_query_agrees_with_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(90, 36)) * np.linspace(0.2, 2, 36)
    rows = [(i, [float(c) for c in np.float32(x)], 0) for i, x in enumerate(data)]
    rows += [(500, None, 1), (501, [], 1), (502, [None] * 36, 1), (503, [float("nan")] + [0.0] * 35, 1), (504, [float("inf")] * 36, None)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"deviation": F.lit("taken"), "component": F.lit(1), "_at": F.lit(2)}).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found, want = {(r["vec_id"], r["component"]): r for r in out.collect()}, brute_force(rows)
    assert found.keys() == want.keys()
    assert {r["n"] for r in found.values()} == {90} and len({r["identity_error"] for r in found.values()}) == 1
    assert all(0 <= r["identity_error"] < 1e-10 for r in found.values())
    for k in range(1, 33):
        ours, theirs = (np.array([x[i, k][c] for i in range(90)]) for x, c in ((found, "whitened"), (want, 2)))
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
        assert abs(found[0, k]["explained"] / want[0, k][3] - 1) < 1e-10
    assert all(found[k]["deviation"] == want[k][1] for k in found)


def test_awkward_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitened_rows(make([])).collect() == []
    assert whitening.whitened_rows(make([(1, None, 0), (2, [], 0)])).collect() == []
    assert whitening.whitened_rows(make([(1, [0.5, 0.25], 0)] * 3)).collect() == []
    flat = whitening.whitened_rows(make([(1, [0.0, 1.0, 1.0], 0), (2, [1.0, 1.0, 3.0], 0), (None, [0.0, 1.0, 1.0], 0), (4, [7.0], 0)])).collect()
    assert {(r["vec_id"], r["component"], r["n"]) for r in flat} == {(1, 1, 3), (2, 1, 3), (None, 1, 3)} and flat[0]["explained"] == pytest.approx(1)
    huge = whitening.whitened_rows(make([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [0.0, 9.0], 0)])).collect()
    assert len(huge) >= 3 and {r["deviation"] for r in huge} >= {None}

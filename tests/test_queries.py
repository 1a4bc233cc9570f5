"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans import registry

ROOT = "/root/testdata/sf0.001"
QUERIES = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(x):
    if x is None or x != x or str(x) == "<NA>":
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        return float(x)
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return sorted(([value(x) for x in r] for r in df[names].itertuples(index=False)), key=str)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_against_sql(spark, duck, name):
    query, sql = QUERIES[name]
    got, want = query(spark, ROOT).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_without_sql(spark, name):
    """Values are tested on small tables in test_forest, test_splits and test_sources; here that the query gives rows, whole ones."""
    got = QUERIES[name][0](spark, ROOT).toPandas()
    assert len(got) and not got.isna().any().any()
    if "split" in got:
        assert set(got["split"]) <= {"train", "val", "test"} and not got.duplicated(["block_r", "block_c"]).any()
    if "draw" in got:
        assert sorted(got["draw"]) == list(range(len(got)))
    if "values" in got:
        assert got["patch_id"].is_unique and got["values"].str.count(",").eq(24).all()
    for c in ("importance", "score", "mean_f1", "iou", "accuracy"):
        if c in got:
            assert got[c].between(0, 1 + 1e-9).all() and (got[c].max() > 0 or c == "iou")  # on so few rows of one class a trial may find none


def test_entry_has_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

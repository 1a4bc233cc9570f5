"""All queries of the library proper, by name: (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.fixtures import Fixtures, oracle

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(body: str | None = None, ctes: str = "") -> Callable:
    """Registers a function of :class:`Fixtures` under its name, with the SQL that gives the same rows.

    Doubles are rounded to six places, as they are in the SQL.
    """

    def register(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Fixtures(spark, sf_dir))
            return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))

        QUERIES[f.__name__] = (run, oracle(body, ctes) if body else None)
        return f

    return register


def load() -> dict:
    from fieldloom.plans import cleaning_queries, evaluation_queries, patch_queries, scoring_queries  # noqa: F401

    return QUERIES

"""Observations stored by what they are joined and grouped by, so that neither moves them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``, read back; at ``path``, or in the warehouse.

    Rows are dealt to the buckets before they are written, so there is one file
    a bucket and not one for each task and bucket. A bucket should hold some
    hundred MB. A join or a grouping whose keys contain ``keys`` then reads bucket by bucket.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_by_patch(obs: DataFrame, table: str, size: int, buckets: int, path: str | None = None) -> DataFrame:
    """Observations with the corner ``r0, c0`` of their patch of ``size`` pixels, bucketed by it: for chips and masks."""
    corner = {f"{x}0": F.floor(F.col(x) / size).cast("long") * size for x in ("r", "c")}
    return write_bucketed(obs.withColumns(corner), table, ["r0", "c0"], buckets, path)


def write_by_pixel(obs: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Observations bucketed by pixel: for samples, whose labels are then the only side that moves."""
    return write_bucketed(obs, table, ["pixel_id"], buckets, path)

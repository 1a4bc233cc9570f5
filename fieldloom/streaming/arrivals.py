"""Scenes as they arrive: the batch difference of raw and processed files, kept up by a stream.

The catalogue operators take a stream's rows as they take a table's. Each
micro-batch of newly listed files is parsed and the dates that still lack a
processed file are appended to a table; a file that arrives again (at-least-once
delivery) adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators.catalog import pending_scenes, scene_catalog

LISTING = "path string, length long"


def stream_listing(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, length) rows from JSON listings dropped into ``folder``."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).json(folder)


def keep_pending(listing: DataFrame, processed_table: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to ``out`` (Parquet) each new raw date without a processed file, once."""

    def batch(files: DataFrame, _: int) -> None:
        spark = files.sparkSession
        raw = scene_catalog(files).where("not processed")
        new = pending_scenes(raw, spark.read.parquet(processed_table))
        try:
            new = new.join(spark.read.schema("date8 string").parquet(out), "date8", "left_anti")
        except Exception as e:  # before the first batch there is no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(out)

    return listing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

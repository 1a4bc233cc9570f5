"""Writing and reading selections, candidates and chips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import selection as selection_tables
from fieldloom.operators.selection import union_channels


def selection_payload(selection: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row: selector, mode and other ``meta``, ``n_union``, ``per_crop`` and ``union`` in order."""
    crops = selection.groupBy("crop_id", "crop_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel"))), lambda x: x["channel"]).alias("channels"))
    per = crops.agg(F.transform(F.array_sort(F.collect_list(F.struct("crop_order", F.col("crop_id").cast("string").alias("crop"), "channels"))), lambda x: F.struct(x["crop"].alias("crop"), x["channels"].alias("channels"))).alias("per_crop"))
    union = union_channels(selection).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "channel"))), lambda x: x["channel"]).alias("union"))
    one = per.join(F.broadcast(union), F.lit(True))  # one row each
    return one.select(*(F.lit(v).alias(k) for k, v in meta.items()), F.size("union").alias("n_union"), "per_crop", "union")


def write_selection(selection: DataFrame, path: str, meta: dict[str, str]) -> None:
    """``path/selection`` as JSON and ``path/bands`` as text, one channel a line."""
    payload = selection_payload(selection, meta)
    payload.coalesce(1).write.mode("overwrite").json(f"{path}/selection")
    union_channels(selection).orderBy("ordinal").select("channel").coalesce(1).write.mode("overwrite").text(f"{path}/bands")


def write_tables(selection: DataFrame, path: str) -> None:
    """CSV tables of a selection with scores: ``detail``, a row for each channel, and counts of each crop by date and by band."""
    detail = selection_tables.detail_table(selection)
    detail.orderBy("crop", "rank").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/detail")
    for name, part, pivot in (("by_date", 1, selection_tables.date_pivot), ("by_band", 0, selection_tables.band_pivot)):
        values = sorted(r[0] for r in selection.select(F.split("channel", "_")[part]).distinct().collect())  # dates or bands
        pivot(selection, values).orderBy("crop_id").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def read_selection(spark: SparkSession, path: str, subset_k: int | None = None) -> DataFrame:
    """``crop_id, crop_order, rank, channel``, to ``subset_k`` ranks if given.

    A payload that keeps several ``top_k`` lists and no ``per_crop`` gives the
    largest of them.
    """
    payload = spark.read.json(f"{path}/selection")
    if "per_crop" not in payload.columns:
        lists = payload.select(F.explode("top_k").alias("t")).select("t.*")
        payload = lists.orderBy(F.desc("k")).limit(1)
    crops = payload.select(F.posexplode("per_crop").alias("crop_order", "p"))
    out = crops.select(F.col("p.crop").cast("int").alias("crop_id"), "crop_order", F.posexplode("p.channels").alias("_i", "channel")).select("crop_id", "crop_order", (F.col("_i") + 1).alias("rank"), "channel")
    return out if subset_k is None else out.where(F.col("rank") <= subset_k)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Tidy rows (crop, kind, rank, value) as CSV, and one JSON list per crop and kind."""
    tidy = candidates.select(F.col("crop_id").alias("crop"), F.col("kind").alias("type"), "rank", "value")
    tidy.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/rows")
    lists = tidy.groupBy("crop", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))
    lists.coalesce(1).write.mode("overwrite").json(f"{path}/candidates")


def write_chips(chips: DataFrame, path: str, max_chips: int | None = None) -> None:
    """Chips as Parquet partitioned by split. ``max_chips`` keeps the first patches by id."""
    if max_chips is not None:
        first = chips.select("patch_id").distinct().orderBy("patch_id").limit(max_chips)
        chips = chips.join(first, "patch_id", "left_semi")
    chips.write.mode("overwrite").partitionBy("split").parquet(path)

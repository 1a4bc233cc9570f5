"""Deterministic samples: rows ordered by ``md5(id-seed)``, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"-{seed}")))


def among_first(df: DataFrame, k: int, seed: int, *ids: str) -> Column:
    """Whether a row is one of the first ``k`` of ``df`` by the hash of ``ids[0]``, then ``ids``.

    Rows are counted by the first digits of the hash (65,536 counts at most),
    and only those of the digits where the cut falls are ordered.
    """
    h = hash_order(ids[0], seed)
    digits = F.substring(h, 1, 4)
    before = 0
    for r in sorted(df.groupBy(digits.alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["p"] or ""):
        if k > before and before + r["n"] >= k:
            edge = df.where(digits == r["p"]).select(h.alias("h"), *ids).orderBy("h", *ids).limit(k - before).agg(F.max(F.struct("h", *ids)).alias("e")).first()["e"]
            return F.struct(h, *ids) <= F.struct(F.lit(edge[0]), *(F.lit(x).cast(df.schema[i].dataType) for i, x in zip(ids, edge[1:], strict=True)))
        before += r["n"]
    return F.lit(k > 0)


def sample_size(n: int, frac: float = 0.2, least: int = 1000) -> int:
    return min(n, max(least, int(frac * n)))


def sample_ids(labels: DataFrame, frac: float = 0.2, seed: int = 42, least: int = 1000) -> DataFrame:
    """Exactly ``min(N, max(least, int(frac N)))`` pixels without replacement, as a filter on the scan."""
    return labels.where(among_first(labels, sample_size(labels.count(), frac, least), seed, "pixel_id"))


def sample_pixels(obs: DataFrame, labels: DataFrame, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``pixel_id, class_label, features``: a map from channel to value, null where missing, for sampled pixels."""
    ids = sample_ids(labels, frac, seed).select("pixel_id", F.col("cdl_id").cast("int").alias("class_label"))
    channel = F.concat_ws("_", "band", "date8")
    return obs.join(ids, "pixel_id").groupBy("pixel_id", "class_label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(channel.alias("channel"), "value")))).alias("features"))


def sample_complete_pixels(obs: DataFrame, labels: DataFrame, n_channels: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` labelled pixels all of whose channels are valid."""
    full = obs.groupBy("pixel_id").agg(F.count("value").alias("_n")).where(F.col("_n") == n_channels)
    some = labels.where(F.col("cdl_id") != 0).join(full, "pixel_id", "left_semi")
    some = some.select("pixel_id", "cdl_id")
    return some.where(among_first(some, n, seed, "pixel_id"))


def first_of_each(df: DataFrame, group: str, n: int, seed: int, id_col: str) -> DataFrame:
    """The first ``n`` rows of each ``group`` by the hash of ``id_col``, then by it.

    Rows are counted by group and first digits of the hash; running sums of
    these counts say from which digits a group takes all rows, some or none, and only
    rows of one group and the same digits are ordered. So no task sorts a group.
    """
    h = hash_order(id_col, seed)
    dealt = df.withColumns({"_h": h, "_p": F.substring(h, 1, 4)})
    counts = dealt.groupBy(group, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")
    cuts = counts.select(F.col(group).alias("_group"), F.col("_p").alias("_digits"), (F.lit(n) - before).alias("_take")).where("_take > 0")
    rank = F.row_number().over(Window.partitionBy(group, "_p").orderBy("_h", id_col))
    met = dealt.join(cuts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_p") == F.col("_digits")))
    return met.withColumn("_k", rank).where("_k <= _take").select(*df.columns)


def sample_area(obs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``area, pixel_id``: up to ``n`` pixels of each area with all bands valid."""
    whole = obs.groupBy("area", "pixel_id").agg(F.every(F.col("value").isNotNull()).alias("_ok")).where("_ok").select("area", "pixel_id")
    return first_of_each(whole, "area", n, seed, "pixel_id")


def sample_per_band(obs: DataFrame, n: int, height: int, width: int, seed: int = 42, n_bands: int | None = None) -> DataFrame:
    """``date8, band, draw, value``: ``n`` hashed positions for each scene, with replacement, invalid ones dropped.

    Scenes whose number of bands isn't ``n_bands`` are skipped.
    """
    scenes = obs.groupBy("date8").agg(F.countDistinct("band").alias("_b"))
    if n_bands is not None:
        scenes = scenes.where(F.col("_b") == n_bands)
    draws = scenes.select("date8", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("draw"))
    h = F.md5(F.concat_ws("-", "date8", F.col("draw").cast("string"), F.lit(str(seed))))
    pos = lambda a, m: (F.conv(F.substring(h, a, 8), 16, 10).cast("long") % m)
    draws = draws.withColumns({"r": pos(1, height), "c": pos(9, width)})
    return obs.join(draws, ["date8", "r", "c"]).where(F.col("value").isNotNull()).select("date8", "band", "draw", "value")


def band_range_or_default(sampled: DataFrame, bands: list[str], default: tuple[float, float] = (0.0, 10000.0)) -> DataFrame:
    """``band, lo, hi`` of a sample; a band without values gets the default."""
    grid = sampled.sparkSession.createDataFrame([(b,) for b in bands], "band string")
    own = sampled.groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return grid.join(own, "band", "left").select("band", F.coalesce("lo", F.lit(default[0])).alias("lo"), F.coalesce("hi", F.lit(default[1])).alias("hi"))


def cap_rows(df: DataFrame, n: int, seed: int = 42, key: str = "pixel_id") -> DataFrame:
    return df.where(among_first(df, n, seed, key))


def missing_summary(obs: DataFrame) -> DataFrame:
    """Pixels with any missing channel, and clean ones with their share in percent."""
    rows = obs.groupBy("pixel_id").agg(F.every(F.col("value").isNotNull()).alias("ok"))
    return rows.agg(F.count("*").alias("n_pixels"), F.sum((~F.col("ok")).cast("long")).alias("n_missing"), F.sum(F.col("ok").cast("long")).alias("n_clean"), (100 * F.avg(F.col("ok").cast("double"))).alias("clean_pct"))

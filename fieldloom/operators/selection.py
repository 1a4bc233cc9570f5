"""Selecting channels from scores, and set operations on selections.

A selection has ``crop_id, crop_order, rank, channel, score``. Its size is
classes x channels at most, so windows over all of it are small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.channels import band_of, date_of, day_of_year
from fieldloom.operators.cleaning import CLASS_NAMES, KEEP_CLASSES


def _ranked(scores: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*(F.lit(k) for k in KEEP_CLASSES)), F.col("crop_id").cast("int")).cast("int") - 1
    rank = F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), "channel_idx"))
    return scores.select("crop_id", order.alias("crop_order"), rank.alias("rank"), "channel", "score")


def select_top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each crop; ties by channel order."""
    return _ranked(scores).where(F.col("rank") <= k)


def pooled_threshold(scores: DataFrame, p: float) -> DataFrame:
    """``pooled_threshold``: one row, the percentile (linear) of all crops' scores together."""
    return scores.agg(F.percentile("score", p / 100).alias("pooled_threshold"))


def select_percentile(scores: DataFrame, p: float) -> DataFrame:
    """Scores at or above the percentile (linear) of all crops' scores together."""
    cut = pooled_threshold(scores, p).withColumnRenamed("pooled_threshold", "_cut")
    return _ranked(scores).join(F.broadcast(cut), F.col("score") >= F.col("_cut")).drop("_cut")  # one row


def select_threshold(scores: DataFrame, t: float) -> DataFrame:
    """Channels whose score, scaled to [0, 1] within the crop, reaches ``t``; a constant crop scales to 0."""
    w = Window.partitionBy("crop_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    scaled = scores.withColumn("_n", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))
    return _ranked(scaled.where(F.col("_n") >= t).drop("_n"))


def union_channels(selection: DataFrame) -> DataFrame:
    """``channel, ordinal``: all channels in the order first met, crop by crop."""
    first = selection.groupBy("channel").agg(F.min(F.struct("crop_order", "rank")).alias("_f"))
    return first.select("channel", (F.row_number().over(Window.orderBy("_f", "channel")) - 1).alias("ordinal"))


def sweep(scores: DataFrame, ks: Iterable[int] | None = None, percentiles: Iterable[float] | None = None) -> DataFrame:
    """The selections of several ``ks`` or ``percentiles`` in one pass, marked by ``param``."""
    if (ks is None) == (percentiles is None):
        raise ValueError("sweep takes ks or percentiles, not both")
    if ks is not None:
        listed = _ranked(scores).withColumn("param", F.explode(F.array(*(F.lit(float(k)) for k in ks))))
        return listed.where(F.col("rank") <= F.col("param"))
    ps = list(percentiles)
    cuts = scores.agg(F.percentile("score", [p / 100 for p in ps]).alias("_c")).select(F.posexplode("_c").alias("_i", "_cut"))
    cuts = cuts.withColumn("param", F.array(*(F.lit(float(p)) for p in ps))[F.col("_i")])
    return _ranked(scores).join(F.broadcast(cuts), F.col("score") >= F.col("_cut")).drop("_i", "_cut")  # a row for each percentile


def sweep_union_sizes(swept: DataFrame) -> DataFrame:
    return swept.groupBy("param").agg(F.countDistinct("channel").alias("n_union"), F.count("*").alias("n_selected"))


def subset_selection(selection: DataFrame, k: int) -> DataFrame:
    """The union at a smaller ``k``; ValueError if fewer ranks are stored."""
    stored = selection.agg(F.max("rank")).first()[0] or 0
    if k > stored:
        raise ValueError(f"the selection holds {stored} ranks; {k} were asked for")
    return union_channels(selection.where(F.col("rank") <= k))


def project_selection(union: DataFrame, channels: DataFrame) -> DataFrame:
    """``channel, ordinal, local_channel, channel_idx, status`` of a selection on another year's channels.

    Same month-day first, else the nearest by day of a leap year (ties: the
    earliest date). Malformed names, unknown bands and channels that aren't
    there are marked, not mapped.
    """
    name = F.regexp_extract("channel", r"^(.+)_([^_]*)$", 1)
    date = F.regexp_extract("channel", r"^(.+)_([^_]*)$", 2)
    u = union.select("channel", "ordinal", name.alias("_band"), F.substring(date, 5, 4).alias("_mmdd"))
    local = channels.groupBy("mmdd").agg(F.max("date8").alias("_local"))
    wanted = u.select("_mmdd").distinct()
    pairs = wanted.join(F.broadcast(local), day_of_year(F.col("mmdd")).isNotNull())  # a few hundred dates by the dates of one year
    near = pairs.groupBy("_mmdd").agg(F.min_by("_local", F.struct(F.when(F.col("_mmdd") == F.col("mmdd"), -1).otherwise(F.abs(day_of_year(F.col("mmdd")) - day_of_year(F.col("_mmdd")))), F.col("mmdd"))).alias("_local"))
    bands = channels.select(F.col("band").alias("_known")).distinct()
    j = u.join(near, "_mmdd", "left").join(F.broadcast(bands), F.col("_band") == F.col("_known"), "left")
    j = j.withColumn("_name", F.concat_ws("_", "_band", "_local"))
    own = channels.select(F.col("channel").alias("_have"), "channel_idx")
    j = j.join(F.broadcast(own), F.col("_name") == F.col("_have"), "left")
    status = F.when(F.col("_band") == "", "malformed").when(F.col("_known").isNull(), "unknown band").when(F.col("_have").isNull(), "missing channel").otherwise("ok")
    return j.select("channel", "ordinal", F.when(status == "ok", F.col("_have")).alias("local_channel"), F.when(status == "ok", F.col("channel_idx")).alias("channel_idx"), status.alias("status"))


def cross_channels(dates: DataFrame, bands: DataFrame, channels: DataFrame) -> DataFrame:
    """All dates with all bands, as far as the channel exists. Both lists are short."""
    some = channels.join(dates.select("date8").distinct(), "date8", "left_semi").join(bands.select("band").distinct(), "band", "left_semi")
    return some.select("channel", "band", "date8", "channel_idx")


def domain_channels(candidates: DataFrame, dates: DataFrame, channels: DataFrame, k: int) -> DataFrame:
    """``channel, ordinal``: the union of each crop's ``k`` best bands on the given dates.

    ``candidates`` has ``crop_order, rank, band``; order is by date, then by
    the band's first mention.
    """
    bands = candidates.where(F.col("rank") <= k).groupBy("band").agg(F.min(F.struct("crop_order", "rank")).alias("_f"))
    found = channels.join(bands, "band").join(dates.select("date8").distinct(), "date8", "left_semi")
    return found.select("channel", (F.row_number().over(Window.orderBy("date8", "_f", "band")) - 1).alias("ordinal"))


def baseline_channels(dates: DataFrame, channels: DataFrame) -> DataFrame:
    """All bands of the given dates, once each, in channel order."""
    own = channels.join(dates.select("date8").distinct(), "date8", "left_semi")
    return own.select("channel", "channel_idx", (F.row_number().over(Window.orderBy("channel_idx")) - 1).alias("ordinal"))


def consistent_channels(channels: DataFrame) -> DataFrame:
    """Band and month-day of channels that every year has."""
    n = channels.agg(F.countDistinct("year").alias("_n"))
    seen = channels.groupBy("band", "mmdd").agg(F.countDistinct("year").alias("n_years"))
    return seen.join(F.broadcast(n), F.col("n_years") == F.col("_n")).select("band", "mmdd", "n_years")  # one row


def prune_scenes(channels: DataFrame, selected: DataFrame) -> DataFrame:
    """All scenes' channels with ``kept`` and the new dense scene and channel numbers of kept scenes."""
    used = channels.join(selected.select("channel"), "channel", "left_semi").select("date8").distinct().withColumn("_used", F.lit(True))
    out = channels.join(F.broadcast(used), "date8", "left").withColumn("kept", F.coalesce("_used", F.lit(False))).drop("_used")
    scene = F.dense_rank().over(Window.partitionBy("kept").orderBy("scene_idx")) - 1
    idx = F.row_number().over(Window.partitionBy("kept").orderBy("channel_idx")) - 1
    return out.withColumn("new_scene_idx", F.when(F.col("kept"), scene)).withColumn("new_channel_idx", F.when(F.col("kept"), idx))


def detail_table(selection: DataFrame) -> DataFrame:
    """``crop, rank, band, date, channel, score``: names, MM/DD, and scores to six places."""
    names = F.create_map(*(F.lit(x) for k, v in CLASS_NAMES.items() for x in (k, v)))
    date = date_of(F.col("channel"))
    day = F.concat(F.substring(date, 5, 2), F.lit("/"), F.substring(date, 7, 2))
    return selection.select(names[F.col("crop_id").cast("int")].alias("crop"), "rank", band_of(F.col("channel")).alias("band"), day.alias("date"), "channel", F.round("score", 6).alias("score"))


def _pivot(selection: DataFrame, part: int, values: list[str]) -> DataFrame:
    named = selection.select("crop_id", F.split("channel", "_")[part].alias("_v"))
    return named.groupBy("crop_id").pivot("_v", values).count().na.fill(0, values)


def date_pivot(selection: DataFrame, dates: list[str]) -> DataFrame:
    return _pivot(selection, 1, dates)


def band_pivot(selection: DataFrame, bands: list[str]) -> DataFrame:
    return _pivot(selection, 0, bands)


def selection_summary(selection: DataFrame, threshold: DataFrame | None = None) -> DataFrame:
    """Channels of each crop, with the size of the union, the least score kept, and the one row of ``threshold`` (see :func:`pooled_threshold`)."""
    per = selection.groupBy("crop_id").agg(F.count("*").alias("n_channels"))
    total = selection.agg(F.countDistinct("channel").alias("n_union"), F.min("score").alias("least_score"))
    if threshold is not None:
        total = total.join(F.broadcast(threshold), F.lit(True))  # one row
    return per.join(F.broadcast(total), F.lit(True))  # one row

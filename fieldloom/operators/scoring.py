"""Separability scores of channels, and what is derived from them.

Samples are long (``pixel_id, crop_id, channel, channel_idx, value``); one
shuffle of partial moments by crop and channel is all that touches pixels.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.channels import band_of, date_of, day_of_year, mmdd_of

MIN_PIXELS = 10


def moments(samples: DataFrame) -> DataFrame:
    """Mean, population and sample deviation and counts of every crop and channel."""
    v = F.col("value")
    return samples.groupBy("crop_id", "channel", "channel_idx").agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"), F.stddev_samp(v).alias("sd1"), F.count(v).alias("n"), F.count("*").alias("n_rows"))


def _by_channel(samples: DataFrame) -> DataFrame:
    """One row per channel with its crops' moments (``a``), so that crops are compared within the row.

    The pixels are read once; joins of the moments with themselves would read
    them again wherever Spark prunes the sides differently.
    """
    one = F.struct("crop_id", "mu", "sd", "sd1", "n", "n_rows")
    return moments(samples).groupBy("channel", "channel_idx").agg(F.sort_array(F.collect_list(one)).alias("a"))


def _each_crop(rows: DataFrame, crops: Iterable[int] | None, score) -> DataFrame:
    """``score(own, others)`` for each crop of ``crops``, or for each crop that occurs; ``own`` is null for one without rows."""
    listed = F.array(*(F.lit(c) for c in crops)) if crops is not None else F.transform("a", lambda x: x["crop_id"])
    out = rows.withColumn("crop_id", F.explode(listed))
    own = F.filter("a", lambda x: x["crop_id"] == F.col("crop_id"))
    others = F.filter("a", lambda x: x["crop_id"] != F.col("crop_id"))
    out = out.withColumns({"_own": F.get(own, F.lit(0)), "_others": others})
    return out.select("crop_id", "channel", "channel_idx", score(F.col("_own"), F.col("_others")).alias("score"))


def _mean(values: Column) -> Column:
    """Mean of an array, null for an empty one or one with a null."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def _separations(own: Column, others: Column, sd: str, eps: float) -> Column:
    return F.transform(others, lambda o: F.abs(own["mu"] - o["mu"]) / (1.96 * (own[sd] + o[sd]) + eps))


def gsi_pairwise(samples: DataFrame, crops: Iterable[int], eps: float = 1e-6, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Global separability: mean over the other crops of ``|mu - mu'| / (1.96 (sd + sd') + eps)``.

    A crop of fewer than ``min_pixels`` rows scores 0 and is no partner; a
    channel missing for one crop is missing for all its pairs, and scores 0.
    """
    enough = _by_channel(samples).withColumn("a", F.filter("a", lambda x: x["n_rows"] >= min_pixels))
    return _each_crop(enough, list(crops), lambda own, others: F.coalesce(_mean(_separations(own, others, "sd", eps)), F.lit(0.0)))


def gsi_one_vs_rest(samples: DataFrame, crops: Iterable[int], eps: float = 1e-6, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Each crop against all other crops' pixels together.

    The rest's moments come from the crops' own by merging central moments. A
    missing value scores null, a crop of few rows 0.
    """

    def score(own: Column, others: Column) -> Column:
        full = F.filter(others, lambda o: o["n"] > 0)
        total = lambda f: F.aggregate(full, F.lit(0.0), lambda acc, o: acc + f(o))
        n = F.nullif(total(lambda o: o["n"]), F.lit(0.0))
        mean = total(lambda o: o["mu"] * o["n"]) / n
        # a binding of the mean: an array of one, so that it is worked out once and not in each term
        spread = F.transform(F.array(mean), lambda m: total(lambda o: o["n"] * (o["sd"] * o["sd"] + (o["mu"] - m) * (o["mu"] - m))))[0] / n
        si = F.abs(own["mu"] - mean) / (1.96 * (own["sd"] + F.sqrt(spread)) + eps)
        return F.when(own.isNull() | (own["n_rows"] < min_pixels), 0.0).otherwise(si)

    return _each_crop(_by_channel(samples), list(crops), score)


def gsi_legacy(samples: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Pairwise with sample deviations, class 0 left out, no least number of pixels; missing pairs are skipped."""
    rows = _by_channel(samples.where(F.col("crop_id") != 0))
    return _each_crop(rows, None, lambda own, others: _mean(F.filter(_separations(own, others, "sd1", eps), lambda x: x.isNotNull())))


def _key(by: str) -> Column:
    c = F.col("channel")
    return {"band": band_of(c), "date": date_of(c), "mmdd": mmdd_of(c), "band_mmdd": F.concat_ws("_", band_of(c), mmdd_of(c))}[by]


def collapse_scores(scores: DataFrame, by: str = "band") -> DataFrame:
    """Mean score by crop and ``band``, ``date``, ``mmdd`` or ``band_mmdd``."""
    return scores.groupBy("crop_id", _key(by).alias("key")).agg(F.avg("score").alias("score"))


def score_matrix(scores: DataFrame, crops: Iterable[int]) -> DataFrame:
    """Dates by crops: the best score of each date."""
    return scores.groupBy(_key("date").alias("date8")).pivot("crop_id", list(crops)).agg(F.max("score"))


def heat_table(scores: DataFrame, crop_id: int, bands: Iterable[str]) -> DataFrame:
    """One crop's dates by bands."""
    own = scores.where(F.col("crop_id") == crop_id).select(_key("date").alias("date8"), _key("band").alias("band"), "score")
    return own.groupBy("date8").pivot("band", list(bands)).agg(F.max("score"))


def colour_ceiling(scores: DataFrame) -> DataFrame:
    """The 95th percentile of all scores, 1e-3 at least."""
    return scores.agg(F.greatest(F.percentile("score", 0.95), F.lit(1e-3)).alias("ceiling"))


def adjust_multi_year(primary: DataFrame, extras: DataFrame) -> DataFrame:
    """Each primary score averaged with the nearest date's score of the same band in every extra year.

    ``extras`` has a ``year``. Scores of a band and month-day are averaged
    first; nearness is by day of a leap year, ties going to the first in
    channel order. A year without the band adds nothing.
    """
    same = Window.partitionBy("crop_id", "_band", "_mmdd")
    own = primary.withColumns({"_band": _key("band"), "_mmdd": _key("mmdd")}).withColumn("_own", F.avg("score").over(same))
    other = extras.withColumns({"_band": _key("band"), "_mmdd": _key("mmdd")}).groupBy("year", "crop_id", "_band", "_mmdd").agg(F.avg("score").alias("_s"), F.min("channel_idx").alias("_ord"))
    o = other.select("year", F.col("crop_id").alias("_c"), F.col("_band").alias("_b"), F.col("_mmdd").alias("_m"), "_s", "_ord")
    # each side is read once; a channel meets the dates of its band in the extra years
    pairs = own.join(o, (F.col("crop_id") == F.col("_c")) & (F.col("_band") == F.col("_b")), "left")
    channel = ("crop_id", "channel", "channel_idx", "_own")
    near = pairs.groupBy(*channel, "_mmdd", "year").agg(F.min_by("_s", F.struct(F.abs(day_of_year(F.col("_m")) - day_of_year(F.col("_mmdd"))), F.col("_ord"))).alias("_s"))
    added = near.groupBy(*channel).agg(F.sum("_s").alias("_sum"), F.count("year").alias("_n"))
    mean = (F.col("_own") + F.coalesce("_sum", F.lit(0.0))) / (1 + F.col("_n"))
    return added.select("crop_id", "channel", "channel_idx", mean.alias("score"))


def rank_bands_across_years(scores: DataFrame) -> DataFrame:
    """Band means of each year, averaged over ``year``."""
    yearly = scores.groupBy("year", "crop_id", _key("band").alias("band")).agg(F.avg("score").alias("s"))
    return yearly.groupBy("crop_id", "band").agg(F.avg("s").alias("score"))


def rank_candidates(scores: DataFrame, n_dates: int = 10, n_bands: int = 9) -> DataFrame:
    """``crop_id, kind, value, score, rank``: each crop's best dates and bands by mean score.

    Dates tie by date, bands by the first channel that has them.
    """
    def best(by: str, n: int, tie: Column) -> DataFrame:
        means = scores.groupBy("crop_id", _key(by).alias("value")).agg(F.avg("score").alias("score"), F.min("channel_idx").alias("_o"))
        rank = F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), tie))
        return means.withColumn("rank", rank).where(F.col("rank") <= n).select("crop_id", F.lit(by).alias("kind"), "value", "score", "rank")

    return best("date", n_dates, F.col("value")).unionByName(best("band", n_bands, F.col("_o")))


def joint_score(gsi: DataFrame, importance: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``alpha`` x min-max GSI + (1 - alpha) x importance over all channels of either; missing is 0."""
    w = Window.partitionBy()
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    g = gsi.select("channel", ((F.col("score") - lo) / (hi - lo + 1e-9)).alias("_g"))
    i = importance.select("channel", F.col("importance").alias("_i"))
    return g.join(i, "channel", "full").select("channel", (alpha * F.coalesce("_g", F.lit(0.0)) + (1 - alpha) * F.coalesce("_i", F.lit(0.0))).alias("score"))

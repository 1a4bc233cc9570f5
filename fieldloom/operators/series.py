"""Vegetation index and time series."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Months looked for, and the dates (MMDD) to fall back on for the peak
MONTH_TARGETS = {"Jan": (1,), "Mar": (3,), "Jul": (7, 8), "Nov": (11, 10)}
PEAK_FALLBACK = ("0714", "0729", "0730")
# middles of the quarters of a leap year
QUARTER_MID = {1: 215, 2: 516, 3: 815, 4: 1115}


def _index(r: Column, n: Column, mode: str) -> Column:
    if mode == "add_eps":
        return F.when((r > 0) & (n > 0), (n - r) / (n + r + 1e-6))
    zero = F.lit(1e-6) if mode == "eps" else F.lit(None).cast("double")
    return (n - r) / F.when(n + r == 0, zero).otherwise(n + r)


def ndvi(obs: DataFrame, mode: str = "null", red: str = "B4", nir: str = "B8") -> DataFrame:
    """``pixel_id, date8, ndvi`` in one shuffle of the two bands.

    ``null``: a zero denominator gives null; ``eps``: it counts as 1e-6;
    ``add_eps``: 1e-6 is added and reflectances of 0 or less are missing.
    """
    two = obs.where(F.col("band").isin(red, nir)).groupBy("pixel_id", "date8").agg(F.max(F.when(F.col("band") == red, F.col("value"))).alias("_r"), F.max(F.when(F.col("band") == nir, F.col("value"))).alias("_n"))
    return two.select("pixel_id", "date8", _index(F.col("_r"), F.col("_n"), mode).alias("ndvi"))


def mean_ndvi_by_date(index: DataFrame, labels: DataFrame, keep: Iterable[int], min_valid: float = 0.8) -> DataFrame:
    """Mean over crop pixels where enough of them are valid."""
    crops = labels.where(F.col("cdl_id").isin(*keep)).select("pixel_id")
    out = index.join(crops, "pixel_id").groupBy("date8").agg(F.avg("ndvi").alias("_m"), (F.count("ndvi") / F.count("*")).alias("valid_frac"))
    return out.select("date8", "valid_frac", F.when(F.col("valid_frac") >= min_valid, F.col("_m")).alias("mean_ndvi"))


def mean_ndvi_of(obs: DataFrame, labels: DataFrame, keep: Iterable[int], dates: Iterable[str], min_valid: float = 0.8, mode: str = "null", red: str = "B4", nir: str = "B8", per_pass: int = 8) -> DataFrame:
    """:func:`mean_ndvi_by_date` of the :func:`ndvi` of ``obs`` on ``dates``, for one exchange of a row a pixel.

    A task first puts what it has of a pixel into one row: both bands of all
    dates, which dates there are, and the number of its labels. Index and
    labels then meet without a join. More than ``per_pass`` dates take more passes.
    """
    dates, parts = list(dates), []
    crops = labels.where(F.col("cdl_id").isin(*keep)).select("pixel_id", F.lit(1).alias("_k"))
    for first in range(0, len(dates), per_pass):
        own = dates[first : first + per_pass]
        rows = obs.where(F.col("band").isin(red, nir) & F.col("date8").isin(*own)).select("pixel_id", "date8", "band", "value").unionByName(crops, allowMissingColumns=True)
        on = lambda d, b: F.max(F.when((F.col("date8") == d) & (F.col("band") == b), F.col("value")))
        bands = [on(d, b).alias(f"_{x}{i}") for i, d in enumerate(own) for x, b in (("r", red), ("n", nir))]
        place = functools.reduce(lambda c, i: c.when(F.col("date8") == own[i], F.lit(1 << i)), range(1, len(own)), F.when(F.col("date8") == own[0], F.lit(1)))
        wide = rows.where(F.col("pixel_id").isNotNull()).groupBy("pixel_id").agg(F.sum("_k").alias("_k"), F.bit_or(place.cast("long")).alias("_d"), *bands).where("_k > 0 and _d > 0")
        each = (F.struct(F.lit(d).alias("date8"), (F.col("_d").bitwiseAND(1 << i) > 0).alias("there"), _index(F.col(f"_r{i}"), F.col(f"_n{i}"), mode).alias("ndvi")) for i, d in enumerate(own))
        parts.append(wide.select("_k", F.explode(F.array(*each)).alias("_c")).where("_c.there").select("_c.date8", "_k", "_c.ndvi"))
    if not parts:
        return obs.sparkSession.createDataFrame([], "date8 string, valid_frac double, mean_ndvi double")
    n_valid = F.sum(F.when(F.col("ndvi").isNotNull(), F.col("_k")).otherwise(0))
    out = functools.reduce(DataFrame.unionByName, parts).groupBy("date8").agg((F.sum(F.col("ndvi") * F.col("_k")) / F.nullif(n_valid, F.lit(0))).alias("_m"), (n_valid / F.sum("_k")).alias("valid_frac"))
    return out.select("date8", "valid_frac", F.when(F.col("valid_frac") >= min_valid, F.col("_m")).alias("mean_ndvi"))


def peak_ndvi_date(scores: DataFrame) -> DataFrame:
    """One row ``date8``: the highest mean (ties: earliest); without any mean a July date, else the last date."""
    fallback = F.coalesce(F.min(F.when(F.substring("date8", 5, 4).isin(*PEAK_FALLBACK), F.col("date8"))), F.max("date8"))
    best = F.min_by("date8", F.when(F.col("mean_ndvi").isNotNull(), F.struct(-F.col("mean_ndvi"), F.col("date8"))))
    return scores.agg(F.coalesce(best, fallback).alias("date8"))


def quarterly_dates(scores: DataFrame) -> DataFrame:
    """``quarter, date8``: the best mean rounded to five places in each quarter (ties: earliest).

    A quarter without a mean takes the date nearest its middle by the distance
    of MMDD as whole numbers. A few rows a year.
    """
    q = F.ceil(F.substring("date8", 5, 2).cast("int") / 3).cast("int")
    rounded = scores.withColumn("q", q).withColumn("m", F.round("mean_ndvi", 5))
    best = rounded.where("m is not null").groupBy("q").agg(F.min_by("date8", F.struct(-F.col("m"), F.col("date8"))).alias("best"))
    mids = F.explode(F.array(*(F.struct(F.lit(k).alias("quarter"), F.lit(v).alias("mid")) for k, v in QUARTER_MID.items())))
    away = F.abs(F.substring("date8", 5, 4).cast("int") - F.col("mid"))
    near = scores.select("date8", mids.alias("_q")).select("date8", "_q.quarter", "_q.mid").groupBy("quarter").agg(F.min_by("date8", F.struct(away, F.col("date8"))).alias("near"))
    return near.join(best, near["quarter"] == best["q"], "left").select("quarter", F.coalesce("best", "near").alias("date8"))


def month_target_dates(dates: DataFrame, targets: dict[str, tuple[int, ...]] = MONTH_TARGETS) -> DataFrame:
    """``label, date8``: the first date in any of each label's months; under two hits, all dates as D0, D1, ..."""
    months = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(m).alias("month")) for k, ms in targets.items() for m in ms)))
    dates = dates.select("date8").distinct()
    hits = dates.withColumn("_t", months).where(F.substring("date8", 5, 2).cast("int") == F.col("_t.month")).groupBy("_t.label").agg(F.min("date8").alias("date8"))
    n = F.count("*").over(Window.partitionBy())
    hits = hits.select("label", "date8", n.alias("_n")).where("_n >= 2").drop("_n")
    every = dates.select(F.concat(F.lit("D"), F.row_number().over(Window.orderBy("date8")) - 1).alias("label"), "date8")
    none = hits.limit(1).select(F.lit(1).alias("_any"))
    return hits.unionByName(every.join(none, F.lit(True), "left_anti"))


def ndvi_profile(index: DataFrame) -> DataFrame:
    return index.groupBy("date8").agg(F.avg("ndvi").alias("mean_ndvi"))


def ndvi_profile_by_class(index: DataFrame, labels: DataFrame, classes: Iterable[int]) -> DataFrame:
    """Mean by class and date; a class without pixels has null on every date."""
    own = labels.where(F.col("cdl_id").isin(*classes)).select("pixel_id", F.col("cdl_id").cast("int").alias("cdl_id"))
    means = index.join(own, "pixel_id").groupBy("cdl_id", "date8").agg(F.avg("ndvi").alias("mean_ndvi"))
    grid = index.select("date8").distinct().withColumn("cdl_id", F.explode(F.array(*(F.lit(k) for k in classes))))
    return grid.join(means, ["cdl_id", "date8"], "left").select("cdl_id", "date8", "mean_ndvi")


def spectral_profile(obs: DataFrame, dates: Iterable[str]) -> DataFrame:
    return obs.where(F.col("date8").isin(*dates)).groupBy("date8", "band").agg(F.avg("value").alias("mean_value"))


def median_composite(obs: DataFrame, stats: DataFrame, bands: Iterable[str], stride: int = 1) -> DataFrame:
    """Median over dates for each pixel and band, scaled by the band's ``lo`` and ``hi`` to [0, 1]; missing is 0."""
    some = obs.where(F.col("band").isin(*bands) & (F.col("r") % stride == 0) & (F.col("c") % stride == 0))
    med = some.groupBy("pixel_id", "r", "c", "band").agg(F.median("value").alias("m"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("m"))
    # as many rows as bands
    return med.join(F.broadcast(stats.where(F.col("band").isin(*bands))), "band").select("pixel_id", "r", "c", "band", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, F.lit(0.0)))).alias("value"))


def percentile_stretch(obs: DataFrame, lo: float = 2, hi: float = 98, accuracy: int | None = None) -> DataFrame:
    """Each scene's band stretched between two percentiles to [0, 1]; a scene's band without valid values is all 0.

    With ``accuracy`` the percentiles are approximate and merge from partial
    summaries; exact ones gather the distinct values of a scene's band.
    """
    q = lambda p: F.percentile("value", p) if accuracy is None else F.percentile_approx("value", p, accuracy)
    stats = obs.groupBy("date8", "band").agg(q(lo / 100).alias("_lo"), q(hi / 100).alias("_hi"))
    joined = obs.join(F.broadcast(stats), ["date8", "band"])  # dates x bands rows
    scaled = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    clipped = F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))
    return joined.select("pixel_id", "date8", "band", F.when(F.col("_lo").isNull(), 0.0).otherwise(clipped).alias("value"))

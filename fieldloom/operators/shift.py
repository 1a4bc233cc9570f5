"""Distribution shift between a training area and others (``area, pixel_id, band, value``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import exact_percentiles

WARN_MEAN, WARN_STD = 0.15, 0.20
TAILS = {"p5": 0.05, "p95": 0.95}


def reference_date(dates: DataFrame) -> DataFrame:
    """One row: the middle July date, else the middle date (place n div 2 from 0). A few dates."""
    d = dates.select("date8").distinct().withColumn("july", F.substring("date8", 5, 2) == "07")
    w = Window.partitionBy("july")
    placed = d.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("date8")) - 1)
    every = d.select("date8", "july", F.count("*").over(Window.partitionBy()).alias("_n"), (F.row_number().over(Window.orderBy("date8")) - 1).alias("_k"))
    mid = F.floor(F.col("_n") / 2) == F.col("_k")
    return placed.where(F.col("july") & mid).select("date8", F.lit(0).alias("_p")).unionByName(every.where(mid).select("date8", F.lit(1).alias("_p"))).agg(F.min_by("date8", "_p").alias("date8"))


def area_stats(samples: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Mean, population deviation and 5th and 95th percentile by area and band; counted exactly, or approximate with ``accuracy``."""
    moments = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    if accuracy is not None:
        return samples.groupBy("area", "band").agg(*moments, *(F.percentile_approx("value", p, accuracy).alias(name) for name, p in TAILS.items()))
    return samples.groupBy("area", "band").agg(*moments).join(exact_percentiles(samples, ["area", "band"], "value", TAILS), ["area", "band"])


def shift_report(stats: DataFrame, train: str = "train") -> DataFrame:
    """Relative shift of mean and deviation against the training area, with a warning and the verdict over all."""
    t = stats.where(F.col("area") == train).select("band", F.col("mean").alias("_m"), F.col("std").alias("_s"))
    j = stats.where(F.col("area") != train).join(F.broadcast(t), "band")  # as many rows as bands
    out = j.select("area", "band", (F.abs(F.col("mean") - F.col("_m")) / (F.abs("_m") + 1e-9)).alias("d_mean"), (F.abs(F.col("std") - F.col("_s")) / (F.abs("_s") + 1e-9)).alias("d_std"))
    out = out.withColumn("warn", (F.col("d_mean") > WARN_MEAN) | (F.col("d_std") > WARN_STD))
    return out.withColumn("shift", F.bool_or("warn").over(Window.partitionBy()))


def _bin(lo, hi, bins: int):
    """0 .. bins - 1; the greatest value belongs to the last bin."""
    at = F.floor((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    return F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")


def sym_kl(samples: DataFrame, train: str = "train", bins: int = 100, eps: float = 1e-10) -> DataFrame:
    """``area, band, kl``: symmetric divergence over equal bins of both areas' common range."""
    some = samples.where(F.col("value").isNotNull())
    r = some.groupBy("area", "band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    t = r.where(F.col("area") == train).select("band", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    pairs = r.where(F.col("area") != train).join(t, "band").select(F.col("area").alias("other"), "band", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))
    # one row for each other area and band
    own = some.join(F.broadcast(pairs), "band").where((F.col("area") == F.col("other")) | (F.col("area") == train))
    counted = own.groupBy("other", "band", _bin(F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.sum((F.col("area") == train).cast("long")).alias("p"), F.sum((F.col("area") != train).cast("long")).alias("q"))
    grid = pairs.select("other", "band", ((F.col("hi") - F.col("lo")) / bins).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counted, ["other", "band", "bin"], "left").na.fill(0, ["p", "q"])
    w = Window.partitionBy("other", "band")
    density = lambda c: F.col(c) / F.sum(c).over(w) / F.coalesce(F.nullif(F.col("_w"), F.lit(0.0)), F.lit(1.0)) + eps
    d = full.withColumns({"_p": density("p"), "_q": density("q")}).withColumns({"_ps": F.sum("_p").over(w), "_qs": F.sum("_q").over(w)})
    p, q = F.col("_p") / F.col("_ps"), F.col("_q") / F.col("_qs")
    return d.groupBy(F.col("other").alias("area"), "band").agg((0.5 * (F.sum(p * F.log(p / q)) + F.sum(q * F.log(q / p)))).alias("kl"))


def density_histogram(samples: DataFrame, bins: int = 120) -> DataFrame:
    """``area, band, bin, density`` over each area's own range, empty bins included."""
    some = samples.where(F.col("value").isNotNull())
    r = some.groupBy("area", "band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    counted = some.join(F.broadcast(r.drop("n")), ["area", "band"]).groupBy("area", "band", _bin(F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("k"))
    grid = r.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, ["area", "band", "bin"], "left").select("area", "band", "bin", (F.coalesce("k", F.lit(0)) / (F.col("n") * F.nullif(width, F.lit(0.0)))).alias("density"))

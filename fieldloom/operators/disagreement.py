"""Settling disagreements of labels and predictions by vegetation-index series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import exact_percentiles
from fieldloom.operators.sampling import hash_order
from fieldloom.sources.shared import materialise

MIN_AGREEMENT = 100


def agreement(pred: DataFrame) -> DataFrame:
    same = F.col("gt_class") == F.col("pred_class")
    return pred.agg(F.sum(same.cast("long")).alias("n_agree"), F.sum((~same).cast("long")).alias("n_disagree"))


def characteristic_series(index: DataFrame, pred: DataFrame, min_px: int = MIN_AGREEMENT, accuracy: int | None = None) -> DataFrame:
    """``class_id, date8, ref, var``: median index of agreeing pixels of each class and date.

    Classes of fewer than ``min_px`` agreeing pixels have none. ``var`` is the
    population variance of the class's series. The exact median is counted, so
    a class that holds nearly all pixels is no task's alone; with ``accuracy``
    an approximate one takes a single pass.
    """
    agree = pred.where(F.col("gt_class") == F.col("pred_class")).select("pixel_id", F.col("gt_class").alias("class_id"))
    enough = agree.groupBy("class_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_px).select("class_id")
    met = index.join(agree.join(F.broadcast(enough), "class_id"), "pixel_id").select("class_id", "date8", "ndvi")  # as many rows as classes
    if accuracy is None:
        series = exact_percentiles(materialise(met), ["class_id", "date8"], "ndvi", {"ref": 0.5})
    else:
        series = met.groupBy("class_id", "date8").agg(F.percentile_approx("ndvi", 0.5, accuracy).alias("ref"))
    return series.join(series.groupBy("class_id").agg(F.var_pop("ref").alias("var")), "class_id")


def disagreement_scores(index: DataFrame, pred: DataFrame, series: DataFrame) -> DataFrame:
    """``pixel_id, gt_class, pred_class, nmse_gt, nmse_pred, verdict`` of the disagreeing pixels that can be scored.

    Pixels that agree are filtered out before the index is joined; the series
    (classes x dates rows) are broadcast.
    """
    dis = pred.where(F.col("gt_class") != F.col("pred_class")).select("pixel_id", "gt_class", "pred_class")
    g = series.select(F.col("class_id").alias("gt_class"), "date8", F.col("ref").alias("_g"), F.col("var").alias("_vg"))
    p = series.select(F.col("class_id").alias("pred_class"), "date8", F.col("ref").alias("_p"), F.col("var").alias("_vp"))
    rows = index.join(dis, "pixel_id").join(F.broadcast(g), ["gt_class", "date8"]).join(F.broadcast(p), ["pred_class", "date8"])
    sq = lambda ref, var: F.avg((F.col("ndvi") - F.col(ref)) ** 2) / F.nullif(F.max(var), F.lit(0.0))
    out = rows.groupBy("pixel_id", "gt_class", "pred_class").agg(sq("_g", "_vg").alias("nmse_gt"), sq("_p", "_vp").alias("nmse_pred"))
    return out.where("nmse_gt is not null and nmse_pred is not null").withColumn("verdict", F.when(F.col("nmse_pred") < F.col("nmse_gt"), "pred").otherwise("gt"))


def disagreement_summary(scores: DataFrame) -> DataFrame:
    """For each class on either side: disagreements, wins, win rate and mean errors to four places."""
    sides = scores.withColumn("class_id", F.explode(F.array("gt_class", "pred_class")))
    won = (F.col("verdict") == "pred").cast("long")
    return sides.groupBy("class_id").agg(
        F.count("*").alias("n_disagreement"), F.sum(1 - won).alias("gt_wins"), F.sum(won).alias("pred_wins"),
        F.round(F.avg(won.cast("double")), 4).alias("pred_win_rate"), F.round(F.avg("nmse_gt"), 4).alias("mean_nmse_gt"), F.round(F.avg("nmse_pred"), 4).alias("mean_nmse_pred"),
    )


def disagreement_overall(pred: DataFrame, index: DataFrame, scores: DataFrame) -> DataFrame:
    counts, dates = agreement(pred), index.agg(F.countDistinct("date8").alias("n_dates"))
    scored = scores.agg(F.count("*").alias("n_scored"), F.round(F.avg((F.col("verdict") == "pred").cast("double")), 4).alias("pred_win_rate"))
    return counts.join(F.broadcast(dates), F.lit(True)).join(F.broadcast(scored), F.lit(True))  # one row each


def verdict_map(pred: DataFrame, scores: DataFrame) -> DataFrame:
    """``pixel_id, patch_id, verdict``: 0 agreement, 1 prediction wins, 2 label wins, 3 not scored."""
    v = scores.select("pixel_id", F.col("verdict").alias("_v"))
    code = F.when(F.col("gt_class") == F.col("pred_class"), 0).when(F.col("_v") == "pred", 1).when(F.col("_v") == "gt", 2).otherwise(3)
    return pred.join(v, "pixel_id", "left").select("pixel_id", "patch_id", code.alias("verdict"))


def patch_verdicts(verdicts: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("verdict") == k).cast("long"))
    return verdicts.groupBy("patch_id").agg(n(1).alias("pred_wins"), n(2).alias("gt_wins"), n(3).alias("unscored"), (n(1) / F.nullif(n(1) + n(2), F.lit(0))).alias("pred_win_rate"))


def scatter_sample(scores: DataFrame, n: int = 50_000, seed: int = 0) -> DataFrame:
    return scores.withColumn("_h", hash_order("pixel_id", seed)).orderBy("_h", "pixel_id").limit(n).drop("_h")


def scatter_limit(scores: DataFrame) -> DataFrame:
    """99th percentile of both errors together."""
    return scores.select(F.explode(F.array("nmse_gt", "nmse_pred")).alias("x")).agg(F.percentile("x", 0.99).alias("limit"))

"""Selectors from samples, or from observations and labels of several years, to a selection of channels in one call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import forest, sampling, scoring, selection
from fieldloom.operators.cleaning import KEEP_CLASSES
from fieldloom.sources import outputs
from fieldloom.sources.shared import materialise


def _chosen(scores: DataFrame, top_k: int | None, percentile: float | None, threshold: float | None) -> DataFrame:
    if top_k is not None:
        return selection.select_top_k(scores, top_k)
    return selection.select_percentile(scores, percentile) if percentile is not None else selection.select_threshold(scores, threshold)


def _mode(top_k: int | None, percentile: float | None, threshold: float | None) -> dict[str, str]:
    given = {k: v for k, v in (("top_k", top_k), ("percentile", percentile), ("score_threshold", threshold)) if v is not None}
    if len(given) != 1:
        raise ValueError("give one of top_k, percentile and threshold")
    return {"mode": next(iter(given)), "param": f"{next(iter(given.values())):g}"}


def gsi_direct(samples: DataFrame, top_k: int | None = None, threshold: float | None = None, crops: Iterable[int] = KEEP_CLASSES, digits: int = 6, percentile: float | None = None) -> DataFrame:
    """``crop_id, crop_order, rank, channel, score``: each crop's channels by pairwise separability.

    ``samples`` is long (crop_id, channel, channel_idx, band, date8, value), of
    one year. Scores are rounded to ``digits`` before they are ranked, so that
    ties are the same in every engine. :func:`selection.union_channels` joins the crops' channels.
    """
    _mode(top_k, percentile, threshold)
    scores = scoring.gsi_pairwise(samples, crops).withColumn("score", F.round("score", digits))
    return _chosen(scores, top_k, percentile, threshold)


def long_samples(obs: DataFrame, labels: DataFrame, channels: DataFrame, frac: float = 0.2, seed: int = 42, crops: Iterable[int] = KEEP_CLASSES) -> DataFrame:
    """``pixel_id, crop_id, channel, channel_idx, value`` of a hashed share of the labelled pixels of ``crops``."""
    own = labels.where(F.col("cdl_id").isin(*crops))
    ids = (own if frac >= 1 else sampling.sample_ids(own, frac, seed)).select("pixel_id", F.col("cdl_id").cast("int").alias("crop_id"))
    named = obs.select("pixel_id", F.concat_ws("_", "band", "date8").alias("channel"), "value")
    return named.join(F.broadcast(channels.select("channel", "channel_idx")), "channel").join(ids, "pixel_id")  # a few hundred channels


def run_gsi_direct(
    years: list[tuple[int, DataFrame, DataFrame, DataFrame]], top_k: int | None = None, percentile: float | None = None, threshold: float | None = None,
    frac: float = 0.2, seed: int = 42, crops: Iterable[int] = KEEP_CLASSES, digits: int = 6, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The selection and the scores it was made of, from ``(year, obs, labels, channels)`` of each year, the primary one first.

    Every year's labelled pixels are sampled and scored on their own; the first
    year's scores are averaged with those of the nearest dates of the others.
    ``percentile`` is pooled over all crops. With ``path`` the selection, its
    union and its tables are written there. The scores, crops x channels rows, are written once, so no
    pixel is read twice.
    """
    mode, crops = _mode(top_k, percentile, threshold), list(crops)
    scored = [(year, materialise(scoring.gsi_pairwise(long_samples(obs, labels, channels, frac, seed, crops), crops))) for year, obs, labels, channels in years]
    scores = scored[0][1]
    if len(scored) > 1:
        extras = [s.withColumn("year", F.lit(year)) for year, s in scored[1:]]
        every = extras[0]
        for e in extras[1:]:
            every = every.unionByName(e)
        scores = scoring.adjust_multi_year(scores, every)
    scores = materialise(scores.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), digits)))
    chosen = materialise(_chosen(scores, top_k, percentile, threshold))
    if path is not None:
        meta = {"selector": "gsi_direct", **mode, "years": ",".join(str(y) for y, _ in scored), "primary_year": str(scored[0][0])}
        outputs.write_selection(chosen, path, meta)
        outputs.write_tables(chosen, path)
    return chosen, scores


def wide_samples(obs: DataFrame, ids: DataFrame, channels: DataFrame) -> DataFrame:
    """``pixel_id, class_label, features array<double>`` by ``channel_idx`` of ``channels``; null where a channel is missing."""
    own = obs.select("pixel_id", F.concat_ws("_", "band", "date8").alias("channel"), "value").join(F.broadcast(channels.select("channel", "channel_idx")), "channel")
    cells = own.join(ids, "pixel_id").groupBy("pixel_id", "class_label").agg(F.map_from_entries(F.collect_list(F.struct("channel_idx", "value"))).alias("m"))
    n = channels.count()
    return cells.select("pixel_id", "class_label", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at("m", i)).alias("features"))


def rf_direct(samples: DataFrame, channels: DataFrame, folder: str, top_k: int | None = None, threshold: float | None = None, trees: int = 500, depth: int = 12, percentile: float | None = None) -> DataFrame:
    """As :func:`gsi_direct`, by a forest's class-conditional importance; ``samples`` is wide (see :mod:`forest`).

    ``folder`` is one that the driver and all executors share; the model is saved there.
    """
    _mode(top_k, percentile, threshold)
    model, classes, _ = forest.train_forest(samples, channels.count(), trees, depth)
    return _chosen(forest.class_importance(model, classes, channels, folder), top_k, percentile, threshold)


def run_rf_direct(
    years: list[tuple[int, DataFrame, DataFrame, DataFrame]], folder: str, top_k: int | None = None, percentile: float | None = None, threshold: float | None = None,
    frac: float = 0.2, seed: int = 42, trees: int = 500, depth: int = 12, most_pixels: int = 1_000_000, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As :func:`run_gsi_direct`, by a forest for each year; ``most_pixels`` is the documented bound of a forest's sample."""
    mode = _mode(top_k, percentile, threshold)
    scored = []
    for year, obs, labels, channels in years:
        own = sampling.sample_ids(labels.where(F.col("cdl_id").isin(*KEEP_CLASSES)), frac, seed)
        ids = sampling.cap_rows(own, most_pixels, seed).select("pixel_id", F.col("cdl_id").cast("int").alias("class_label"))
        local = channels.select("channel", (F.row_number().over(Window.orderBy("channel_idx")) - 1).alias("channel_idx"))  # channels
        model, classes, _ = forest.train_forest(wide_samples(obs, ids, local), local.count(), trees, depth, seed)
        scored.append((year, materialise(forest.class_importance(model, classes, local, folder))))
    scores = scored[0][1]
    if len(scored) > 1:
        every = scored[1][1].withColumn("year", F.lit(scored[1][0]))
        for year, s in scored[2:]:
            every = every.unionByName(s.withColumn("year", F.lit(year)))
        scores = materialise(scoring.adjust_multi_year(scores, every))
    chosen = materialise(_chosen(scores, top_k, percentile, threshold))
    if path is not None:
        outputs.write_selection(chosen, path, {"selector": "rf_direct", **mode, "years": ",".join(str(y) for y, _ in scored), "primary_year": str(scored[0][0])})
        outputs.write_tables(chosen, path)
    return chosen, scores


def scoped_gsi(samples: DataFrame, dates: DataFrame, top: int, crops: Iterable[int] = KEEP_CLASSES) -> DataFrame:
    """``crop_id, band, score, rank``: each crop's bands by one-vs-rest separability on the given dates only."""
    part = samples.join(dates.select("date8").distinct(), "date8", "left_semi")
    bands = scoring.collapse_scores(scoring.gsi_one_vs_rest(part, crops), "band").select("crop_id", F.col("key").alias("band"), F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), "band"))
    return bands.withColumn("rank", rank).where(F.col("rank") <= top)


def scoped_forest(obs: DataFrame, labels: DataFrame, channels: DataFrame, dates: DataFrame, folder: str, top: int, frac: float = 0.2, seed: int = 42, trees: int = 500, depth: int = 12) -> DataFrame:
    """As :func:`scoped_gsi`, by a forest on the channels of the given dates only; only their observations are read.

    Dates, channels and samples are written once, as every pass of the forest would make them anew from all observations.
    """
    days = materialise(dates.select("date8").distinct())
    own = materialise(channels.join(F.broadcast(days), "date8", "left_semi").select("channel", (F.row_number().over(Window.orderBy("channel_idx")) - 1).alias("channel_idx")))  # channels
    ids = sampling.sample_ids(labels.where(F.col("cdl_id").isin(*KEEP_CLASSES)), frac, seed).select("pixel_id", F.col("cdl_id").cast("int").alias("class_label"))
    samples = materialise(wide_samples(obs.join(F.broadcast(days), "date8", "left_semi"), ids, own))
    return forest.rank_bands_forest(samples, own, own, folder, trees, top, depth)

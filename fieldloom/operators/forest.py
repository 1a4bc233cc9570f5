"""Random-forest scores on MLlib, and selection by correlation and by trial.

Samples are wide: ``pixel_id, class_label, features array<double>``, null where
a channel is missing. A channel catalogue (``channel, channel_idx``) names the
places of the array.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.cleaning import KEEP_CLASSES
from fieldloom.operators.quantiles import exact_percentiles
from fieldloom.operators.sampling import hash_order


def _classes(samples: DataFrame) -> list[int]:
    return sorted(r[0] for r in samples.select("class_label").distinct().collect())  # a few classes


def impute(samples: DataFrame, n_channels: int) -> DataFrame:
    """Missing channels filled with the channel's median (0 where it has none); dense vectors."""
    values = samples.select(F.posexplode("features").alias("j", "x"))
    found = {r["j"]: r["m"] or 0.0 for r in exact_percentiles(values, ["j"], "x", {"m": 0.5}).collect()}  # one row for each channel
    fill = F.array(*(F.lit(float(found.get(j, 0.0))) for j in range(n_channels)))
    return samples.withColumn("x", array_to_vector(F.zip_with("features", fill, lambda v, m: F.coalesce(v, m))))


def _indexed(samples: DataFrame, classes: list[int]) -> DataFrame:
    """``label`` as places in ``classes``, and balanced weights ``N / (K n_c)``."""
    counts = {r[0]: r[1] for r in samples.groupBy("class_label").count().collect()}
    n = sum(counts.values())
    label = F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))))
    weight = F.create_map(*(F.lit(x) for c in classes for x in (c, n / (len(classes) * counts[c]))))
    return samples.withColumns({"label": label[F.col("class_label")], "w": weight[F.col("class_label")]})


def held_out(fold: int = 0, folds: int = 5) -> Column:
    return F.conv(F.substring(hash_order("pixel_id", 7), 1, 6), 16, 10).cast("long") % folds == fold


def train_forest(samples: DataFrame, n_channels: int, trees: int = 500, depth: int = 12, seed: int = 42) -> tuple[RandomForestClassificationModel, list[int], float]:
    """A balanced multi-class forest, its classes, and its accuracy on a fifth of the pixels held out by hash.

    The forest returned is fitted on the other four fifths. MLlib has no
    out-of-bag score; see :func:`bagged_forest`.
    """
    classes = _classes(samples)
    data = _indexed(impute(samples, n_channels), classes).select("pixel_id", "x", "label", "w").persist()
    try:
        rf = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
        model = rf.fit(data.where(~held_out()))
        accuracy = model.transform(data.where(held_out())).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    finally:
        data.unpersist()
    return model, classes, accuracy or 0.0


def saved_nodes(model: RandomForestClassificationModel, folder: str) -> DataFrame:
    """``tree, id, impurity, n, stats, left, right, feature`` of every node, from the saved model's own table."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{folder.rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    d = spark.read.parquet(f"{path}/data")
    return d.select(F.col("treeID").alias("tree"), "nodeData.id", "nodeData.impurity", F.col("nodeData.rawCount").alias("n"), F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"))


def node_importance(nodes: DataFrame, share: str = "counts") -> DataFrame:
    """``class_idx, feature, importance``: class-conditional mean decrease in impurity.

    For each split of positive gain: the class's share of its root count at the
    node x the node's share of rows x the gain, averaged over trees and scaled
    to sum 1 for each class. ``share='fraction'`` divides node and root counts
    by their totals first.
    """
    child = lambda side: nodes.select(F.col("tree").alias(f"_t{side}"), F.col("id").alias(f"_i{side}"), F.col("impurity").alias(f"_g{side}"), F.col("n").alias(f"_n{side}"))
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    root = nodes.where("id = 0").select(F.col("tree").alias("_tr"), F.col("stats").alias("_rs"), F.col("n").alias("_rn"))
    j = nodes.where("left >= 0").join(child("l"), (F.col("tree") == F.col("_tl")) & (F.col("left") == F.col("_il"))).join(child("r"), (F.col("tree") == F.col("_tr")) & (F.col("right") == F.col("_ir")))
    j = j.drop("_tr").join(root, F.col("tree") == F.col("_tr"))
    gain = F.col("impurity") - F.col("_nl") / F.col("n") * F.col("_gl") - F.col("_nr") / F.col("n") * F.col("_gr")
    j = j.withColumn("_w", F.col("n") / F.col("_rn") * gain).where(gain > 0)
    scale = F.lit(1.0) if share == "counts" else total("_rs") / total("stats")
    each = j.select("feature", (F.col("_w") * scale).alias("_w"), F.posexplode(F.zip_with("stats", "_rs", lambda a, b: F.when(b > 0, a / b).otherwise(0.0))).alias("class_idx", "_s"))
    summed = each.groupBy("class_idx", "feature").agg(F.sum(F.col("_s") * F.col("_w")).alias("s"))
    whole = summed.groupBy("class_idx").agg(F.sum("s").alias("_t"))
    return summed.join(F.broadcast(whole), "class_idx").select("class_idx", "feature", F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(0.0).alias("importance"))  # as many rows as classes


def class_importance(model: RandomForestClassificationModel, classes: list[int], channels: DataFrame, folder: str, crops: Iterable[int] = KEEP_CLASSES, share: str = "counts") -> DataFrame:
    """``crop_id, channel, channel_idx, score`` for all crops and channels; an absent class scores 0."""
    imp = node_importance(saved_nodes(model, folder), share)
    ids = F.array(*(F.lit(c) for c in classes))
    named = imp.select(ids[F.col("class_idx")].alias("crop_id"), F.col("feature").alias("channel_idx"), "importance")
    grid = channels.select("channel", "channel_idx").withColumn("crop_id", F.explode(F.array(*(F.lit(c) for c in crops))))
    return grid.join(named, ["crop_id", "channel_idx"], "left").select("crop_id", "channel", "channel_idx", F.coalesce("importance", F.lit(0.0)).alias("score"))


def forest_importance(model: RandomForestClassificationModel, channels: DataFrame) -> DataFrame:
    """``channel, importance``, min-max scaled (+1e-9)."""
    values = model.featureImportances.toArray()
    lo, hi = values.min(), values.max()
    table = F.array(*(F.lit(float((v - lo) / (hi - lo + 1e-9))) for v in values))
    return channels.select("channel", table[F.col("channel_idx")].alias("importance"))


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers by average linkage, merging while the least distance is ``cut`` or less."""
    n = len(distance)
    d, sizes, own = distance.astype(float).copy(), np.ones(n), [[i] for i in range(n)]
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, bool)
    while live.sum() > 1:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        own[i] += own[j]
        live[j] = False
    out = [0] * n
    for k, i in enumerate(np.flatnonzero(live)):
        for m in own[i]:
            out[m] = k
    return out


def cluster_channels(samples: DataFrame, scores: dict[str, float], channels: list[str], corr: float = 0.9, per_cluster: float = 1, variable: bool = False, most: int | None = None) -> list[str]:
    """The best-scored channels of each cluster of correlated ones.

    The correlation is one Spark job; linkage runs on the channels' matrix (a
    few hundred a side) on the driver.
    """
    matrix = Correlation.corr(impute(samples, len(channels)), "x").first()[0].toArray()
    found = average_linkage(1 - np.abs(np.nan_to_num(matrix)), 1 - corr)
    rows = [(name, int(k), float(scores[name]), i) for i, (name, k) in enumerate(zip(channels, found, strict=True))]
    own = samples.sparkSession.createDataFrame(rows, "channel string, cluster int, score double, place int")
    within = Window.partitionBy("cluster")
    quota = F.greatest(F.lit(1), F.ceil(F.count("*").over(within) * per_cluster)) if variable else F.lit(int(per_cluster))
    ranked = own.withColumns({"quota": quota, "rank": F.row_number().over(within.orderBy(F.desc("score"), "place"))})
    best = ranked.where(F.col("rank") <= F.col("quota")).orderBy(F.desc("score"), "place")
    return [r["channel"] for r in (best if most is None else best.limit(most)).collect()]  # channels


def _macro_f1(predicted: DataFrame) -> float:
    """From the counts of (label, prediction)."""
    cells = {(r[0], r[1]): r[2] for r in predicted.groupBy("label", "prediction").count().collect()}  # classes squared at most
    labels = {k for pair in cells for k in pair}
    scores = []
    for k in labels:
        tp = cells.get((k, k), 0)
        wrong = sum(v for (a, b), v in cells.items() if (a == k) != (b == k))
        scores.append(2 * tp / (2 * tp + wrong) if tp or wrong else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def evaluate_combinations(samples: DataFrame, channels: list[str], chosen: list[str], max_size: int = 5, folds: int = 3, trees: int = 100, at_once: int = 4) -> DataFrame:
    """``combo, mean_f1, std_f1`` of every combination of 2 to ``max_size`` channels, best first.

    Each one is scaled and fitted on hashed folds; ``at_once`` combinations are
    fitted at a time over the cached samples.
    """
    classes = _classes(samples)
    data = _indexed(impute(samples, len(channels)), classes).persist()

    def evaluate(combo: tuple[str, ...]) -> tuple[list[str], float, float]:
        part = data.withColumn("sub", array_to_vector(F.array(*(vector_to_array("x")[channels.index(c)] for c in combo))))
        scores = []
        for f in range(folds):
            fit, test = part.where(~held_out(f, folds)), part.where(held_out(f, folds))
            scaler: StandardScalerModel = StandardScaler(inputCol="sub", outputCol="scaled", withMean=True).fit(fit)
            model = RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, seed=0).fit(scaler.transform(fit))
            scores.append(_macro_f1(model.transform(scaler.transform(test))))
        return list(combo), float(np.mean(scores)), float(np.std(scores))

    combos = [c for size in range(2, min(max_size, len(chosen)) + 1) for c in itertools.combinations(chosen, size)]
    try:
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(evaluate, combos))
    finally:
        data.unpersist()
    return samples.sparkSession.createDataFrame(rows, "combo array<string>, mean_f1 double, std_f1 double").orderBy(F.desc("mean_f1"))


def rank_bands_forest(samples: DataFrame, channels: DataFrame, domain: DataFrame, folder: str, trees: int = 500, top: int = 9, depth: int = 12) -> DataFrame:
    """``crop_id, band, score, rank``: a forest on the domain's channels only, importance averaged by band."""
    from fieldloom.operators.scoring import collapse_scores

    own = [(r["channel"], r["channel_idx"]) for r in channels.join(domain.select("channel"), "channel", "left_semi").orderBy("channel_idx").collect()]  # a channel a row
    if not own:
        raise ValueError("no channel of the domain is in the data")
    part = samples.withColumn("features", F.array(*(F.col("features")[i] for _, i in own)))
    local = samples.sparkSession.createDataFrame([(c, i) for i, (c, _) in enumerate(own)], "channel string, channel_idx int")
    model, classes, _ = train_forest(part, len(own), trees, depth)
    bands = collapse_scores(class_importance(model, classes, local, folder), "band").withColumnRenamed("key", "band")
    rank = F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), "band"))
    return bands.withColumn("rank", rank).where(F.col("rank") <= top)


@dataclass
class _Choice:
    """Channels chosen so far, the IoU they reach, and how many candidates in a row have not helped."""

    channels: tuple[str, ...] = ()
    iou: float = 0.0
    idle: int = 0

    def after(self, channel: str, iou: float, delta: float) -> _Choice:
        if iou - self.iou < delta:
            return replace(self, idle=self.idle + 1)
        return _Choice((*self.channels, channel), iou)


def _iou(data: DataFrame, places: list[int], trees: int) -> float:
    """The class's IoU on the held-out fifth, of a small forest on the channels at ``places``."""
    part = data.withColumn("sub", array_to_vector(F.array(*(vector_to_array("x")[i] for i in places))))
    model = RandomForestClassifier(featuresCol="sub", labelCol="label", numTrees=trees, seed=0).fit(part.where(~held_out()))
    truth, found = F.col("label") == 1, F.col("prediction") == 1
    cells = model.transform(part.where(held_out())).agg(F.count_if(truth & found).alias("both"), F.count_if(truth | found).alias("either")).first()
    return cells["both"] / cells["either"] if cells["either"] else 0.0


def forward_select(samples: DataFrame, channels: list[str], candidates: list[str], crop_id: int, delta: float = 0.005, patience: int = 3, most: int = 10, trees: int = 20, at_once: int = 4) -> tuple[list[str], list[dict]]:
    """Greedy selection for one crop against the rest: a channel stays if it raises the IoU by ``delta``.

    It ends after ``patience`` candidates in a row that don't, or with ``most``
    channels. Until one is taken, candidates are tried with the same chosen
    ones; so as many as patience allows, ``at_once`` at most, are fitted side by side, and
    what comes behind one that is taken is tried anew. The history has a row for each candidate decided.
    """
    data = impute(samples, len(channels)).withColumn("label", (F.col("class_label") == crop_id).cast("double")).persist()
    place = {c: i for i, c in enumerate(channels)}
    path, decided = [_Choice()], []
    try:
        with ThreadPoolExecutor(at_once) as pool:
            while len(decided) < len(candidates) and path[-1].idle < patience and len(path[-1].channels) < most:
                now = path[-1]
                batch = candidates[len(decided) : len(decided) + min(at_once, patience - now.idle)]
                for channel, iou in zip(batch, list(pool.map(lambda c, base=now: _iou(data, [place[x] for x in (*base.channels, c)], trees), batch)), strict=True):
                    decided.append((channel, iou))
                    path.append(path[-1].after(channel, iou, delta))
                    if path[-1].channels != now.channels:
                        break
    finally:
        data.unpersist()
    history = [
        {"crop_id": crop_id, "step": i, "channel": channel, "n_channels": len(after.channels), "iou": round(iou, 4), "gain": round(iou - before.iou, 4), "accepted": after.channels != before.channels}
        for i, ((channel, iou), before, after) in enumerate(zip(decided, path[:-1], path[1:], strict=True))
    ]
    return list(path[-1].channels), history


def _draws(tree: int, seed: int) -> Column:
    """How often a tree's sample holds the row: a Poisson draw of mean 1, hashed from row and tree, so it can be had again."""
    unit = F.pmod(F.xxhash64("pixel_id", F.lit(tree), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    shares = itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12))
    return sum((F.when(unit >= s, 1).otherwise(0) for s in shares), F.lit(0))


def bagged_forest(samples: DataFrame, n_channels: int, trees: int = 100, depth: int = 12, seed: int = 42, at_once: int = 4, per_pass: int = 20) -> tuple[list[RandomForestClassificationModel], list[int], float]:
    """Trees on hashed bootstrap samples, their classes, and the out-of-bag accuracy.

    A row's weight in a tree is its class weight times its draw. For its score
    a row gets the class shares of those trees that didn't draw it, added up in
    passes of ``per_pass`` trees; the greatest sum is its class (ties: the
    first). Rows that every tree drew don't count, as in any out-of-bag score.
    """
    classes = _classes(samples)
    data = _indexed(impute(samples, n_channels), classes).select("pixel_id", "x", "label", "w").persist()

    def fit(t: int) -> RandomForestClassificationModel:
        part = data.withColumn("b", F.col("w") * _draws(t, seed)).where("b > 0")
        return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="b", numTrees=1, bootstrap=False, maxDepth=depth, seed=seed + t, featureSubsetStrategy="sqrt").fit(part)

    try:
        with ThreadPoolExecutor(at_once) as pool:
            models = list(pool.map(fit, range(trees)))
        none = F.array(*(F.lit(0.0) for _ in classes))
        parts = []
        for first in range(0, trees, per_pass):
            seen, votes = data.select("pixel_id", "x", "label"), none
            for t in range(first, min(first + per_pass, trees)):
                name = f"p{t}"
                seen = models[t].setProbabilityCol(name).setRawPredictionCol("").setPredictionCol("").transform(seen)
                votes = F.zip_with(votes, F.when(_draws(t, seed) == 0, vector_to_array(name)).otherwise(none), lambda a, b: a + b)
            parts.append(seen.select("pixel_id", "label", F.posexplode(votes).alias("k", "v")))
        every = functools.reduce(DataFrame.union, parts).groupBy("pixel_id", "label", "k").agg(F.sum("v").alias("v"))
        best = every.groupBy("pixel_id", "label").agg(F.max("v").alias("most"), F.min_by("k", F.struct(-F.col("v"), F.col("k"))).alias("k")).where("most > 0")
        accuracy = best.agg(F.avg((F.col("k") == F.col("label")).cast("double"))).first()[0]
    finally:
        data.unpersist()
    return models, classes, accuracy or 0.0

"""Metrics of predictions (``pixel_id, gt_class, pred_class``), all from one confusion table.

``keys`` (an area, a patch) make the same metrics per group.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_CLASSES = 9


def _grid(df: DataFrame, keys: list[str], n: int, *names: str) -> DataFrame:
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for name in names:
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.drop("_one")


def confusion_matrix(pred: DataFrame, n: int = N_CLASSES, keys: Iterable[str] = ()) -> DataFrame:
    """``gt_class, pred_class, n, share`` on the full grid; out-of-range classes dropped, an empty row's shares 0."""
    keys = list(keys)
    inside = pred.where(F.col("gt_class").between(0, n - 1) & F.col("pred_class").between(0, n - 1))
    counts = inside.groupBy(*keys, "gt_class", "pred_class").agg(F.count("*").alias("n"))
    full = _grid(inside, keys, n, "gt_class", "pred_class").join(counts, [*keys, "gt_class", "pred_class"], "left").na.fill(0, ["n"])
    row = F.sum("n").over(Window.partitionBy(*keys, "gt_class"))
    return full.withColumn("share", F.when(row > 0, F.col("n") / row).otherwise(0.0))


def class_counts(pred: DataFrame, n: int = N_CLASSES, keys: Iterable[str] = ()) -> DataFrame:
    """``class_id, tp, fp, fn`` from the confusion counts."""
    keys = list(keys)
    cells = pred.where(F.col("gt_class").between(0, n - 1) & F.col("pred_class").between(0, n - 1)).groupBy(*keys, "gt_class", "pred_class").agg(F.count("*").alias("n"))
    sides = cells.select(*keys, "n", F.explode(F.array(F.struct(F.col("gt_class").alias("k"), F.lit("g").alias("s")), F.struct(F.col("pred_class").alias("k"), F.lit("p").alias("s")))).alias("_e"), (F.col("gt_class") == F.col("pred_class")).alias("_hit"))
    c = lambda s, hit: F.sum(F.when((F.col("_e.s") == s) & (F.col("_hit") == hit), F.col("n")).otherwise(0))
    agg = sides.groupBy(*keys, F.col("_e.k").alias("class_id")).agg(c("g", True).alias("tp"), c("p", False).alias("fp"), c("g", False).alias("fn"))
    return _grid(pred, keys, n, "class_id").join(agg, [*keys, "class_id"], "left").na.fill(0, ["tp", "fp", "fn"])


def iou(counts: DataFrame) -> DataFrame:
    """IoU of each foreground class; null where class and prediction are both absent."""
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return counts.where("class_id > 0").withColumn("iou", F.when(union > 0, F.col("tp") / union)).drop("tp", "fp", "fn")


def f1(counts: DataFrame) -> DataFrame:
    """F1 of each foreground class; null where precision or recall is undefined or both are 0."""
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return counts.where("class_id > 0").select(*[c for c in counts.columns if c not in ("tp", "fp", "fn")], F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def class_accuracy(counts: DataFrame) -> DataFrame:
    """Recall of each foreground class."""
    return counts.where("class_id > 0").select(*[c for c in counts.columns if c not in ("tp", "fp", "fn")], (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("accuracy"))


def overall(pred: DataFrame, n: int = N_CLASSES, keys: Iterable[str] = ()) -> DataFrame:
    """``miou, mean_f1, overall_accuracy`` (background counts for the last); 0 where none is defined."""
    keys = list(keys)
    counts = class_counts(pred, n, keys)
    both = iou(counts).join(f1(counts), [*keys, "class_id"])
    means = both.groupBy(*keys).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("mean_f1"))
    hit = pred.groupBy(*keys).agg(F.avg((F.col("gt_class") == F.col("pred_class")).cast("double")).alias("overall_accuracy"))
    return means.join(hit, keys) if keys else means.join(F.broadcast(hit), F.lit(True))  # one row each


def binary_iou(pred: DataFrame, cls: int) -> DataFrame:
    g, p = F.col("gt_class") == cls, F.col("pred_class") == cls
    inter, union = F.sum((g & p).cast("long")), F.sum((g | p).cast("long"))
    return pred.agg(F.coalesce(F.when(union > 0, inter / union), F.lit(0.0)).alias("iou"))


def patch_metrics(pred: DataFrame, names: dict[int, str], n: int = N_CLASSES) -> DataFrame:
    """Per patch: foreground and overall accuracy, mean IoU, foreground pixels, names of its classes; best first."""
    cells = pred.groupBy("patch_id", "gt_class", "pred_class").agg(F.count("*").alias("n"))
    name = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k, v)))
    fg, hit = F.col("gt_class") > 0, F.col("gt_class") == F.col("pred_class")
    base = cells.groupBy("patch_id").agg(
        (F.sum(F.when(fg & hit, F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(fg, F.col("n")).otherwise(0)), F.lit(0))).alias("fg_accuracy"),
        (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        F.sum(F.when(fg, F.col("n")).otherwise(0)).alias("n_foreground"),
        F.array_join(F.sort_array(F.collect_set(F.when(fg, name[F.col("gt_class")]))), ", ").alias("classes"),
    )
    miou = iou(class_counts(pred, n, ["patch_id"])).groupBy("patch_id").agg(F.avg("iou").alias("miou"))
    return base.join(miou, "patch_id").orderBy(F.desc_nulls_last("fg_accuracy"), "patch_id")


def error_map(pred: DataFrame) -> DataFrame:
    """0 background, 1 right, 2 wrong."""
    return pred.withColumn("error", F.when(F.col("gt_class") == 0, 0).when(F.col("gt_class") == F.col("pred_class"), 1).otherwise(2))


def experiment_summary(results: DataFrame) -> DataFrame:
    """Runs ranked by test mIoU, or validation mIoU where there is none; ties by run."""
    key = F.coalesce("test_miou", "val_miou")
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(key), "run")))


def best_epoch(history: DataFrame) -> DataFrame:
    """Each run's epoch of highest validation mIoU; ties: the first."""
    w = Window.partitionBy("run").orderBy(F.desc_nulls_last("val_miou"), "epoch")
    return history.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


_LOADED: dict[str, Callable] = {}


def _loaded(key: str, sent: Broadcast, load: bool) -> Callable:
    """The model of a broadcast: made once for each Python worker, however many tasks it runs."""
    if key not in _LOADED:
        _LOADED.clear()
        model = pickle.loads(sent.value)
        _LOADED[key] = model() if load else model
    return _LOADED[key]


def predict_tiles(chips: DataFrame, model: Callable, tile: int, n_channels: int, batch: int = 16, load: bool = False) -> DataFrame:
    """``patch_id, values``: the model's argmax for each chip, edges padded with zeros and cut off again.

    ``chips`` has ``patch_id, height, width, values`` (channel-major array);
    ``model`` maps a float array (n, channels, tile, tile) to scores (n,
    classes, tile, tile), n up to ``batch``. It is broadcast, so an executor gets it
    once and a task's closure holds its handle alone. With ``load`` it is a
    function without arguments that makes the model, such as one that reads
    its weights from a shared folder; a worker calls it once.
    """
    import numpy as np

    key, sent = uuid.uuid4().hex, chips.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(key, sent, load)
        for whole in frames:
            for b in (whole.iloc[i : i + batch] for i in range(0, len(whole), batch)):
                sides = list(zip(b["height"], b["width"], strict=True))
                x = np.zeros((len(b), n_channels, tile, tile), np.float32)
                for i, ((h, w), values) in enumerate(zip(sides, b["values"], strict=True)):
                    x[i, :, :h, :w] = np.nan_to_num(np.asarray(values, np.float32).reshape(n_channels, h, w))
                best = model(x).argmax(axis=1)
                yield pd.DataFrame({"patch_id": b["patch_id"], "values": [y[:h, :w].ravel().astype(np.int32).tolist() for y, (h, w) in zip(best, sides, strict=True)]})

    return chips.select("patch_id", "height", "width", "values").mapInPandas(run, "patch_id string, values array<int>")


def classify_tiles(chips: DataFrame, model, n_channels: int) -> DataFrame:
    """``patch_id, values``: the class that an MLlib classification model gives each pixel of each chip.

    A chip (as in :func:`predict_tiles`; missing values count as 0) is taken
    apart into one feature vector a pixel and put together again in order.
    """
    from pyspark.ml.functions import array_to_vector

    n = F.col("height") * F.col("width")
    planes = F.arrays_zip(*(F.slice("values", (n * k + 1).cast("int"), n.cast("int")).alias(f"c{k}") for k in range(n_channels)))
    pixels = chips.select("patch_id", F.posexplode(planes).alias("_p", "_x"))
    vector = array_to_vector(F.array(*(F.nanvl(F.coalesce(F.col(f"_x.c{k}").cast("double"), F.lit(0.0)), F.lit(0.0)) for k in range(n_channels))))
    seen = model.transform(pixels.select("patch_id", "_p", vector.alias(model.getFeaturesCol())))
    cells = F.array_sort(F.collect_list(F.struct("_p", F.col(model.getPredictionCol()).cast("int").alias("v"))))
    return seen.groupBy("patch_id").agg(F.transform(cells, lambda x: x["v"]).alias("values"))

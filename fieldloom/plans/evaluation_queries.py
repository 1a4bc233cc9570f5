"""Queries of evaluation, disagreement and distribution shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import disagreement as D
from fieldloom.operators import evaluation as E
from fieldloom.operators import series, shift
from fieldloom.operators.cleaning import remap_labels
from fieldloom.plans.cleaning_queries import NDVI
from fieldloom.plans.patch_queries import PX, chips, pixels
from fieldloom.plans.registry import query
from fieldloom.sources.fixtures import Fixtures

NAMES = {i + 1: n for i, n in enumerate(("Corn", "Rice", "Winter Wheat", "Alfalfa", "Tomatoes", "Grapes", "Almonds", "Walnuts"))}


def counts_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    on = f"AND p.{key} = g.{key}" if key else ""
    base = f"(SELECT DISTINCT {key} FROM predictions) q CROSS JOIN" if key else ""
    return f"""cc AS (SELECT {f"g.{key}," if key else ""} g.class_id, count(CASE WHEN gt_class = class_id AND pred_class = class_id THEN 1 END) AS tp, count(CASE WHEN gt_class <> class_id AND pred_class = class_id THEN 1 END) AS fp, count(CASE WHEN gt_class = class_id AND pred_class <> class_id THEN 1 END) AS fn
    FROM (SELECT {k}CAST(i AS INT) AS class_id FROM {base} range(9) t(i)) g LEFT JOIN predictions p ON (p.gt_class = g.class_id OR p.pred_class = g.class_id) {on} GROUP BY ALL),
    mm AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM cc WHERE class_id > 0),
    ff AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM mm)"""


@query("SELECT CAST(a.i AS INT) AS gt_class, CAST(b.i AS INT) AS pred_class, count(p.pixel_id) AS n, round(coalesce(count(p.pixel_id) / nullif(sum(count(p.pixel_id)) OVER (PARTITION BY a.i), 0), 0), 6) AS share FROM range(9) a(i) CROSS JOIN range(9) b(i) LEFT JOIN predictions p ON p.gt_class = a.i AND p.pred_class = b.i GROUP BY a.i, b.i")
def h2_confusion_matrix(fx: Fixtures) -> DataFrame:
    return E.confusion_matrix(fx.predictions())


@query("SELECT class_id, round(iou, 6) AS iou FROM mm", counts_sql())
def h3_iou(fx: Fixtures) -> DataFrame:
    return E.iou(E.class_counts(fx.predictions()))


@query("SELECT class_id, round(f1, 6) AS f1 FROM ff", counts_sql())
def h4_f1(fx: Fixtures) -> DataFrame:
    return E.f1(E.class_counts(fx.predictions()))


@query("SELECT class_id, round(r, 6) AS accuracy FROM mm", counts_sql())
def h5_class_accuracy(fx: Fixtures) -> DataFrame:
    return E.class_accuracy(E.class_counts(fx.predictions()))


@query("SELECT round(coalesce(avg(iou), 0), 6) AS miou, round(coalesce(avg(f1), 0), 6) AS mean_f1, (SELECT round(avg(CAST(gt_class = pred_class AS INT)), 6) FROM predictions) AS overall_accuracy FROM ff", counts_sql())
def h3_h5_overall(fx: Fixtures) -> DataFrame:
    return E.overall(fx.predictions())


@query("SELECT round(coalesce(sum(CAST(gt_class = 4 AND pred_class = 4 AS INT)) / nullif(sum(CAST(gt_class = 4 OR pred_class = 4 AS INT)), 0), 0), 6) AS iou FROM predictions")
def h6_binary_iou(fx: Fixtures) -> DataFrame:
    return E.binary_iou(fx.predictions(), 4)


NAME_CASE = "CASE gt_class " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " END"


@query(
    f"""SELECT patch_id, round(sum(CAST(gt_class > 0 AND gt_class = pred_class AS INT)) / nullif(sum(CAST(gt_class > 0 AS INT)), 0), 6) AS fg_accuracy, round(avg(CAST(gt_class = pred_class AS INT)), 6) AS accuracy, CAST(sum(CAST(gt_class > 0 AS INT)) AS BIGINT) AS n_foreground,
    coalesce(string_agg(DISTINCT {NAME_CASE}, ', ' ORDER BY {NAME_CASE}) , '') AS classes, any_value(m.miou) AS miou FROM predictions p JOIN (SELECT patch_id, round(avg(iou), 6) AS miou FROM mm GROUP BY 1) m USING (patch_id) GROUP BY 1""",
    counts_sql("patch_id"),
)
def h7_patch_metrics(fx: Fixtures) -> DataFrame:
    return E.patch_metrics(fx.predictions(), NAMES)


@query("SELECT pixel_id, CASE WHEN gt_class = 0 THEN 0 WHEN gt_class = pred_class THEN 1 ELSE 2 END AS error FROM predictions")
def h8_error_map(fx: Fixtures) -> DataFrame:
    return E.error_map(fx.predictions()).select("pixel_id", "error")


@query("SELECT area, round(avg(iou), 6) AS miou, round(avg(f1), 6) AS mean_f1, any_value(oa) AS overall_accuracy FROM ff JOIN (SELECT area, round(avg(CAST(gt_class = pred_class AS INT)), 6) AS oa FROM predictions GROUP BY 1) USING (area) GROUP BY 1", counts_sql("area"))
def h9_evaluate_areas(fx: Fixtures) -> DataFrame:
    return E.overall(fx.predictions(), keys=["area"])


RUNS = "runs AS (SELECT concat('run', o_custkey % 40) AS run, CAST(o_orderkey % 50 AS INT) AS epoch, max(round(o_totalprice % 1000 / 1000, 3)) AS val_miou FROM orders GROUP BY 1, 2)"


def history(fx: Fixtures) -> DataFrame:
    o = fx.table("orders")
    return o.groupBy(F.concat(F.lit("run"), F.col("o_custkey") % 40).alias("run"), (F.col("o_orderkey") % 50).cast("int").alias("epoch")).agg(F.max(F.round(F.col("o_totalprice") % 1000 / 1000, 3)).alias("val_miou"))


@query("SELECT run, epoch, val_miou FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_miou DESC, epoch) AS k FROM runs) WHERE k = 1", RUNS)
def h11_best_epoch(fx: Fixtures) -> DataFrame:
    return E.best_epoch(history(fx))


@query("SELECT run, CAST(row_number() OVER (ORDER BY coalesce(t, v) DESC NULLS LAST, run) AS INT) AS rank FROM (SELECT run, max(val_miou) AS v, CASE WHEN count(*) > 45 THEN round(avg(val_miou), 6) END AS t FROM runs GROUP BY 1)", RUNS)
def h10_experiment_summary(fx: Fixtures) -> DataFrame:
    r = history(fx).groupBy("run").agg(F.max("val_miou").alias("val_miou"), F.when(F.count("*") > 45, F.round(F.avg("val_miou"), 6)).alias("test_miou"))
    return E.experiment_summary(r).select("run", "rank")


def _tiles(fx: Fixtures) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("channel_idx", "values"))), lambda x: x["values"])
    return chips(fx).groupBy("patch_id").agg(F.flatten(values).alias("values")).select("patch_id", F.lit(5).alias("height"), F.lit(5).alias("width"), "values")


# values are whole numbers, so ties go to the first channel
@query(
    """SELECT patch_id, string_agg(CAST(best AS VARCHAR), ',' ORDER BY cell) AS "values" FROM (SELECT p.patch_id, (p.r - p.r0) * 5 + p.c - p.c0 AS cell, arg_max(o.channel_idx, coalesce(o.value, 0) * 100 - o.channel_idx) AS best
    FROM px p SEMI JOIN patches USING (patch_id) JOIN obs o ON o.pixel_id = p.pixel_id GROUP BY 1, 2) GROUP BY 1""",
    PX,
)
def h1_predict_tiles(fx: Fixtures) -> DataFrame:
    """A stand-in model: the class is the channel of the highest value."""
    return E.predict_tiles(_tiles(fx), lambda x: x, 8, 24).withColumn("values", F.array_join("values", ","))


@query()
def h1_classify_tiles(fx: Fixtures) -> DataFrame:
    """A forest on the pixels' own values gives the class of every pixel of every chip."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    channels = F.array_sort(F.collect_list(F.struct("channel_idx", F.coalesce("value", F.lit(0.0)).alias("v"))))
    wide = fx.obs().groupBy("pixel_id").agg(array_to_vector(F.transform(channels, lambda x: x["v"])).alias("features"))
    fit = wide.join(remap_labels(pixels(fx)).select("pixel_id", F.col("model_id").cast("double").alias("label")), "pixel_id")
    model = RandomForestClassifier(numTrees=20, maxDepth=8, seed=0).fit(fit)
    return E.classify_tiles(_tiles(fx), model, 24).withColumn("values", F.array_join("values", ","))


@query("SELECT count(CASE WHEN gt_class = pred_class THEN 1 END) AS n_agree, count(CASE WHEN gt_class <> pred_class THEN 1 END) AS n_disagree FROM predictions")
def i1_agreement(fx: Fixtures) -> DataFrame:
    return D.agreement(fx.predictions())


SERIES = NDVI + """, cs0 AS (SELECT gt_class AS class_id, date8, median(ndvi) AS ref FROM ndvi JOIN predictions USING (pixel_id) WHERE gt_class = pred_class AND gt_class IN (SELECT gt_class FROM predictions WHERE gt_class = pred_class GROUP BY 1 HAVING count(*) >= 100) GROUP BY 1, 2),
cs AS (SELECT *, var_pop(ref) OVER (PARTITION BY class_id) AS var FROM cs0),
ds0 AS (SELECT pixel_id, gt_class, pred_class, avg(pow(ndvi - g.ref, 2)) / nullif(max(g.var), 0) AS nmse_gt, avg(pow(ndvi - q.ref, 2)) / nullif(max(q.var), 0) AS nmse_pred FROM ndvi JOIN predictions USING (pixel_id) JOIN cs g ON g.class_id = gt_class AND g.date8 = ndvi.date8 JOIN cs q ON q.class_id = pred_class AND q.date8 = ndvi.date8 WHERE gt_class <> pred_class GROUP BY 1, 2, 3),
ds AS (SELECT *, CASE WHEN nmse_pred < nmse_gt THEN 'pred' ELSE 'gt' END AS verdict FROM ds0 WHERE nmse_gt IS NOT NULL AND nmse_pred IS NOT NULL)"""


def scored(fx: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    index, pred = series.ndvi(fx.obs()), fx.predictions()
    return index, pred, D.disagreement_scores(index, pred, D.characteristic_series(index, pred))


@query("SELECT class_id, date8, round(ref, 6) AS ref, round(var, 6) AS var FROM cs", SERIES)
def i2_characteristic_series(fx: Fixtures) -> DataFrame:
    return D.characteristic_series(series.ndvi(fx.obs()), fx.predictions())


@query("SELECT pixel_id, gt_class, pred_class, round(nmse_gt, 4) AS nmse_gt, round(nmse_pred, 4) AS nmse_pred, verdict FROM ds", SERIES)
def i3_disagreement_scores(fx: Fixtures) -> DataFrame:
    return scored(fx)[2].withColumns({c: F.round(c, 4) for c in ("nmse_gt", "nmse_pred")})


@query("SELECT class_id, count(*) AS n_disagreement, count(CASE WHEN verdict = 'gt' THEN 1 END) AS gt_wins, count(CASE WHEN verdict = 'pred' THEN 1 END) AS pred_wins, round(avg(CAST(verdict = 'pred' AS INT)), 4) AS pred_win_rate, round(avg(nmse_gt), 4) AS mean_nmse_gt, round(avg(nmse_pred), 4) AS mean_nmse_pred FROM (SELECT gt_class AS class_id, * FROM ds UNION ALL SELECT pred_class, * FROM ds) GROUP BY 1", SERIES)
def i4_disagreement_summary(fx: Fixtures) -> DataFrame:
    return D.disagreement_summary(scored(fx)[2])


@query("SELECT count(CASE WHEN gt_class = pred_class THEN 1 END) AS n_agree, count(CASE WHEN gt_class <> pred_class THEN 1 END) AS n_disagree, (SELECT count(DISTINCT date8) FROM ndvi) AS n_dates, (SELECT count(*) FROM ds) AS n_scored, (SELECT round(avg(CAST(verdict = 'pred' AS INT)), 4) FROM ds) AS pred_win_rate FROM predictions", SERIES)
def i5_disagreement_overall(fx: Fixtures) -> DataFrame:
    index, pred, s = scored(fx)
    return D.disagreement_overall(pred, index, s)


VERDICTS = SERIES + ", vm AS (SELECT p.pixel_id, p.patch_id, CAST(CASE WHEN p.gt_class = p.pred_class THEN 0 WHEN verdict = 'pred' THEN 1 WHEN verdict = 'gt' THEN 2 ELSE 3 END AS INT) AS verdict FROM predictions p LEFT JOIN ds USING (pixel_id))"


@query("SELECT pixel_id, patch_id, verdict FROM vm", VERDICTS)
def i6_verdict_map(fx: Fixtures) -> DataFrame:
    _, pred, s = scored(fx)
    return D.verdict_map(pred, s)


@query("SELECT patch_id, count(CASE WHEN verdict = 1 THEN 1 END) AS pred_wins, count(CASE WHEN verdict = 2 THEN 1 END) AS gt_wins, count(CASE WHEN verdict = 3 THEN 1 END) AS unscored, round(count(CASE WHEN verdict = 1 THEN 1 END) / nullif(count(CASE WHEN verdict IN (1, 2) THEN 1 END), 0), 6) AS pred_win_rate FROM vm GROUP BY 1", VERDICTS)
def i6_patch_verdicts(fx: Fixtures) -> DataFrame:
    _, pred, s = scored(fx)
    return D.patch_verdicts(D.verdict_map(pred, s))


@query("SELECT pixel_id, verdict FROM ds ORDER BY md5(concat(pixel_id, '-0')), pixel_id LIMIT 100", SERIES)
def i7_scatter_sample(fx: Fixtures) -> DataFrame:
    return D.scatter_sample(scored(fx)[2], 100).select("pixel_id", "verdict")


@query('SELECT round(quantile_cont(x, 0.99), 3) AS "limit" FROM (SELECT nmse_gt AS x FROM ds UNION ALL SELECT nmse_pred FROM ds)', SERIES)
def i7_scatter_limit(fx: Fixtures) -> DataFrame:
    return D.scatter_limit(scored(fx)[2]).withColumn("limit", F.round("limit", 3))


@query("SELECT date8 FROM (SELECT DISTINCT date8 FROM obs) WHERE substr(date8, 5, 2) = '07' ORDER BY date8 LIMIT 1")
def j1_reference_date(fx: Fixtures) -> DataFrame:
    return shift.reference_date(fx.obs())


@query("SELECT date8 FROM (SELECT DISTINCT date8 FROM obs WHERE date8 < '20240701') ORDER BY date8 LIMIT 1 OFFSET 2")
def j1_reference_date_middle(fx: Fixtures) -> DataFrame:
    return shift.reference_date(fx.obs().where("date8 < '20240701'"))


AST = "ast AS (SELECT area, band, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM areas GROUP BY 1, 2)"


@query("SELECT area, band, round(mean, 6) AS mean, round(std, 6) AS std, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM ast", AST)
def j2_area_stats(fx: Fixtures) -> DataFrame:
    return shift.area_stats(fx.areas())


@query(
    "SELECT area, band, round(dm, 6) AS d_mean, round(ds, 6) AS d_std, dm > 0.15 OR ds > 0.2 AS warn, bool_or(dm > 0.15 OR ds > 0.2) OVER () AS shift FROM (SELECT a.area, a.band, abs(a.mean - t.mean) / (abs(t.mean) + 1e-9) AS dm, abs(a.std - t.std) / (abs(t.std) + 1e-9) AS ds FROM ast a JOIN ast t ON t.band = a.band AND t.area = 'train' WHERE a.area <> 'train')",
    AST,
)
def j3_shift_report(fx: Fixtures) -> DataFrame:
    return shift.shift_report(shift.area_stats(fx.areas()))


@query(
    """SELECT area, band, round(0.5 * (sum(p * ln(p / q)) + sum(q * ln(q / p))), 6) AS kl FROM (SELECT area, band, pd / sum(pd) OVER (PARTITION BY area, band) AS p, qd / sum(qd) OVER (PARTITION BY area, band) AS q FROM (
    SELECT g.area, g.band, g.bin, coalesce(x.p, 0) / sum(x.p) OVER (PARTITION BY g.area, g.band) / g.w + 1e-10 AS pd, coalesce(x.q, 0) / sum(x.q) OVER (PARTITION BY g.area, g.band) / g.w + 1e-10 AS qd
    FROM (SELECT area, band, (hi - lo) / 100 AS w, i AS bin FROM rng, range(100) t(i)) g LEFT JOIN binned x ON x.area = g.area AND x.band = g.band AND x.bin = g.bin)) GROUP BY 1, 2""",
    """ok AS (SELECT * FROM areas WHERE value IS NOT NULL),
    rng AS (SELECT o.area, o.band, least(min(o.value), min(t.lo)) AS lo, greatest(max(o.value), max(t.hi)) AS hi FROM ok o JOIN (SELECT band, min(value) AS lo, max(value) AS hi FROM ok WHERE area = 'train' GROUP BY 1) t ON t.band = o.band WHERE o.area <> 'train' GROUP BY 1, 2),
    binned AS (SELECT r.area, r.band, least(99, CAST(floor((o.value - lo) / (hi - lo) * 100) AS BIGINT)) AS bin, count(CASE WHEN o.area = 'train' THEN 1 END) AS p, count(CASE WHEN o.area <> 'train' THEN 1 END) AS q FROM rng r JOIN ok o ON o.band = r.band AND o.area IN (r.area, 'train') GROUP BY 1, 2, 3)""",
)
def j4_sym_kl(fx: Fixtures) -> DataFrame:
    return shift.sym_kl(fx.areas())


@query(
    "SELECT r.area, r.band, CAST(i AS INT) AS bin, round(count(o.value) / (any_value(r.n) * ((any_value(r.hi) - any_value(r.lo)) / 120)), 6) AS density FROM r CROSS JOIN range(120) t(i) LEFT JOIN areas o ON o.area = r.area AND o.band = r.band AND least(119, CAST(floor((o.value - r.lo) / (r.hi - r.lo) * 120) AS BIGINT)) = i GROUP BY 1, 2, 3",
    "r AS (SELECT area, band, min(value) AS lo, max(value) AS hi, count(value) AS n FROM areas GROUP BY 1, 2)",
)
def j5_density_histogram(fx: Fixtures) -> DataFrame:
    return shift.density_histogram(fx.areas())

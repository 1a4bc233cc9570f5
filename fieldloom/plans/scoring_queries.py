"""Queries of the scoring and selection operators, the flagship among them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import catalog, direct, forest, scoring, selection, series
from fieldloom.operators.cleaning import KEEP_CLASSES
from fieldloom.plans.cleaning_queries import BANDS, CHANNELS, MEANS, means
from fieldloom.plans.registry import query
from fieldloom.sources import outputs, shared
from fieldloom.sources.fixtures import Fixtures

MOM = "mom AS (SELECT crop_id, channel, channel_idx, avg(value) AS mu, stddev_pop(value) AS sd, stddev_samp(value) AS sd1, count(value) AS n, count(*) AS n_rows FROM samp GROUP BY 1, 2, 3)"
GSI = MOM + """, pairs AS (SELECT s.crop_id, s.channel, s.channel_idx, abs(s.mu - o.mu) / (1.96 * (s.sd + o.sd) + 1e-6) AS si FROM mom s JOIN mom o ON o.channel = s.channel AND o.crop_id <> s.crop_id WHERE s.n_rows >= 10 AND o.n_rows >= 10),
scores AS (SELECT CAST(g.crop_id AS INT) AS crop_id, g.channel, g.channel_idx, round(coalesce(p.score, 0), 6) AS score, coalesce(p.score, 0) AS raw, split_part(g.channel, '_', 1) AS band, split_part(g.channel, '_', 2) AS date8
  FROM (SELECT k.crop_id, c.channel, c.channel_idx FROM (VALUES (1), (3), (24), (36), (54), (69), (75), (76)) k(crop_id), (SELECT DISTINCT channel, channel_idx FROM obs) c) g
  LEFT JOIN (SELECT crop_id, channel, CASE WHEN count(si) = count(*) THEN avg(si) END AS score FROM pairs GROUP BY 1, 2) p USING (crop_id, channel)),
ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY crop_id) - 1 AS INT) AS crop_order, CAST(row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, channel_idx) AS INT) AS rank FROM scores)"""
TOP5 = GSI + ", sel AS (SELECT * FROM ranked WHERE rank <= 5), uni AS (SELECT channel, CAST(row_number() OVER (ORDER BY min(crop_order * 1000 + rank)) - 1 AS INT) AS ordinal FROM sel GROUP BY 1)"


def scores(fx: Fixtures) -> DataFrame:
    return raw_scores(fx).withColumn("score", F.round("score", 6))


def raw_scores(fx: Fixtures) -> DataFrame:
    return scoring.gsi_pairwise(fx.crop_samples(), KEEP_CLASSES)


def channels(fx: Fixtures) -> DataFrame:
    return catalog.build_channels(fx.obs(), BANDS)


@query("SELECT channel, ordinal FROM uni", TOP5)
def flagship_union(fx: Fixtures) -> DataFrame:
    """Cleaned pixels to separability scores, the five best channels of each crop, and their union."""
    return selection.union_channels(selection.select_top_k(scores(fx), 5))


@query("SELECT crop_id, channel, channel_idx, score FROM scores", GSI)
def e1_gsi_pairwise(fx: Fixtures) -> DataFrame:
    return scores(fx)


@query(
    """SELECT CAST(m.crop_id AS INT) AS crop_id, m.channel, m.channel_idx, round(CASE WHEN m.n_rows < 10 THEN 0 ELSE abs(m.mu - r.mu) / (1.96 * (m.sd + r.sd) + 1e-6) END, 6) AS score FROM mom m
    JOIN (SELECT k.crop_id, s.channel, avg(s.value) AS mu, stddev_pop(s.value) AS sd FROM (SELECT DISTINCT crop_id FROM samp) k JOIN samp s ON s.crop_id <> k.crop_id GROUP BY 1, 2) r ON r.crop_id = m.crop_id AND r.channel = m.channel""",
    MOM,
)
def e2_gsi_one_vs_rest(fx: Fixtures) -> DataFrame:
    return scoring.gsi_one_vs_rest(fx.crop_samples(), KEEP_CLASSES)


@query("SELECT CAST(s.crop_id AS INT) AS crop_id, s.channel, s.channel_idx, round(avg(abs(s.mu - o.mu) / (1.96 * (s.sd1 + o.sd1) + 1e-6)), 6) AS score FROM mom s JOIN mom o ON o.channel = s.channel AND o.crop_id <> s.crop_id GROUP BY 1, 2, 3", MOM)
def e3_gsi_legacy(fx: Fixtures) -> DataFrame:
    return scoring.gsi_legacy(fx.crop_samples())


def _collapse(by: str, key: str):
    def run(fx: Fixtures) -> DataFrame:
        return scoring.collapse_scores(raw_scores(fx), by)

    run.__name__ = f"e4_collapse_{by}"
    return query(f"SELECT crop_id, {key} AS key, round(avg(raw), 6) AS score FROM scores GROUP BY 1, 2", GSI)(run)


for _by, _key in (("band", "band"), ("date", "date8"), ("mmdd", "substr(date8, 5, 4)")):
    _collapse(_by, _key)


@query("SELECT date8, " + ", ".join(f'max(CASE WHEN crop_id = {k} THEN score END) AS "{k}"' for k in KEEP_CLASSES) + " FROM scores GROUP BY 1", GSI)
def e5_score_matrix(fx: Fixtures) -> DataFrame:
    return scoring.score_matrix(scores(fx), KEEP_CLASSES)


@query("SELECT date8, " + ", ".join(f"max(CASE WHEN band = '{b}' THEN score END) AS {b}" for b in BANDS) + " FROM scores WHERE crop_id = 3 GROUP BY 1", GSI)
def e5_heat_table(fx: Fixtures) -> DataFrame:
    return scoring.heat_table(scores(fx), 3, BANDS)


@query("SELECT round(greatest(quantile_cont(score, 0.95), 1e-3), 6) AS ceiling FROM scores", GSI)
def e5_colour_ceiling(fx: Fixtures) -> DataFrame:
    return scoring.colour_ceiling(scores(fx))


EXTRA = GSI + """, extra AS (SELECT crop_id, channel_idx, band, strftime(strptime(date8, '%Y%m%d') - INTERVAL 363 DAY, '%Y%m%d') AS date8, round(score * (1 + crop_id / 100), 6) AS score FROM scores),
doyed AS (SELECT *, substr(date8, 5, 4) AS mmdd, dayofyear(strptime(concat('2000', substr(date8, 5, 4)), '%Y%m%d')) AS doy FROM extra)"""


def extra_year(s: DataFrame) -> DataFrame:
    date = F.date_format(F.date_add(F.to_date(F.split("channel", "_")[1], "yyyyMMdd"), -363), "yyyyMMdd")
    return s.select("crop_id", F.concat_ws("_", F.split("channel", "_")[0], date).alias("channel"), "channel_idx", F.round(F.col("score") * (1 + F.col("crop_id") / 100), 6).alias("score"), F.lit(2023).alias("year"))


@query(
    """SELECT s.crop_id, s.channel, s.channel_idx, round((s.score + (SELECT d.score FROM doyed d WHERE d.crop_id = s.crop_id AND d.band = s.band ORDER BY abs(d.doy - dayofyear(strptime(concat('2000', substr(s.date8, 5, 4)), '%Y%m%d'))), d.channel_idx LIMIT 1)) / 2, 6) AS score FROM scores s""",
    EXTRA,
)
def e6_adjust_multi_year(fx: Fixtures) -> DataFrame:
    s = shared.materialise(scores(fx))  # crops x channels
    return scoring.adjust_multi_year(s, extra_year(s))


@query("SELECT crop_id, band, round(avg(s), 6) AS score FROM (SELECT 2024 AS y, crop_id, band, avg(score) AS s FROM scores GROUP BY 1, 2, 3 UNION ALL SELECT 2023, crop_id, band, avg(score) FROM extra GROUP BY 1, 2, 3) GROUP BY 1, 2", EXTRA)
def e7_rank_bands_across_years(fx: Fixtures) -> DataFrame:
    s = shared.materialise(scores(fx))
    both = s.withColumn("year", F.lit(2024)).unionByName(extra_year(s))
    return scoring.rank_bands_across_years(both)


CANDS = GSI + """, cands AS (SELECT crop_id, 'date' AS kind, date8 AS value, round(avg(raw), 6) AS score, CAST(row_number() OVER (PARTITION BY crop_id ORDER BY avg(raw) DESC, date8) AS INT) AS rank FROM scores GROUP BY crop_id, date8
UNION ALL SELECT crop_id, 'band', band, round(avg(raw), 6), CAST(row_number() OVER (PARTITION BY crop_id ORDER BY avg(raw) DESC, min(channel_idx)) AS INT) FROM scores GROUP BY crop_id, band)"""


@query("SELECT CAST(crop_id AS INT) AS crop, kind AS type, rank, CAST(value AS VARCHAR) AS value FROM cands WHERE rank <= CASE kind WHEN 'date' THEN 4 ELSE 3 END", CANDS)
def a8_write_candidates(fx: Fixtures) -> DataFrame:
    """Written as CSV and read back."""
    path = f"{_folder(fx)}/candidates-{uuid.uuid4().hex}"
    outputs.write_candidates(scoring.rank_candidates(raw_scores(fx), 4, 3), path)
    return fx.spark.read.schema("crop int, type string, rank int, value string").option("header", "true").csv(f"{path}/rows")


@query("SELECT * FROM cands WHERE rank <= CASE kind WHEN 'date' THEN 4 ELSE 3 END", CANDS)
def e8_rank_candidates(fx: Fixtures) -> DataFrame:
    return scoring.rank_candidates(raw_scores(fx), 4, 3)


@query("SELECT channel, round(0.6 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-9) + 0.4 * coalesce(i, 0), 6) AS score FROM (SELECT channel, score, (SELECT score FROM scores t WHERE t.crop_id = 24 AND t.channel = s.channel AND t.band <> 'B2') AS i FROM scores s WHERE crop_id = 3)", GSI)
def e12_joint_score(fx: Fixtures) -> DataFrame:
    s = scores(fx)
    imp = s.where((F.col("crop_id") == 24) & ~F.col("channel").startswith("B2_")).select("channel", F.col("score").alias("importance"))
    return scoring.joint_score(s.where("crop_id = 3"), imp, 0.6)


def _vector_channels(fx: Fixtures) -> DataFrame:
    """24 channels of ``vectors()``: band j % 4 of date j div 4."""
    names = F.array(*(F.lit(b) for b in BANDS))
    return fx.spark.range(24).select(F.concat(names[(F.col("id") % 4).cast("int")], F.lit("_2024010"), F.floor(F.col("id") / 4) + 1).alias("channel"), F.col("id").cast("int").alias("channel_idx"))


def _folder(fx: Fixtures) -> str:
    return shared.shared_folder(fx.spark)


def _best(fx: Fixtures) -> list[str]:
    """All channels by a small forest's importance."""
    model, _, _ = forest.train_forest(fx.vectors().where("class_label > 0"), 24, trees=10, depth=6)
    return [r[0] for r in forest.forest_importance(model, _vector_channels(fx)).orderBy(F.desc("importance"), "channel").select("channel").collect()]


@query()
def e9_forest_accuracy(fx: Fixtures) -> DataFrame:
    samples = fx.vectors().where("class_label > 0")
    _, classes, accuracy = forest.train_forest(samples, 24, trees=10, depth=6)
    _, _, oob = forest.bagged_forest(samples, 24, trees=20, depth=6)
    return fx.spark.createDataFrame([(len(classes), accuracy, oob)], "n_classes int, accuracy double, oob_accuracy double")


@query()
def e9_e10_forest_class_importance(fx: Fixtures) -> DataFrame:
    model, classes, _ = forest.train_forest(fx.vectors().where("class_label > 0"), 24, trees=10, depth=6)
    return forest.class_importance(model, classes, _vector_channels(fx), _folder(fx))


@query()
def e11_forest_importance(fx: Fixtures) -> DataFrame:
    model, _, _ = forest.train_forest(fx.vectors().where("class_label > 0"), 24, trees=10, depth=6)
    return forest.forest_importance(model, _vector_channels(fx))


@query()
def e13_cluster_channels(fx: Fixtures) -> DataFrame:
    names = [r[0] for r in _vector_channels(fx).orderBy("channel_idx").collect()]
    chosen = forest.cluster_channels(fx.vectors(), {c: float(-i) for i, c in enumerate(names)}, names, corr=0.3)
    return fx.spark.createDataFrame([(i, c) for i, c in enumerate(chosen)], "ordinal int, channel string")


@query()
def e14_evaluate_combinations(fx: Fixtures) -> DataFrame:
    names = [r[0] for r in _vector_channels(fx).orderBy("channel_idx").collect()]
    out = forest.evaluate_combinations(fx.vectors(), names, _best(fx)[:3], max_size=2, folds=2, trees=5)
    return out.withColumn("combo", F.array_join("combo", "+"))


@query()
def e15_rank_bands_forest(fx: Fixtures) -> DataFrame:
    c = _vector_channels(fx)
    return forest.rank_bands_forest(fx.vectors().where("class_label > 0"), c, c.where("channel_idx < 12"), _folder(fx), trees=5, top=3, depth=5)


@query()
def e16_forward_select(fx: Fixtures) -> DataFrame:
    names = [r[0] for r in _vector_channels(fx).orderBy("channel_idx").collect()]
    _, history = forest.forward_select(fx.vectors(), names, _best(fx), 3, patience=2, most=3, trees=5)
    return fx.spark.createDataFrame(history, "crop_id int, step int, channel string, n_channels int, iou double, gain double, accepted boolean")


@query("SELECT crop_id, crop_order, rank, channel, score FROM ranked WHERE rank <= 5", GSI)
def f1_select_top_k(fx: Fixtures) -> DataFrame:
    return selection.select_top_k(scores(fx), 5)


@query("SELECT crop_id, crop_order, rank, channel, score FROM ranked WHERE score >= (SELECT quantile_cont(score, 0.7) FROM scores)", GSI)
def f2_select_percentile(fx: Fixtures) -> DataFrame:
    return selection.select_percentile(scores(fx), 70)


@query("SELECT crop_id, crop_order, rank, channel, score FROM (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM ranked WINDOW w AS (PARTITION BY crop_id)) WHERE s >= 0.5", GSI)
def f3_select_threshold(fx: Fixtures) -> DataFrame:
    return selection.select_threshold(scores(fx), 0.5)


@query("SELECT channel, ordinal FROM uni", TOP5)
def f4_union_channels(fx: Fixtures) -> DataFrame:
    return selection.union_channels(selection.select_top_k(scores(fx), 5))


@query("SELECT CAST(k AS DOUBLE) AS param, count(DISTINCT channel) AS n_union, count(*) AS n_selected FROM ranked JOIN (VALUES (3), (5), (10)) t(k) ON rank <= k GROUP BY 1", GSI)
def f5_sweep_top_k(fx: Fixtures) -> DataFrame:
    return selection.sweep_union_sizes(selection.sweep(scores(fx), ks=(3, 5, 10)))


@query("SELECT CAST(p AS DOUBLE) AS param, count(DISTINCT channel) AS n_union, count(*) AS n_selected FROM ranked JOIN (SELECT 50 AS p, quantile_cont(score, 0.5) AS cut FROM scores UNION ALL SELECT 90, quantile_cont(score, 0.9) FROM scores) ON score >= cut GROUP BY 1", GSI)
def f5_sweep_percentile(fx: Fixtures) -> DataFrame:
    return selection.sweep_union_sizes(selection.sweep(scores(fx), percentiles=(50, 90)))


@query("SELECT channel, CAST(row_number() OVER (ORDER BY min(crop_order * 1000 + rank)) - 1 AS INT) AS ordinal FROM ranked WHERE rank <= 2 GROUP BY 1", GSI)
def f6_subset_selection(fx: Fixtures) -> DataFrame:
    return selection.subset_selection(selection.select_top_k(scores(fx), 5), 2)


ODD = "(SELECT channel, ordinal FROM uni UNION ALL VALUES ('B1_20220730', 101), ('nounderscore', 102), ('B4_20220310', 103), ('B8_20221231', 104))"


@query(
    f"""SELECT channel, ordinal, local_channel, coalesce(channel_idx, -1) AS channel_idx, CASE WHEN band = '' THEN 'malformed' WHEN band NOT IN ('B2', 'B4', 'B8', 'B11') THEN 'unknown band' WHEN local_channel IS NULL THEN 'missing channel' ELSE 'ok' END AS status FROM (
    SELECT u.channel, u.ordinal, u.band, c.channel AS local_channel, c.channel_idx FROM (SELECT *, CASE WHEN channel LIKE '%\\_%' ESCAPE '\\' THEN split_part(channel, '_', 1) ELSE '' END AS band, substr(split_part(channel, '_', 2), 5, 4) AS mmdd FROM {ODD}) u
    LEFT JOIN channels c ON c.band = u.band AND c.mmdd = (SELECT d.mmdd FROM (SELECT DISTINCT mmdd FROM channels) d ORDER BY CASE WHEN d.mmdd = u.mmdd THEN -1 ELSE abs(dayofyear(strptime(concat('2000', d.mmdd), '%Y%m%d')) - dayofyear(try_strptime(concat('2000', u.mmdd), '%Y%m%d'))) END, d.mmdd LIMIT 1))""",
    TOP5 + ", " + CHANNELS,
)
def f7_project_selection(fx: Fixtures) -> DataFrame:
    union = selection.union_channels(selection.select_top_k(scores(fx), 5))
    odd = fx.spark.createDataFrame([("B1_20220730", 101), ("nounderscore", 102), ("B4_20220310", 103), ("B8_20221231", 104)], "channel string, ordinal int")
    return selection.project_selection(union.unionByName(odd), channels(fx)).withColumn("channel_idx", F.coalesce("channel_idx", F.lit(-1)))


@query("SELECT channel, band, date8, channel_idx FROM channels WHERE band IN (SELECT band FROM scores WHERE score > 0.2) AND date8 IN (SELECT date8 FROM scores WHERE score > 0.2)", GSI + ", " + CHANNELS)
def f8_cross_channels(fx: Fixtures) -> DataFrame:
    some = scores(fx).where("score > 0.2").select(F.split("channel", "_")[0].alias("band"), F.split("channel", "_")[1].alias("date8"))
    return selection.cross_channels(some, some, channels(fx))


@query(
    """SELECT c.channel, CAST(row_number() OVER (ORDER BY c.date8, b.f) - 1 AS INT) AS ordinal FROM channels c JOIN (SELECT value AS band, min(o * 1000 + rank) AS f FROM (SELECT *, dense_rank() OVER (ORDER BY crop_id) AS o FROM cands WHERE kind = 'band') WHERE rank <= 2 GROUP BY 1) b USING (band) WHERE c.date8 IN ('20240331', '20240629')""",
    CANDS + ", " + CHANNELS,
)
def f9_domain_channels(fx: Fixtures) -> DataFrame:
    order = F.array_position(F.array(*(F.lit(k) for k in KEEP_CLASSES)), F.col("crop_id"))
    cands = scoring.rank_candidates(raw_scores(fx)).where("kind = 'band'").select(order.alias("crop_order"), "rank", F.col("value").alias("band"))
    dates = channels(fx).where(F.col("date8").isin("20240331", "20240629")).select("date8")
    return selection.domain_channels(cands, dates, channels(fx), 2)


@query("SELECT channel, channel_idx, CAST(row_number() OVER (ORDER BY channel_idx) - 1 AS INT) AS ordinal FROM channels WHERE date8 IN (SELECT date8 FROM q)", MEANS + ", " + CHANNELS + """, m AS (SELECT date8, CAST(ceil(CAST(substr(date8, 5, 2) AS INT) / 3) AS INT) AS q, mean_ndvi AS v FROM means),
q AS (SELECT date8 FROM (SELECT date8, row_number() OVER (PARTITION BY q ORDER BY round(v, 5) DESC, date8) AS k FROM m) WHERE k = 1)""")
def f10_baseline_channels(fx: Fixtures) -> DataFrame:
    return selection.baseline_channels(series.quarterly_dates(means(fx)), channels(fx))


@query("SELECT band, mmdd, count(DISTINCT year) AS n_years FROM both_years GROUP BY 1, 2 HAVING count(DISTINCT year) = 2", CHANNELS + ", both_years AS (SELECT band, mmdd, year FROM channels UNION ALL SELECT band, mmdd, 2023 FROM channels WHERE band <> 'B8' AND mmdd <> '0116')")
def f11_consistent_channels(fx: Fixtures) -> DataFrame:
    c = channels(fx).select("band", "mmdd", "year")
    other = c.where("band <> 'B8' and mmdd <> '0116'").withColumn("year", F.lit(2023))
    return selection.consistent_channels(c.unionByName(other))


@query(
    "SELECT channel, kept, CASE WHEN kept THEN CAST(dense_rank() OVER (PARTITION BY kept ORDER BY scene_idx) - 1 AS INT) ELSE -1 END AS new_scene_idx, CASE WHEN kept THEN CAST(row_number() OVER (PARTITION BY kept ORDER BY channel_idx) - 1 AS INT) ELSE -1 END AS new_channel_idx FROM (SELECT *, date8 IN (SELECT split_part(channel, '_', 2) FROM ranked WHERE rank = 1) AS kept FROM channels)",
    GSI + ", " + CHANNELS,
)
def f12_prune_scenes(fx: Fixtures) -> DataFrame:
    out = selection.prune_scenes(channels(fx), selection.select_top_k(scores(fx), 1))
    return out.select("channel", "kept", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("new_scene_idx", "new_channel_idx")))


@query("SELECT CASE crop_id WHEN 1 THEN 'Corn' WHEN 3 THEN 'Rice' WHEN 24 THEN 'Winter Wheat' WHEN 36 THEN 'Alfalfa' WHEN 54 THEN 'Tomatoes' WHEN 69 THEN 'Grapes' WHEN 75 THEN 'Almonds' ELSE 'Walnuts' END AS crop, rank, band, concat(substr(date8, 5, 2), '/', substr(date8, 7, 2)) AS date, channel, score FROM sel", TOP5)
def f13_detail_table(fx: Fixtures) -> DataFrame:
    return selection.detail_table(selection.select_top_k(scores(fx), 5))


DATES = ["20240116", "20240331", "20240515", "20240629", "20240729", "20241012"]


@query("SELECT crop_id, " + ", ".join(f"count(CASE WHEN date8 = '{d}' THEN 1 END) AS \"{d}\"" for d in DATES) + " FROM sel GROUP BY 1", TOP5)
def f14_date_pivot(fx: Fixtures) -> DataFrame:
    return selection.date_pivot(selection.select_top_k(scores(fx), 5), DATES)


@query("SELECT crop_id, " + ", ".join(f"count(CASE WHEN band = '{b}' THEN 1 END) AS {b}" for b in BANDS) + " FROM sel GROUP BY 1", TOP5)
def f14_band_pivot(fx: Fixtures) -> DataFrame:
    return selection.band_pivot(selection.select_top_k(scores(fx), 5), BANDS)


def _scoped_sql(dates: str) -> str:
    return f"""SELECT crop_id, band, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, band) AS INT) AS rank FROM (
    SELECT CAST(m.crop_id AS INT) AS crop_id, split_part(m.channel, '_', 1) AS band, round(avg(abs(m.mu - r.mu) / (1.96 * (m.sd + r.sd) + 1e-6)), 6) AS score FROM mom m
    JOIN (SELECT k.crop_id, s.channel, avg(s.value) AS mu, stddev_pop(s.value) AS sd FROM (SELECT DISTINCT crop_id FROM samp) k JOIN samp s ON s.crop_id <> k.crop_id GROUP BY 1, 2) r ON r.crop_id = m.crop_id AND r.channel = m.channel
    WHERE split_part(m.channel, '_', 2) IN ({dates}) GROUP BY 1, 2)) WHERE rank <= 3"""


@query(_scoped_sql("SELECT date8 FROM (SELECT date8 FROM means ORDER BY mean_ndvi DESC, date8 LIMIT 1)"), MEANS + ", " + MOM)
def f15_single_date_gsi(fx: Fixtures) -> DataFrame:
    return direct.scoped_gsi(fx.crop_samples(), series.peak_ndvi_date(means(fx)), 3)


@query(_scoped_sql("SELECT date8 FROM (SELECT date8, row_number() OVER (PARTITION BY ceil(CAST(substr(date8, 5, 2) AS INT) / 3) ORDER BY round(mean_ndvi, 5) DESC, date8) AS k FROM means) WHERE k = 1"), MEANS + ", " + MOM)
def f15_four_dates_gsi(fx: Fixtures) -> DataFrame:
    return direct.scoped_gsi(fx.crop_samples(), series.quarterly_dates(means(fx)), 3)


@query()
def f15_single_date_forest(fx: Fixtures) -> DataFrame:
    """On the date of the highest mean index."""
    return direct.scoped_forest(fx.obs(), fx.labels(), channels(fx), series.peak_ndvi_date(means(fx)), _folder(fx), top=3, trees=5, depth=5)


@query()
def f15_four_dates_forest(fx: Fixtures) -> DataFrame:
    """On the best date of each quarter."""
    return direct.scoped_forest(fx.obs(), fx.labels(), channels(fx), series.quarterly_dates(means(fx)), _folder(fx), top=3, trees=5, depth=5)


@query("SELECT channel, ordinal FROM uni", TOP5)
def f16_gsi_direct(fx: Fixtures) -> DataFrame:
    """Scores, one year, top five of each crop, written payload's union."""
    payload = outputs.selection_payload(direct.gsi_direct(fx.crop_samples(), top_k=5), {"selector": "gsi_direct", "mode": "top_k"})
    return payload.select(F.posexplode("union").alias("ordinal", "channel")).select("channel", "ordinal")


PERCENTILE = GSI + ", cut AS (SELECT quantile_cont(score, 0.9) AS cut FROM scores), psel AS (SELECT ranked.* FROM ranked, cut WHERE score >= cut)"


@query("SELECT channel, CAST(row_number() OVER (ORDER BY min(crop_order * 1000 + rank)) - 1 AS INT) AS ordinal FROM psel GROUP BY 1", PERCENTILE)
def f16_gsi_direct_percentile(fx: Fixtures) -> DataFrame:
    """From observations and labels of a year, the pooled 90th percentile; written and read back."""
    path = f"{_folder(fx)}/direct-{uuid.uuid4().hex}"
    direct.run_gsi_direct([(2024, fx.obs(), fx.labels(), fx.channels())], percentile=90, frac=1.0, path=path)
    return selection.union_channels(outputs.read_selection(fx.spark, path))


YEARS = GSI + """, year2 AS (SELECT concat(o.band, '_', o.date8) AS channel, o.channel_idx, o.band, o.date8, l.cdl_id AS crop_id, o.value + (o.pixel_id * 7 + o.channel_idx * 13) % 500 AS value FROM obs2 o JOIN lab l USING (pixel_id) WHERE l.model_id > 0),
mom2 AS (SELECT crop_id, channel, channel_idx, band, date8, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n_rows FROM year2 GROUP BY 1, 2, 3, 4, 5),
pairs2 AS (SELECT s.crop_id, s.channel, abs(s.mu - o.mu) / (1.96 * (s.sd + o.sd) + 1e-6) AS si FROM mom2 s JOIN mom2 o ON o.channel = s.channel AND o.crop_id <> s.crop_id WHERE s.n_rows >= 10 AND o.n_rows >= 10),
scores2 AS (SELECT k.crop_id, c.channel_idx, c.band, dayofyear(strptime(concat('2000', substr(c.date8, 5, 4)), '%Y%m%d')) AS doy, coalesce(p.score, 0) AS raw FROM (VALUES (1), (3), (24), (36), (54), (69), (75), (76)) k(crop_id), (SELECT DISTINCT channel, channel_idx, band, date8 FROM mom2) c
  LEFT JOIN (SELECT crop_id, channel, avg(si) AS score FROM pairs2 GROUP BY 1, 2) p ON p.crop_id = k.crop_id AND p.channel = c.channel),
adj AS (SELECT s.crop_id, s.channel, s.channel_idx, dense_rank() OVER (ORDER BY s.crop_id) - 1 AS crop_order, round((s.raw + (SELECT d.raw FROM scores2 d WHERE d.crop_id = s.crop_id AND d.band = s.band ORDER BY abs(d.doy - dayofyear(strptime(concat('2000', substr(s.date8, 5, 4)), '%Y%m%d'))), d.channel_idx LIMIT 1)) / 2, 6) AS score FROM scores s),
aranked AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, channel_idx) AS rank FROM adj)"""


@query("SELECT CAST(crop_id AS INT) AS crop_id, CAST(rank AS INT) AS rank, channel, score FROM aranked WHERE rank <= 5", YEARS)
def f16_gsi_direct_years(fx: Fixtures) -> DataFrame:
    """Two years' pixels scored on their own, the first year's scores averaged with the nearest dates of the second."""
    second = fx.second_year().withColumn("value", F.col("value") + (F.col("pixel_id") * 7 + F.col("channel_idx") * 13) % 500)
    named = second.select(F.concat_ws("_", "band", "date8").alias("channel"), "channel_idx").distinct()
    chosen, _ = direct.run_gsi_direct([(2024, fx.obs(), fx.labels(), fx.channels()), (2023, second, fx.labels(), named)], top_k=5, frac=1.0)
    return chosen.select("crop_id", "rank", "channel", "score")


@query()
def f16_run_rf_direct(fx: Fixtures) -> DataFrame:
    """From observations and labels, by a forest's importance."""
    chosen, _ = direct.run_rf_direct([(2024, fx.obs(), fx.labels(), fx.channels())], _folder(fx), top_k=4, trees=5, depth=5)
    return selection.union_channels(chosen)


@query("SELECT crop_id, count(*) AS n_channels, (SELECT count(DISTINCT channel) FROM psel) AS n_union, (SELECT min(score) FROM psel) AS least_score, (SELECT round(cut, 6) FROM cut) AS pooled_threshold FROM psel GROUP BY 1", PERCENTILE)
def f17_selection_summary_percentile(fx: Fixtures) -> DataFrame:
    s = shared.materialise(scores(fx))
    return selection.selection_summary(selection.select_percentile(s, 90), selection.pooled_threshold(s, 90))


@query()
def f16_rf_direct(fx: Fixtures) -> DataFrame:
    return selection.union_channels(direct.rf_direct(fx.vectors().where("class_label > 0"), _vector_channels(fx), _folder(fx), top_k=4, trees=5, depth=5))


@query("SELECT crop_id, count(*) AS n_channels, (SELECT count(DISTINCT channel) FROM sel) AS n_union, (SELECT min(score) FROM sel) AS least_score FROM sel GROUP BY 1", TOP5)
def f17_selection_summary(fx: Fixtures) -> DataFrame:
    return selection.selection_summary(selection.select_top_k(scores(fx), 5))



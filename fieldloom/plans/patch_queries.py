"""Queries of patches, splits, weights, normalisation and chips. Patches are 5 x 5 pixels, blocks 10 x 10."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import patches as P
from fieldloom.plans.cleaning_queries import KEEP, STATS, _size
from fieldloom.plans.registry import query
from fieldloom.sources import storage
from fieldloom.sources.fixtures import Fixtures
from fieldloom.sources.outputs import write_chips
from fieldloom.sources.shared import shared_folder

H = "h AS (SELECT max(r) + 1 AS height FROM px_labels)"
PX = H + """, px AS (SELECT *, concat(r0, '_', c0) AS patch_id FROM (SELECT l.*, CAST(floor(l.r / 5) AS BIGINT) * 5 AS r0, CAST(floor(l.c / 5) AS BIGINT) * 5 AS c0 FROM lab l) t, h WHERE r0 + 5 <= height AND c0 + 5 <= 50),
patches AS (SELECT patch_id, r0, c0, CAST(floor(r0 / 10) AS BIGINT) AS block_r, CAST(floor(c0 / 10) AS BIGINT) AS block_c, round(avg(CAST(model_id > 0 AS INT)), 6) AS valid_frac FROM px GROUP BY 1, 2, 3 HAVING avg(CAST(model_id > 0 AS INT)) >= 0.1),
pcounts AS (SELECT patch_id, model_id, count(*) AS n FROM px SEMI JOIN patches USING (patch_id) GROUP BY 1, 2)"""
SPLIT = PX + """, split AS (SELECT p.*, CASE WHEN (block_r * 3 + block_c) % 7 < 5 THEN 'train' WHEN (block_r * 3 + block_c) % 7 = 5 THEN 'val' ELSE 'test' END AS split FROM patches p)"""


def pixels(fx: Fixtures) -> DataFrame:
    return P.patch_pixels(fx.labels(), _size(fx), 50, 5)


def patches(fx: Fixtures) -> DataFrame:
    return P.patch_index(pixels(fx), block=10)


def counts(fx: Fixtures) -> DataFrame:
    return P.patch_class_counts(pixels(fx), patches(fx))


def fixed_split(fx: Fixtures) -> DataFrame:
    k = (F.col("block_r") * 3 + F.col("block_c")) % 7
    return patches(fx).withColumn("split", F.when(k < 5, "train").when(k == 5, "val").otherwise("test"))


@query("SELECT * FROM patches", PX)
def g1_patch_index(fx: Fixtures) -> DataFrame:
    return patches(fx)


@query(
    "SELECT patch_id, r0, c0, CAST(floor(r0 / 20) AS BIGINT) AS block_r, CAST(floor(c0 / 20) AS BIGINT) AS block_c, valid_frac FROM (SELECT concat(r0, '_', c0) AS patch_id, r0, c0, round(avg(CAST(model_id > 0 AS INT)), 6) AS valid_frac FROM o JOIN lab ON r >= r0 AND r < r0 + 10 AND c >= c0 AND c < c0 + 10 GROUP BY 1, 2, 3 HAVING avg(CAST(model_id > 0 AS INT)) >= 0.1 AND max(CAST(cdl_id = 3 AS INT)) = 1)",
    H + ", o AS (SELECT CAST(i * 5 AS BIGINT) AS r0, CAST(j * 5 AS BIGINT) AS c0 FROM h, range(0, 1000) a(i), range(0, 9) b(j) WHERE i * 5 + 10 <= height)",
)
def g1_patch_index_overlapping(fx: Fixtures) -> DataFrame:
    return P.overlapping_index(fx.labels(), _size(fx), 50, 10, 5, target=3, block=20)


@query("SELECT block_r, block_c, model_id, CAST(sum(n) AS BIGINT) AS n FROM pcounts JOIN patches USING (patch_id) WHERE model_id > 0 GROUP BY 1, 2, 3", PX)
def g2_block_histogram(fx: Fixtures) -> DataFrame:
    return P.block_histogram(counts(fx), patches(fx))


@query()
def g3_g4_assign_blocks(fx: Fixtures) -> DataFrame:
    return P.assign_blocks(P.block_histogram(counts(fx), patches(fx)), patches(fx))


@query(
    """SELECT s.split, k.model_id, s.n_blocks, s.n_patches, coalesce(x.n_px, 0) AS n_px, round(coalesce(x.n_px, 0) / sum(x.n_px) OVER (PARTITION BY k.model_id), 4) AS frac, coalesce(x.n_px, 0) / sum(x.n_px) OVER (PARTITION BY k.model_id) < 0.15 AS below_floor
    FROM (SELECT split, count(DISTINCT concat(block_r, '-', block_c)) AS n_blocks, count(*) AS n_patches FROM split GROUP BY 1) s CROSS JOIN (SELECT DISTINCT model_id FROM pcounts WHERE model_id > 0) k
    LEFT JOIN (SELECT split, model_id, CAST(sum(n) AS BIGINT) AS n_px FROM pcounts JOIN split USING (patch_id) WHERE model_id > 0 GROUP BY 1, 2) x ON x.split = s.split AND x.model_id = k.model_id""",
    SPLIT,
)
def g5_split_summary(fx: Fixtures) -> DataFrame:
    return P.split_summary(fixed_split(fx), counts(fx), 0.15)


@query("SELECT block_r, " + ", ".join(f"coalesce(max(CASE WHEN block_c = {j} THEN CASE split WHEN 'train' THEN 'TR' WHEN 'val' THEN 'VL' ELSE 'TS' END END), '') AS \"{j}\"" for j in range(5)) + " FROM split GROUP BY 1", SPLIT)
def g6_split_matrix(fx: Fixtures) -> DataFrame:
    return P.split_matrix(fixed_split(fx).select("block_r", "block_c", "split").distinct(), 5)


@query(
    "SELECT count(*) AS n_borders, CAST(sum(CAST(a.split <> b.split AS INT)) AS BIGINT) AS n_mixed FROM bl a JOIN bl b ON (b.block_r = a.block_r AND b.block_c = a.block_c + 1) OR (b.block_c = a.block_c AND b.block_r = a.block_r + 1)",
    SPLIT + ", bl AS (SELECT DISTINCT block_r, block_c, split FROM split)",
)
def g6_border_adjacency(fx: Fixtures) -> DataFrame:
    return P.border_adjacency(fixed_split(fx).select("block_r", "block_c", "split").distinct())


HASHED = "row_number() OVER (ORDER BY md5(concat(patch_id, '-42')), patch_id)"
CUTS = "greatest(1, CAST(floor(0.15 * count(*) OVER ()) AS BIGINT))"


@query(f"SELECT patch_id, CASE WHEN k <= n - v - t THEN 'train' WHEN k <= n - t THEN 'val' ELSE 'test' END AS split FROM (SELECT patch_id, {HASHED} AS k, count(*) OVER () AS n, {CUTS} AS v, {CUTS} AS t FROM patches)", PX)
def g7_random_split(fx: Fixtures) -> DataFrame:
    return P.random_split(patches(fx)).select("patch_id", "split")


@query(f"SELECT patch_id, CASE WHEN k <= n - greatest(1, CAST(floor(0.2 * n) AS BIGINT)) THEN 'train' ELSE 'val' END AS split FROM (SELECT patch_id, {HASHED} AS k, count(*) OVER () AS n FROM patches)", PX)
def g7_random_split_two_way(fx: Fixtures) -> DataFrame:
    return P.random_split(patches(fx), 0.2, 0).select("patch_id", "split")


@query("SELECT split, model_id, count(DISTINCT patch_id) AS n_patches FROM pcounts JOIN split USING (patch_id) WHERE model_id > 0 GROUP BY 1, 2", SPLIT)
def g8_patches_with_class(fx: Fixtures) -> DataFrame:
    return P.patches_with_class(fixed_split(fx), counts(fx))


WEIGHTS = PX + ", tot AS (SELECT model_id, sum(n) AS t FROM pcounts WHERE model_id > 0 GROUP BY 1), weights AS (SELECT patch_id, CASE WHEN sum(n / t) > 0 THEN sum(n / t) ELSE 1e-6 END AS weight FROM pcounts LEFT JOIN tot USING (model_id) GROUP BY 1)"


@query("SELECT patch_id, round(weight, 6) AS weight FROM weights", WEIGHTS)
def g9_patch_weights(fx: Fixtures) -> DataFrame:
    return P.patch_weights(counts(fx))


@query(
    """SELECT draw, patch_id FROM (SELECT i AS draw, CAST(concat('0x', substr(md5(concat(i, '-42')), 1, 12)) AS BIGINT) / 281474976710656.0 * (SELECT max(hi) FROM line) AS u FROM range(500) t(i)) d
    JOIN line ON d.u >= lo AND d.u < hi""",
    WEIGHTS
    + """, sized AS (SELECT *, greatest(1, least(count(*) OVER () // 1000, CAST(floor(sqrt(count(*) OVER ())) AS BIGINT))) AS buckets FROM weights),
    line AS (SELECT patch_id, hi, lag(hi, 1, 0) OVER (ORDER BY hi) AS lo FROM (SELECT patch_id, sum(weight) OVER (ORDER BY CAST(concat('0x', substr(md5(patch_id), 1, 12)) AS BIGINT) % buckets, patch_id) AS hi FROM sized))""",
)
def g10_weighted_sample(fx: Fixtures) -> DataFrame:
    return P.weighted_sample(P.patch_weights(counts(fx)), 500)


LC = "lc AS (SELECT model_id, CAST(count(*) AS DOUBLE) AS n FROM lab WHERE model_id > 0 OR cdl_id = 0 GROUP BY 1), f AS (SELECT *, n / (sum(n) OVER () + 1e-12) AS f, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS c FROM lc)"


@query("SELECT model_id, round(w / sum(w) OVER (), 6) AS weight FROM (SELECT model_id, 1 / (n / (sum(n) OVER () + 1e-9) + 1e-9) AS w FROM lc)", LC)
def g11_class_weights_inverse(fx: Fixtures) -> DataFrame:
    return P.class_weights(P.label_counts(fx.labels()))


@query("SELECT model_id, round((SELECT f FROM f WHERE k = floor((c + 1) / 2)) / (f + 1e-12), 6) AS weight FROM f", LC)
def g12_class_weights_median_frequency(fx: Fixtures) -> DataFrame:
    return P.class_weights(P.label_counts(fx.labels()), "median_freq")


@query("SELECT model_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT model_id, 1 / sqrt(f + 1e-12) AS w FROM f)", LC)
def g12_class_weights_inverse_root(fx: Fixtures) -> DataFrame:
    return P.class_weights(P.label_counts(fx.labels()), "invsqrt")


@query("SELECT model_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT model_id, (1 - b) / (1 - pow(b, n) + 1e-12) AS w FROM lc, (SELECT 1 - 1 / min(n) AS b FROM lc))", LC)
def g12_class_weights_effective_number(fx: Fixtures) -> DataFrame:
    return P.class_weights(P.label_counts(fx.labels()), "effnum")


@query(
    """SELECT g AS patch_id, CAST(k AS INT) AS class_id, round(greatest(1e-6, CASE WHEN n <= 0 THEN 1.0 WHEN n < (1 - 1.0 / 1001) / greatest(1 - pow(1.0 / 1001, 1.0 / t), 1e-12) THEN 1 - (1 - 1.0 / 1001) / greatest(1 - pow(1.0 / 1001, 1.0 / n), 1e-12) / t ELSE 1 - n / t END), 6) AS weight
    FROM (SELECT p.patch_id AS g, k, count(x.patch_id) AS n, any_value(p.t) AS t FROM (SELECT patch_id, count(*) AS t FROM px GROUP BY 1) p CROSS JOIN range(9) r(k) LEFT JOIN px x ON x.patch_id = p.patch_id AND x.model_id = k GROUP BY 1, 2)""",
    PX,
)
def g13_dynamic_weights(fx: Fixtures) -> DataFrame:
    return P.dynamic_weights(P.remap_labels(pixels(fx)).withColumnRenamed("model_id", "class_id"), "patch_id")


@query(
    f"""SELECT coalesce(role, 'all') AS role, CAST(coalesce(cls, -1) AS INT) AS class_id, count(*) AS n_px, round(count(*) * CAST(0.01 AS DOUBLE), 6) AS hectares, round(CASE WHEN grouping(role) = 1 THEN 100 ELSE 100 * count(*) / max(any_value(t)) OVER (PARTITION BY role) END, 6) AS pct
    FROM (SELECT role, CASE WHEN cdl_id IN {KEEP} THEN cdl_id ELSE 0 END AS cls, count(*) OVER (PARTITION BY role) AS t FROM (SELECT CASE WHEN r % 5 = 0 THEN 'test' ELSE 'train' END AS role, cdl_id FROM px_labels)) GROUP BY ROLLUP (role, cls)"""
)
def g14_class_distribution(fx: Fixtures) -> DataFrame:
    roles = fx.labels().withColumn("role", F.when(F.col("r") % 5 == 0, "test").otherwise("train"))
    return P.class_distribution(roles).withColumns({"role": F.coalesce("role", F.lit("all")), "class_id": F.coalesce("class_id", F.lit(-1))})


@query("SELECT cdl_id, count(*) AS n_px FROM px_labels WHERE cdl_id <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def g15_top_classes_by_area(fx: Fixtures) -> DataFrame:
    return P.top_classes_by_area(fx.labels(), 5)


@query("SELECT cdl_id, count(*) AS n_px FROM px_labels WHERE cdl_id <> 0 GROUP BY 1 HAVING count(*) >= 0.09 * (SELECT count(*) FROM px_labels)")
def g16_choose_classes(fx: Fixtures) -> DataFrame:
    return P.choose_classes(fx.labels(), min_share=0.09)


CHIPS = PX + ", chips AS (SELECT p.patch_id, o.channel_idx, string_agg(CAST(CAST(coalesce(o.value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY (p.r - p.r0) * 5 + p.c - p.c0) AS cells FROM px p SEMI JOIN patches USING (patch_id) JOIN obs o ON o.pixel_id = p.pixel_id GROUP BY 1, 2)"


def chips(fx: Fixtures, obs: DataFrame | None = None) -> DataFrame:
    every = fx.channels().select("channel", F.col("channel_idx").alias("ordinal"))
    return P.build_chips(fx.obs() if obs is None else obs, patches(fx), every, 5)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("cells"))


@query("SELECT patch_id, CAST(channel_idx AS INT) AS channel_idx, cells FROM chips", CHIPS)
def g17_build_chips(fx: Fixtures) -> DataFrame:
    return as_text(chips(fx), "patch_id", "channel_idx")


@query("SELECT patch_id, CAST(channel_idx AS INT) AS channel_idx, cells FROM chips", CHIPS)
def g17_stored_chips(fx: Fixtures) -> DataFrame:
    """From observations that were written bucketed by patch: the chips need no exchange of them."""
    name = f"obs_{uuid.uuid4().hex}"
    stored = storage.write_by_patch(fx.obs(), name, 5, 8, f"{shared_folder(fx.spark)}/{name}")
    return as_text(chips(fx, stored), "patch_id", "channel_idx")


@query("SELECT patch_id, string_agg(CAST(model_id AS VARCHAR), ',' ORDER BY (r - r0) * 5 + c - c0) AS cells FROM px SEMI JOIN patches USING (patch_id) GROUP BY 1", PX)
def g17_build_masks(fx: Fixtures) -> DataFrame:
    return P.build_masks(pixels(fx), patches(fx), 5).select("patch_id", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("cells"))


@query("SELECT pixel_id, channel, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9), 6) AS value FROM (SELECT p.pixel_id, p.patch_id, o.channel, coalesce(o.value, 0) AS v FROM px p JOIN obs o ON o.pixel_id = p.pixel_id) WINDOW w AS (PARTITION BY patch_id, channel)", PX)
def g18_normalise_patch(fx: Fixtures) -> DataFrame:
    every = fx.channels().select("channel", F.col("channel_idx").alias("ordinal"))
    full = P.build_chips(fx.obs(), pixels(fx).select("r0", "c0").distinct(), every, 5)
    cells = P.normalise_chips(full).join(F.broadcast(every), F.col("channel_idx") == F.col("ordinal")).select("r0", "c0", "channel", F.posexplode("values").alias("_p", "value"))
    return cells.select(((F.col("r0") + F.floor(F.col("_p") / 5)) * 50 + F.col("c0") + F.col("_p") % 5).alias("pixel_id"), "channel", "value")


@query("SELECT pixel_id, channel, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9), 6) AS value FROM (SELECT p.pixel_id, p.patch_id, o.channel, coalesce(o.value, 0) AS v FROM px p JOIN obs o ON o.pixel_id = p.pixel_id) WINDOW w AS (PARTITION BY patch_id, channel)", PX)
def g18_normalise_pixels(fx: Fixtures) -> DataFrame:
    """The same of a pixel table, without chips."""
    own = fx.obs().join(pixels(fx).select("pixel_id", "patch_id"), "pixel_id").withColumn("channel", F.concat_ws("_", "band", "date8"))
    return P.normalise_patch(own).select("pixel_id", "channel", "value")


@query("SELECT band, round(lo, 6) AS lo, round(hi, 6) AS hi FROM stats", STATS)
def g19_norm_stats_percentile(fx: Fixtures) -> DataFrame:
    return P.norm_stats(fx.obs())


@query("SELECT band, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1")
def g19_norm_stats_minmax(fx: Fixtures) -> DataFrame:
    return P.norm_stats(fx.obs(), "minmax")


@query("SELECT band, round(avg(value), 6) AS lo, round(stddev_pop(value), 6) AS hi FROM obs GROUP BY 1")
def g19_norm_stats_zscore(fx: Fixtures) -> DataFrame:
    return P.norm_stats(fx.obs(), "zscore")


@query("SELECT pixel_id, date8, band, CASE WHEN value IS NOT NULL THEN round(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1))), 6) END AS value FROM obs JOIN stats USING (band)", STATS)
def g20_normalise(fx: Fixtures) -> DataFrame:
    return P.normalise(fx.obs(), P.norm_stats(fx.obs())).select("pixel_id", "date8", "band", "value")


@query("SELECT pixel_id, date8, band, round((value - m) / s, 6) AS value, round((value - m) / greatest(s - m, 1), 4) AS compat FROM obs JOIN (SELECT band, avg(value) AS m, stddev_pop(value) AS s FROM obs GROUP BY 1) USING (band)")
def g20_normalise_zscore(fx: Fixtures) -> DataFrame:
    stats = P.norm_stats(fx.obs(), "zscore")
    z = P.normalise(fx.obs(), stats, "zscore").select("pixel_id", "date8", "band", "value")
    literal = P.normalise(fx.obs(), stats, "zscore", compat=True).select("pixel_id", "date8", "band", F.round("value", 4).alias("compat"))
    return z.join(literal, ["pixel_id", "date8", "band"])


@query("SELECT channel, round(m, 6) AS mean, round(CASE WHEN sqrt(greatest(ss - m * m, 0)) < 1 THEN 1 ELSE sqrt(greatest(ss - m * m, 0)) END, 6) AS std FROM (SELECT channel, avg(coalesce(value, 0)) AS m, avg(coalesce(value, 0) * coalesce(value, 0)) AS ss FROM obs GROUP BY 1)")
def g21_channel_stats(fx: Fixtures) -> DataFrame:
    return P.channel_stats(fx.obs().withColumn("channel", F.concat_ws("_", "band", "date8")))


@query()
def g22_augment(fx: Fixtures) -> DataFrame:
    own = fx.obs().join(pixels(fx).select("pixel_id", "patch_id", "r0", "c0"), "pixel_id")
    cells = own.select("patch_id", "band", F.concat_ws("_", "band", "date8").alias("channel"), (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), (F.coalesce("value", F.lit(0.0)) / 4000).alias("value"))
    return P.augment(cells, 5)


@query(
    "SELECT w.patch_id AS window_id, o.r - w.r0 + 1 AS dr, o.c - w.c0 + 1 AS dc, o.date8, o.band, o.value FROM patches w JOIN obs o ON o.r >= w.r0 - 1 AND o.r < w.r0 + 6 AND o.c >= w.c0 - 1 AND o.c < w.c0 + 6",
    PX,
)
def g23_extract_windows(fx: Fixtures) -> DataFrame:
    """Every patch with a margin of one pixel."""
    origins = patches(fx).select(F.col("patch_id").alias("window_id"), (F.col("r0") - 1).alias("r0"), (F.col("c0") - 1).alias("c0"))
    return P.extract_windows(fx.obs(), origins, 7)


@query(
    """SELECT patch_id, year, 'test' AS split FROM yp WHERE year = 2024 UNION ALL SELECT patch_id, year, CASE WHEN k <= n - greatest(1, CAST(floor(0.15 * n) AS BIGINT)) THEN 'train' ELSE 'val' END FROM (SELECT patch_id, year, row_number() OVER (ORDER BY md5(concat(patch_id, '-42')), patch_id, year) AS k, count(*) OVER () AS n FROM yp WHERE year < 2024)""",
    PX + ", yp AS (SELECT patch_id, CAST(2022 + (r0 + c0) % 3 AS INT) AS year FROM patches)",
)
def g24_year_split(fx: Fixtures) -> DataFrame:
    p = patches(fx).select("patch_id", (2022 + (F.col("r0") + F.col("c0")) % 3).cast("int").alias("year"))
    return P.year_split(p, (2022, 2023), 2024)


@query("SELECT count(*) AS n_valid, (SELECT count(DISTINCT patch_id) FROM px) AS n_total, least(count(*), 100) AS n_chips, round(least(count(*), 100) * ((40 * 25 * 4 + 25 * 8) * CAST(0.45 AS DOUBLE)), 6) AS bytes FROM patches", PX)
def a13_estimate_chips(fx: Fixtures) -> DataFrame:
    total = pixels(fx).select("patch_id").distinct().count()
    return P.estimate_chips(patches(fx), 40, 5, total, 100)


@query("SELECT patch_id, CAST(channel_idx AS INT) AS channel_idx, split, cells FROM chips JOIN split USING (patch_id)", CHIPS + SPLIT[len(PX) :])
def a13_write_chips(fx: Fixtures) -> DataFrame:
    path = f"{shared_folder(fx.spark)}/chips-{uuid.uuid4().hex}"
    write_chips(chips(fx).join(fixed_split(fx).select("patch_id", "split"), "patch_id"), path)
    back = fx.spark.read.parquet(path)
    return as_text(back, "patch_id", "channel_idx", "split")



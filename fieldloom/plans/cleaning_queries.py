"""Queries of the catalogue, cleaning, sampling and time-series operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import catalog, cleaning, sampling, series
from fieldloom.plans.registry import query
from fieldloom.sources.fixtures import Fixtures

BANDS = ["B2", "B4", "B8", "B11"]
KEEP = "(1, 3, 24, 36, 54, 69, 75, 76)"
NAMED = "CASE cdl_id WHEN 1 THEN 'Corn' WHEN 3 THEN 'Rice' WHEN 24 THEN 'Winter Wheat' WHEN 36 THEN 'Alfalfa' WHEN 54 THEN 'Tomatoes' WHEN 69 THEN 'Grapes' WHEN 75 THEN 'Almonds' WHEN 76 THEN 'Walnuts' WHEN 0 THEN 'Background' ELSE concat('Class ', cdl_id) END"
SCENES = r"""named AS (SELECT *, string_split(path, '/')[-1] AS name FROM scene_files),
parsed AS (SELECT file_id, path, length, name,
  CAST(nullif(regexp_extract(name, '^S2H_(\d{4})_(\d{4}_\d{2}_\d{2})(_processed)?\.tif$', 1), '') AS INT) AS product_year,
  nullif(replace(regexp_extract(name, '^S2H_(\d{4})_(\d{4}_\d{2}_\d{2})(_processed)?\.tif$', 2), '_', ''), '') AS date8,
  regexp_extract(name, '^S2H_(\d{4})_(\d{4}_\d{2}_\d{2})(_processed)?\.tif$', 3) <> '' AS processed FROM named),
cat AS (SELECT path, max(length) AS length, product_year, date8, processed FROM parsed WHERE name NOT LIKE '.\_%' ESCAPE '\' AND product_year IS NOT NULL GROUP BY ALL)"""


@query("SELECT file_id, coalesce(product_year, -1) AS product_year, date8, processed FROM parsed", SCENES)
def a1_parse_scene_names(fx: Fixtures) -> DataFrame:
    return catalog.parse_scene_name(fx.scene_files()).select("file_id", F.coalesce("product_year", F.lit(-1)).alias("product_year"), "date8", "processed")


@query("SELECT file_id, coalesce(date8, substr(name, 1, 8)) AS date8 FROM parsed", SCENES)
def a1_parse_prefix_fallback(fx: Fixtures) -> DataFrame:
    return catalog.parse_scene_name(fx.scene_files(), fallback="prefix").select("file_id", "date8")


@query("SELECT path, length, product_year, date8, processed FROM cat WHERE product_year IN (1996, 1998, 2000)", SCENES)
def a2_scene_catalog(fx: Fixtures) -> DataFrame:
    return catalog.scene_catalog(fx.scene_files(), (1996, 1998, 2000)).select("path", "length", "product_year", "date8", "processed")


@query("SELECT product_year, string_agg(date8, ',' ORDER BY date8) AS dates FROM (SELECT DISTINCT product_year, date8 FROM cat) GROUP BY 1", SCENES)
def a3_dates_by_year(fx: Fixtures) -> DataFrame:
    return catalog.dates_by_year(catalog.scene_catalog(fx.scene_files())).withColumn("dates", F.array_join("dates", ","))


@query(
    """SELECT CAST(y.y AS INT) AS product_year, CASE WHEN count(c.path) > 0 THEN 'OK' ELSE 'MISSING' END AS status, count(c.path) AS n_files, CAST(coalesce(sum(c.length), 0) AS BIGINT) AS total_bytes
    FROM (VALUES (1993), (1994), (1995), (1996), (2001), (2002)) y(y) LEFT JOIN cat c ON c.product_year = y.y GROUP BY 1""",
    SCENES,
)
def a3_verify_inventory(fx: Fixtures) -> DataFrame:
    return catalog.verify_inventory(catalog.scene_catalog(fx.scene_files()), (1993, 1994, 1995, 1996, 2001, 2002))


@query("SELECT DISTINCT date8 FROM cat WHERE NOT processed AND date8 NOT IN (SELECT date8 FROM cat WHERE processed AND length > 0)", SCENES)
def a4_pending_scenes(fx: Fixtures) -> DataFrame:
    c = catalog.scene_catalog(fx.scene_files())
    return catalog.pending_scenes(c.where(~F.col("processed")), c.where("processed"))


MAGICS = ("49492A00", "4D4D002A", "49492B00", "4D4D002B", "FFD8FFE0", "2A004949")


@query(f"SELECT o_orderkey AS file_id, m AS magic, m IN {MAGICS[:4]} AS ok FROM (SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MAGICS)) + " END AS m FROM orders)")
def a5_check_magic(fx: Fixtures) -> DataFrame:
    head = F.array(*(F.lit(m) for m in MAGICS))[(F.col("o_orderkey") % 6).cast("int")]
    files = fx.table("orders").select(F.col("o_orderkey").alias("file_id"), F.unhex(F.concat(head, F.lit("00000008"))).alias("content"))
    return catalog.check_magic(files).select("file_id", "magic", "ok")


def _size(fx: Fixtures) -> int:
    """Rows of the grid; its columns are 50."""
    return fx.labels().agg(F.max("r") + 1).first()[0]


TILES = """h AS (SELECT max(r) + 1 AS height FROM px_labels),
tiles AS (SELECT date8, band, CAST(floor(r / 16) AS BIGINT) AS tile_r, CAST(floor(c / 16) AS BIGINT) AS tile_c, count(value) AS n_found,
  CAST(least(16, height - CAST(floor(r / 16) AS BIGINT) * 16) * least(16, 50 - CAST(floor(c / 16) AS BIGINT) * 16) AS BIGINT) AS n_expected FROM obs, h GROUP BY 1, 2, 3, 4, height)"""


@query("SELECT * FROM tiles", TILES)
def a6_scan_tiles(fx: Fixtures) -> DataFrame:
    return catalog.scan_tiles(fx.obs(), _size(fx), 50, 16)


@query("SELECT date8, count(*) AS n_tiles, CAST(sum(CAST(n_found = n_expected AS INT)) AS BIGINT) AS n_ok, CASE WHEN bool_and(n_found = n_expected) THEN 'OK' ELSE 'FAIL' END AS status FROM tiles GROUP BY 1", TILES)
def a6_scan_summary(fx: Fixtures) -> DataFrame:
    return catalog.scan_summary(catalog.scan_tiles(fx.obs(), _size(fx), 50, 16))


GRIDS = """grids AS (SELECT o_orderkey AS grid_id, CAST(2020 + o_orderkey % 5 AS INT) AS year, 100 + o_custkey % 2 AS width, 50 AS height, CASE WHEN o_custkey % 7 <> 0 THEN 'EPSG:4326' END AS crs FROM orders)"""


@query("SELECT grid_id, year, width = 100 AND (crs IS NOT DISTINCT FROM CASE WHEN year <> 2022 THEN 'EPSG:4326' END) AS aligned FROM grids", GRIDS)
def a10_grid_alignment(fx: Fixtures) -> DataFrame:
    o = fx.table("orders")
    grids = o.select(F.col("o_orderkey").alias("grid_id"), (2020 + F.col("o_orderkey") % 5).cast("int").alias("year"), (100 + F.col("o_custkey") % 2).alias("width"), F.lit(50).alias("height"), F.when(F.col("o_custkey") % 7 != 0, "EPSG:4326").alias("crs"))
    own = grids.select("year").distinct().select("year", F.lit(100).alias("width"), F.lit(50).alias("height"), F.when(F.col("year") != 2022, "EPSG:4326").alias("crs"))
    return catalog.check_alignment(grids, own).select("grid_id", "year", "aligned")


CHANNELS = "channels AS (SELECT DISTINCT channel, band, date8, substr(date8, 5, 4) AS mmdd, CAST(substr(date8, 1, 4) AS INT) AS year, CAST((channel_idx - band_idx) / 4 AS INT) AS scene_idx, band_idx, channel_idx FROM obs)"


@query("SELECT * FROM channels", CHANNELS)
def a11_channels(fx: Fixtures) -> DataFrame:
    return catalog.build_channels(fx.obs(), BANDS)


@query("SELECT substr(date8, 5, 4) AS mmdd, date8, CAST(row_number() OVER (ORDER BY date8) - 1 AS INT) AS scene_idx FROM (SELECT DISTINCT date8 FROM obs2) t")
def a12_local_band_map(fx: Fixtures) -> DataFrame:
    both = fx.obs().select("date8").unionByName(fx.second_year().select("date8"))
    return catalog.local_band_map(both)


@query("SELECT date8, CAST(sum(CAST(value < 0 AS INT)) AS BIGINT) AS n_invalid, count(*) AS n_total FROM raw_obs GROUP BY 1")
def b1_invalid_counts(fx: Fixtures) -> DataFrame:
    return cleaning.invalid_counts(fx.raw_obs())


@query("SELECT pixel_id, date8, band, CASE WHEN value >= 0 THEN value ELSE -9999.0 END AS value FROM raw_obs")
def b1_assign_nodata(fx: Fixtures) -> DataFrame:
    noisy = fx.raw_obs().withColumn("value", F.when((F.col("value") < 0) & (F.col("pixel_id") % 2 == 0), float("nan")).otherwise(F.col("value")))
    return cleaning.assign_nodata(noisy).select("pixel_id", "date8", "band", "value")


@query("SELECT date8, band, count(value) AS n_valid, round(sum(value), 6) AS total FROM obs GROUP BY 1, 2")
def b2_to_null(fx: Fixtures) -> DataFrame:
    return cleaning.to_null(fx.raw_obs()).groupBy("date8", "band").agg(F.count("value").alias("n_valid"), F.sum("value").alias("total"))


@query(
    """SELECT date8, round(avg(CAST(ok AS DOUBLE)), 6) AS valid_frac, avg(CAST(ok AS DOUBLE)) >= 0.01 AS keep FROM (
    SELECT date8, pixel_id, bool_and(value IS NOT NULL AND value > 0) AS ok FROM obs, (SELECT max(r) + 1 AS h FROM px_labels)
    WHERE r >= greatest(0, CAST(floor((h - 20) / 2) AS BIGINT)) AND r < greatest(0, CAST(floor((h - 20) / 2) AS BIGINT)) + 20 AND c >= 15 AND c < 35 GROUP BY 1, 2) GROUP BY 1"""
)
def b3_has_valid_data(fx: Fixtures) -> DataFrame:
    return cleaning.has_valid_data(fx.obs(), _size(fx), 50, 20)


@query("SELECT date8, round(count(value) / count(*), 6) AS valid_frac FROM obs WHERE band IN ('B2', 'B8', 'B11') GROUP BY 1")
def b4_valid_fraction(fx: Fixtures) -> DataFrame:
    return cleaning.valid_fraction(fx.obs(), bands=("B2", "B8", "B11"))


@query(
    """SELECT date8, round(count(value) / count(*), 6) AS valid_frac FROM obs JOIN wins ON r >= r0 AND r < r0 + s AND c >= c0 AND c < c0 + s WHERE band IN ('B2', 'B8', 'B11') GROUP BY 1""",
    """h AS (SELECT max(r) + 1 AS height, greatest(1, least(512, 12, CAST(floor((max(r) + 1) / 4) AS BIGINT))) AS s FROM px_labels),
    wins AS (SELECT CAST(floor((height - s) * i / 2) AS BIGINT) AS r0, CAST(floor((50 - s) * j / 2) AS BIGINT) AS c0, s FROM h, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j))""",
)
def b4_valid_fraction_windows(fx: Fixtures) -> DataFrame:
    return cleaning.valid_fraction(fx.obs(), _size(fx), 50, ("B2", "B8", "B11"))


@query("SELECT date8, round(count(value) / count(*), 6) AS valid_frac, count(value) / count(*) >= 0.942 AS kept FROM obs GROUP BY 1 UNION ALL SELECT '20241231', 0.0, false")
def b5_filter_valid_dates(fx: Fixtures) -> DataFrame:
    dates = fx.obs().select("date8").distinct()
    more = dates.limit(1).select(F.lit("20241231").alias("date8"))
    return cleaning.filter_valid_dates(cleaning.valid_fraction(fx.obs()), dates.unionByName(more), 0.942)


@query("SELECT date8, round(100 * avg(CAST(value <> -9999 AS INT)), 6) AS valid_pct, 100 * avg(CAST(value <> -9999 AS INT)) >= 94.2 AS above_line FROM raw_obs WHERE band = 'B2' GROUP BY 1")
def b6_coverage_by_date(fx: Fixtures) -> DataFrame:
    return cleaning.coverage_by_date(fx.raw_obs(), "B2", 94.2)


@query(f"SELECT pixel_id, CASE WHEN cdl_id IN {KEEP} THEN cdl_id ELSE 0 END AS cdl_id FROM px_labels")
def b7_filter_labels(fx: Fixtures) -> DataFrame:
    return cleaning.filter_labels(fx.labels()).select("pixel_id", "cdl_id")


@query("SELECT pixel_id, model_id FROM lab")
def b8_remap_labels(fx: Fixtures) -> DataFrame:
    return cleaning.remap_labels(fx.labels()).select("pixel_id", "model_id")


@query(f"SELECT pixel_id, cdl_id, {NAMED} AS class_name FROM (SELECT pixel_id, CASE WHEN cdl_id = 61 THEN 0 ELSE cdl_id END AS cdl_id FROM px_labels)")
def b9_collapse_and_name(fx: Fixtures) -> DataFrame:
    return cleaning.with_class_names(cleaning.collapse_non_crop(fx.labels())).select("pixel_id", "cdl_id", "class_name")


@query("SELECT pixel_id, CASE WHEN confidence < 55 THEN 255 ELSE cdl_id END AS cdl_id FROM px_labels")
def b10_confidence_mask(fx: Fixtures) -> DataFrame:
    return cleaning.confidence_mask(fx.labels()).select("pixel_id", "cdl_id")


@query("SELECT d.pixel_id, d.r, d.c, coalesce(s.cdl_id, 0) AS cdl_id FROM px_labels d LEFT JOIN px_labels s ON s.r = CAST(floor((d.r + 0.5) * 0.375 + 4) AS BIGINT) AND s.c = CAST(floor((d.c + 0.5) * 0.375 - 2) AS BIGINT)")
def b11_resample_labels(fx: Fixtures) -> DataFrame:
    return cleaning.resample_labels(fx.labels(), fx.labels(), 0.375, 4, -2)


def _albers_sql() -> str:
    """The equal-area projection of longitude ``lon`` and latitude ``lat`` in degrees, spelt out with its constants."""
    flat = 1 / 298.257222101
    e = math.sqrt(flat * (2 - flat))

    def q(s: float) -> float:
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s1, s2, s0 = (math.sin(math.radians(d)) for d in (29.5, 45.5, 23.0))
    m1, m2 = ((1 - s * s) / (1 - e * e * s * s) for s in (s1, s2))
    n = (m1 - m2) / (q(s2) - q(s1))
    c = m1 + n * q(s1)
    rho0 = 6378137.0 * math.sqrt(c - n * q(s0)) / n
    sin = "sin(radians(lat))"
    sql_q = f"{1 - e * e!r}::DOUBLE * ({sin} / (1 - {e * e!r}::DOUBLE * {sin} * {sin}) - ln((1 - {e!r}::DOUBLE * {sin}) / (1 + {e!r}::DOUBLE * {sin})) / {2 * e!r}::DOUBLE)"
    return f"""alb AS (SELECT pixel_id, r, c, {rho0!r}::DOUBLE - rho * cos(theta) AS y, rho * sin(theta) AS x FROM (SELECT pixel_id, r, c,
    6378137.0::DOUBLE * sqrt({c!r}::DOUBLE - {n!r}::DOUBLE * ({sql_q})) / {n!r}::DOUBLE AS rho, {n!r}::DOUBLE * radians(lon + 96.0::DOUBLE) AS theta
    FROM (SELECT pixel_id, r, c, -121.5::DOUBLE + c * 0.0004::DOUBLE AS lon, 38.6::DOUBLE - r * 0.0003::DOUBLE AS lat FROM px_labels)))"""


ALBERS = (-2173900.0, 36.0, 2023600.0, 34.0)  # left edge, pixel width, top edge, pixel height


@query(
    f"SELECT a.pixel_id, a.r, a.c, CAST(coalesce(s.cdl_id, 0) AS INT) AS cdl_id FROM alb a LEFT JOIN px_labels s ON s.r = CAST(floor(({ALBERS[2]}::DOUBLE - a.y) / {ALBERS[3]}::DOUBLE) AS BIGINT) AND s.c = CAST(floor((a.x - {ALBERS[0]}::DOUBLE) / {ALBERS[1]}::DOUBLE) AS BIGINT)",
    _albers_sql(),
)
def b11_resample_albers(fx: Fixtures) -> DataFrame:
    """A raster in degrees over the equal-area one."""
    lon, lat = F.lit(-121.5) + F.col("c") * F.lit(0.0004), F.lit(38.6) - F.col("r") * F.lit(0.0003)
    return cleaning.resample_albers(fx.labels(), fx.labels(), lon, lat, ALBERS)


def _majority(source: str, name: str) -> str:
    return f"""{name}_n AS (SELECT a.pixel_id, b.cdl_id, count(*) AS n FROM {source} a JOIN {source} b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2),
    {name} AS (SELECT a.pixel_id, a.r, a.c, m.cdl_id FROM {source} a JOIN (SELECT pixel_id, cdl_id, row_number() OVER (PARTITION BY pixel_id ORDER BY n DESC, cdl_id) AS k FROM {name}_n) m USING (pixel_id) WHERE k = 1)"""


def _eroded(source: str, name: str) -> str:
    return f"""{name} AS (SELECT a.pixel_id, a.r, a.c, CAST(CASE WHEN count(b.pixel_id) = 4 THEN any_value(a.cdl_id) ELSE 255 END AS INT) AS cdl_id, count(b.pixel_id) = 4 AS inner_ FROM {source} a
    LEFT JOIN {source} b ON b.cdl_id = a.cdl_id AND ((b.r = a.r AND abs(b.c - a.c) = 1) OR (b.c = a.c AND abs(b.r - a.r) = 1)) GROUP BY 1, 2, 3)"""


FILTERED = f"filt AS (SELECT pixel_id, r, c, CASE WHEN confidence < 55 THEN 255 WHEN cdl_id IN {KEEP} THEN cdl_id ELSE 0 END AS cdl_id FROM px_labels)"


@query("SELECT pixel_id, cdl_id FROM maj", _majority("px_labels", "maj"))
def b12_majority_filter(fx: Fixtures) -> DataFrame:
    return cleaning.majority_filter(fx.labels()).select("pixel_id", "cdl_id")


@query("SELECT pixel_id, cdl_id FROM ero", _eroded("px_labels", "ero"))
def b13_erode_boundaries(fx: Fixtures) -> DataFrame:
    return cleaning.erode_boundaries(fx.labels()).select("pixel_id", "cdl_id")


def _components(mask: str) -> str:
    """Components of ``mask (r, c, cdl_id)`` by spreading the least id, which reaches across small ones in three steps."""
    return f"""reach AS (SELECT r AS r0, c AS c0, r, c, cdl_id, 0 AS k FROM {mask} UNION
      SELECT a.r0, a.c0, b.r, b.c, b.cdl_id, a.k + 1 FROM reach a JOIN {mask} b ON b.cdl_id = a.cdl_id AND abs(b.r - a.r) + abs(b.c - a.c) = 1 WHERE a.k < 3),
      small AS (SELECT r0 AS r, c0 AS c FROM (SELECT DISTINCT r0, c0, r, c FROM reach) GROUP BY 1, 2 HAVING count(*) < 4)"""


@query("SELECT e.pixel_id, CAST(CASE WHEN e.inner_ AND s.r IS NULL THEN e.cdl_id ELSE 255 END AS INT) AS cdl_id FROM ero e LEFT JOIN small s ON s.r = e.r AND s.c = e.c", _eroded("px_labels", "ero") + ", mask AS (SELECT r, c, cdl_id FROM ero WHERE inner_), " + _components("mask"))
def b14_drop_small_components(fx: Fixtures) -> DataFrame:
    return cleaning.drop_small_components(fx.labels()).select("pixel_id", "cdl_id")


@query("SELECT pixel_id, cdl_id FROM filt", FILTERED)
def b15_process_labels(fx: Fixtures) -> DataFrame:
    return cleaning.process_labels(fx.labels()).select("pixel_id", "cdl_id")


@query("SELECT e.pixel_id, CAST(CASE WHEN e.inner_ AND s.r IS NULL THEN e.cdl_id ELSE 255 END AS INT) AS cdl_id FROM ero e LEFT JOIN small s ON s.r = e.r AND s.c = e.c", FILTERED + ", " + _majority("filt", "maj") + ", " + _eroded("maj", "ero") + ", mask AS (SELECT r, c, cdl_id FROM ero WHERE inner_), " + _components("mask"))
def b15_process_labels_legacy(fx: Fixtures) -> DataFrame:
    return cleaning.process_labels(fx.labels(), legacy=True).select("pixel_id", "cdl_id")


@query("SELECT pixel_id, cdl_id FROM maj", _eroded("px_labels", "ero") + ", " + _majority("ero", "maj"))
def b16_refine_labels(fx: Fixtures) -> DataFrame:
    return cleaning.refine_labels(fx.labels(), erode=1, majority=3).select("pixel_id", "cdl_id")


@query("SELECT factor, date8, band, CAST(floor(r / factor) AS BIGINT) AS r, CAST(floor(c / factor) AS BIGINT) AS c, round(avg(value), 6) AS value FROM obs CROSS JOIN (VALUES (4), (8), (16), (32)) f(factor) GROUP BY 1, 2, 3, 4, 5")
def b17_overviews(fx: Fixtures) -> DataFrame:
    return cleaning.overviews(fx.obs())


@query("SELECT pixel_id, r, c, cdl_id FROM px_labels WHERE r % 3 = 0 AND c % 3 = 0")
def b18_downsample(fx: Fixtures) -> DataFrame:
    return cleaning.downsample(fx.labels(), 3).select("pixel_id", "r", "c", "cdl_id")


CROPS = f"crops AS (SELECT pixel_id, cdl_id FROM px_labels WHERE cdl_id IN {KEEP})"
SAMPLED = CROPS + ", ids AS (SELECT pixel_id, CAST(cdl_id AS INT) AS class_label FROM crops ORDER BY md5(concat(pixel_id, '-42')), pixel_id LIMIT (SELECT least(count(*), greatest(50, CAST(floor(0.2 * count(*)) AS BIGINT))) FROM crops))"


def _crops(fx: Fixtures) -> DataFrame:
    return fx.labels().where(F.col("cdl_id").isin(*cleaning.KEEP_CLASSES))


@query("SELECT pixel_id FROM ids", SAMPLED)
def c1_sample_ids(fx: Fixtures) -> DataFrame:
    return sampling.sample_ids(_crops(fx), least=50).select("pixel_id")


@query("SELECT pixel_id, class_label, channel, value FROM obs JOIN (SELECT pixel_id, CAST(cdl_id AS INT) AS class_label FROM crops ORDER BY md5(concat(pixel_id, '-42')), pixel_id LIMIT (SELECT least(count(*), greatest(1000, CAST(floor(0.2 * count(*)) AS BIGINT))) FROM crops)) USING (pixel_id)", CROPS)
def c1_sample_pixels(fx: Fixtures) -> DataFrame:
    return sampling.sample_pixels(fx.obs(), _crops(fx)).select("pixel_id", "class_label", F.explode("features").alias("channel", "value"))


@query("SELECT pixel_id, cdl_id FROM px_labels WHERE cdl_id <> 0 AND pixel_id IN (SELECT pixel_id FROM obs GROUP BY 1 HAVING count(value) = 24) ORDER BY md5(concat(pixel_id, '-42')), pixel_id LIMIT 200")
def c2_sample_complete_pixels(fx: Fixtures) -> DataFrame:
    return sampling.sample_complete_pixels(fx.obs(), fx.labels(), 24, 200)


@query("SELECT area, pixel_id FROM (SELECT area, pixel_id, row_number() OVER (PARTITION BY area ORDER BY md5(concat(pixel_id, '-42')), pixel_id) AS k FROM areas GROUP BY area, pixel_id HAVING count(value) = count(*)) WHERE k <= 60")
def c3_sample_area(fx: Fixtures) -> DataFrame:
    return sampling.sample_area(fx.areas(), 60)


@query(
    "SELECT o.date8, o.band, d.draw, round(o.value, 6) AS value FROM obs o JOIN draws d ON o.date8 = d.date8 AND o.r = d.r AND o.c = d.c WHERE o.value IS NOT NULL",
    """h AS (SELECT max(r) + 1 AS height FROM px_labels),
    hashed AS (SELECT date8, CAST(i AS BIGINT) AS draw, md5(concat_ws('-', date8, i, '42')) AS m FROM (SELECT DISTINCT date8 FROM obs), range(200) t(i)),
    draws AS (SELECT date8, draw, CAST(concat('0x', substr(m, 1, 8)) AS BIGINT) % height AS r, CAST(concat('0x', substr(m, 9, 8)) AS BIGINT) % 50 AS c FROM hashed, h)""",
)
def c4_sample_per_band(fx: Fixtures) -> DataFrame:
    return sampling.sample_per_band(fx.obs(), 200, _size(fx), 50, n_bands=4)


@query("SELECT pixel_id FROM px_labels ORDER BY md5(concat(pixel_id, '-42')), pixel_id LIMIT 123")
def c5_cap_rows(fx: Fixtures) -> DataFrame:
    return sampling.cap_rows(fx.labels(), 123).select("pixel_id")


@query("SELECT count(*) AS n_pixels, CAST(sum(CAST(NOT ok AS INT)) AS BIGINT) AS n_missing, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS n_clean, round(100 * avg(CAST(ok AS INT)), 6) AS clean_pct FROM (SELECT pixel_id, count(value) = count(*) AS ok FROM obs GROUP BY 1)")
def c6_missing_summary(fx: Fixtures) -> DataFrame:
    return sampling.missing_summary(fx.obs())


TWO = "two AS (SELECT pixel_id, date8, max(CASE WHEN band = 'B4' THEN value END) AS red, max(CASE WHEN band = 'B8' THEN value END) AS nir FROM obs GROUP BY 1, 2)"
NDVI = TWO + ", ndvi AS (SELECT pixel_id, date8, (nir - red) / nullif(nir + red, 0) AS ndvi FROM two)"
MEANS = NDVI + f", means AS (SELECT date8, round(count(ndvi) / count(*), 6) AS valid_frac, CASE WHEN count(ndvi) / count(*) >= 0.8 THEN round(avg(ndvi), 6) END AS mean_ndvi FROM ndvi JOIN px_labels USING (pixel_id) WHERE cdl_id IN {KEEP} GROUP BY 1)"


def means(fx: Fixtures) -> DataFrame:
    out = series.mean_ndvi_of(fx.obs(), fx.labels(), cleaning.KEEP_CLASSES, fx.dates())
    return out.withColumn("mean_ndvi", F.round("mean_ndvi", 6))


@query("SELECT pixel_id, date8, round(ndvi, 6) AS ndvi FROM ndvi", NDVI)
def d1_ndvi(fx: Fixtures) -> DataFrame:
    return series.ndvi(fx.obs())


@query("SELECT pixel_id, date8, round((nir - red) / CASE WHEN nir + red = 0 THEN 1e-6 ELSE nir + red END, 6) AS ndvi FROM two", TWO)
def d1_ndvi_eps(fx: Fixtures) -> DataFrame:
    return series.ndvi(fx.obs(), "eps")


@query("SELECT pixel_id, date8, CASE WHEN red > 0 AND nir > 0 THEN round((nir - red) / (nir + red + 1e-6), 6) END AS ndvi FROM two", TWO)
def d1_ndvi_add_eps(fx: Fixtures) -> DataFrame:
    return series.ndvi(fx.obs(), "add_eps")


@query("SELECT date8, valid_frac, mean_ndvi FROM means", MEANS)
def d2_mean_ndvi_by_date(fx: Fixtures) -> DataFrame:
    return means(fx)


@query("SELECT date8 FROM means ORDER BY mean_ndvi DESC, date8 LIMIT 1", MEANS)
def d3_peak_ndvi_date(fx: Fixtures) -> DataFrame:
    return series.peak_ndvi_date(means(fx))


@query(
    """SELECT CAST(t.k AS INT) AS quarter, coalesce((SELECT date8 FROM m WHERE m.q = t.k AND v IS NOT NULL ORDER BY v DESC, date8 LIMIT 1), (SELECT date8 FROM m ORDER BY abs(CAST(substr(date8, 5, 4) AS INT) - t.mid), date8 LIMIT 1)) AS date8
    FROM (VALUES (1, 215), (2, 516), (3, 815), (4, 1115)) t(k, mid)""",
    MEANS + ", m AS (SELECT date8, CAST(ceil(CAST(substr(date8, 5, 2) AS INT) / 3) AS INT) AS q, CASE WHEN date8 <> '20241012' THEN round(mean_ndvi, 5) END AS v FROM means)",
)
def d4_quarterly_dates(fx: Fixtures) -> DataFrame:
    return series.quarterly_dates(means(fx).withColumn("mean_ndvi", F.when(F.col("date8") != "20241012", F.col("mean_ndvi"))))


@query("SELECT label, min(date8) AS date8 FROM (SELECT DISTINCT date8 FROM obs) JOIN (VALUES ('Jan', 1), ('Mar', 3), ('Jul', 7), ('Jul', 8), ('Nov', 11), ('Nov', 10)) t(label, month) ON CAST(substr(date8, 5, 2) AS INT) = month GROUP BY 1")
def d5_month_target_dates(fx: Fixtures) -> DataFrame:
    return series.month_target_dates(fx.obs())


@query("SELECT concat('D', row_number() OVER (ORDER BY date8) - 1) AS label, date8 FROM (SELECT DISTINCT date8 FROM obs WHERE substr(date8, 5, 2) IN ('05', '06', '10'))")
def d5_month_target_dates_fallback(fx: Fixtures) -> DataFrame:
    return series.month_target_dates(fx.obs().where(F.substring("date8", 5, 2).isin("05", "06", "10")))


@query("SELECT date8, round(avg(ndvi), 6) AS mean_ndvi FROM ndvi GROUP BY 1", NDVI)
def d6_ndvi_profile(fx: Fixtures) -> DataFrame:
    return series.ndvi_profile(series.ndvi(fx.obs()))


@query("SELECT cdl_id, date8, (SELECT round(avg(n.ndvi), 6) FROM ndvi n JOIN px_labels l USING (pixel_id) WHERE l.cdl_id = k.cdl_id AND n.date8 = d.date8) AS mean_ndvi FROM (VALUES (1), (3), (24), (36), (99)) k(cdl_id), (SELECT DISTINCT date8 FROM ndvi) d", NDVI)
def d7_ndvi_profile_by_class(fx: Fixtures) -> DataFrame:
    return series.ndvi_profile_by_class(series.ndvi(fx.obs()), fx.labels(), (1, 3, 24, 36, 99))


@query("SELECT date8, band, round(avg(value), 6) AS mean_value FROM obs WHERE date8 IN ('20240331', '20240729') GROUP BY 1, 2")
def d8_spectral_profile(fx: Fixtures) -> DataFrame:
    return series.spectral_profile(fx.obs(), ("20240331", "20240729"))


STATS = "stats AS (SELECT band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM obs GROUP BY 1)"


@query(
    "SELECT pixel_id, r, c, band, round(greatest(0, least(1, coalesce(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE m END, 0))), 6) AS value FROM (SELECT pixel_id, r, c, band, median(value) AS m FROM obs WHERE band IN ('B2', 'B4') AND r % 2 = 0 AND c % 2 = 0 GROUP BY 1, 2, 3, 4) JOIN stats USING (band)",
    STATS,
)
def d9_median_composite(fx: Fixtures) -> DataFrame:
    from fieldloom.operators.patches import norm_stats

    return series.median_composite(fx.obs(), norm_stats(fx.obs()), ("B2", "B4"), 2)


@query(
    "SELECT pixel_id, date8, band, CASE WHEN lo IS NULL THEN 0.0 WHEN value IS NOT NULL THEN round(greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-6))), 6) END AS value FROM obs JOIN s USING (date8, band)",
    "s AS (SELECT date8, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM obs GROUP BY 1, 2)",
)
def d10_percentile_stretch(fx: Fixtures) -> DataFrame:
    return series.percentile_stretch(fx.obs())


@query(
    "SELECT crop_id, crop_order, rank, channel FROM sel",
    "sel AS (SELECT CAST(crop_id AS INT) AS crop_id, CAST(crop_order - 1 AS INT) AS crop_order, CAST(rank AS INT) AS rank, channel FROM (SELECT crop_id, dense_rank() OVER (ORDER BY crop_id) AS crop_order, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC, channel_idx) AS rank, channel FROM (SELECT crop_id, channel, channel_idx, round(avg(value), 6) AS score FROM samp GROUP BY 1, 2, 3)) WHERE rank <= 5)",
)
def a7_a9_write_and_read_selection(fx: Fixtures) -> DataFrame:
    from fieldloom.operators.selection import select_top_k
    from fieldloom.sources.outputs import read_selection, write_selection
    from fieldloom.sources.shared import shared_folder

    path = f"{shared_folder(fx.spark)}/selection-{uuid.uuid4().hex}"
    scores = fx.crop_samples().groupBy("crop_id", "channel", "channel_idx").agg(F.round(F.avg("value"), 6).alias("score"))
    write_selection(select_top_k(scores, 7), path, {"selector": "mean", "mode": "top_k", "k": "7"})
    return read_selection(fx.spark, path, 5)

"""Raster tables derived from the driver's tables.

The SQL text is shared by Spark and by the SQL oracles, so both see the same
pixels: labels and observations from ``orders`` (a grid of 50 columns), samples
from ``embeddings``. Only integer arithmetic is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PX_LABELS = """
SELECT o_orderkey AS pixel_id,
       CAST(floor(o_orderkey / 50) AS BIGINT) AS r, CAST(o_orderkey % 50 AS BIGINT) AS c,
       CASE CAST((CASE WHEN o_custkey % 13 = 0 THEN o_custkey
                       ELSE floor(o_orderkey / 250) * 7 + floor((o_orderkey % 50) / 5) * 3 END) AS BIGINT) % 11
         WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 24 WHEN 4 THEN 36 WHEN 5 THEN 54
         WHEN 6 THEN 69 WHEN 7 THEN 75 WHEN 8 THEN 76 WHEN 9 THEN 61 ELSE 204 END AS cdl_id,
       CAST(floor(o_totalprice) AS BIGINT) % 101 AS confidence,
       o_custkey AS custkey
FROM {orders}
"""

PX_OBS = """
SELECT l.pixel_id, l.r, l.c, d.date8, b.band, b.band_idx, d.date_idx * 4 + b.band_idx AS channel_idx,
       CASE WHEN (l.pixel_id + d.date_idx * 7) % 17 = 0 THEN CAST(-9999.0 AS DOUBLE)
            ELSE CAST(200 + (l.pixel_id * 31 + d.date_idx * 977 + b.band_idx * 131) % 1500
                      + (l.cdl_id * (b.band_idx + 1) * 13 + l.cdl_id * d.date_idx * 7) % 2000 AS DOUBLE) END AS value
FROM {px_labels} l
CROSS JOIN {dates} CROSS JOIN {bands}
"""
DATES = "(VALUES (0,'20240116'),(1,'20240331'),(2,'20240515'),(3,'20240629'),(4,'20240729'),(5,'20241012')) d(date_idx, date8)"
BANDS = "(VALUES (0,'B2'),(1,'B4'),(2,'B8'),(3,'B11')) b(band_idx, band)"
PX_OBS = PX_OBS.replace("{dates}", DATES).replace("{bands}", BANDS)

# model class of each target land-cover id, in the order of the ids
REMAP = "CASE cdl_id WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 24 THEN 3 WHEN 36 THEN 4 WHEN 54 THEN 5 WHEN 69 THEN 6 WHEN 75 THEN 7 WHEN 76 THEN 8 ELSE 0 END"

PREDICTIONS = f"""
SELECT pixel_id, concat(CAST(floor(r / 5) AS BIGINT), '_', CAST(floor(c / 5) AS BIGINT)) AS patch_id, gt_class,
       CASE WHEN custkey % 5 = 0 THEN CAST((gt_class + 1 + custkey % 3) % 9 AS INT) ELSE gt_class END AS pred_class,
       CASE CAST(floor(r / 10) AS BIGINT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test_a' ELSE 'test_b' END AS area
FROM (SELECT pixel_id, r, c, custkey, {REMAP} AS gt_class FROM {{px_labels}}) t
"""

SCENE_FILES = """
SELECT o_orderkey AS file_id,
       concat(CASE o_orderkey % 3 WHEN 0 THEN '/s2/' WHEN 1 THEN concat('/s2/', year(o_orderdate), '/') ELSE concat('/', year(o_orderdate), '/s2/') END,
              CASE WHEN o_orderkey % 11 = 0 THEN '._' ELSE '' END,
              CASE WHEN o_orderkey % 13 = 0 THEN 'readme' ELSE
              concat('S2H_', year(o_orderdate), '_', {ymd}, CASE WHEN o_custkey % 2 = 0 THEN '_processed' ELSE '' END) END, '.tif') AS path,
       CAST(o_custkey % 7 AS BIGINT) * 1000 AS length
FROM {orders}
"""

AREAS = """
SELECT CASE CAST(floor(r / 10) AS BIGINT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test_a' ELSE 'test_b' END AS area, pixel_id, band, value
FROM {px_obs} WHERE date8 = '20240629'
"""

YMD = {"spark": "date_format(o_orderdate, 'yyyy_MM_dd')", "duckdb": "strftime(o_orderdate, '%Y_%m_%d')"}


class Fixtures:
    """DataFrames over one ``sf_dir``; clean observations have NULL for what is missing."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def labels(self) -> DataFrame:
        made = self.spark.sql(PX_LABELS, orders=self.table("orders"))
        # the generator keeps the optimizer from copying the long formula into every use of the label
        return made.withColumn("cdl_id", F.explode(F.array("cdl_id")))

    def raw_obs(self) -> DataFrame:
        made = self.spark.sql(PX_OBS, px_labels=self.labels())
        return made.withColumn("value", F.explode(F.array("value")))

    def obs(self) -> DataFrame:
        from fieldloom.operators.cleaning import to_null

        return to_null(self.raw_obs())

    def channels(self) -> DataFrame:
        """The catalogue of the observations' dates and bands; no pixel is read for it."""
        return self.spark.sql(f"SELECT concat(band, '_', date8) AS channel, date_idx * 4 + band_idx AS channel_idx FROM {DATES} CROSS JOIN {BANDS}")

    def dates(self) -> list[str]:
        """All dates of the observations, from their catalogue."""
        return sorted(r[0] for r in self.spark.sql(f"SELECT date8 FROM {DATES}").collect())

    def second_year(self) -> DataFrame:
        shifted = F.date_format(F.date_add(F.to_date("date8", "yyyyMMdd"), 3 - 366), "yyyyMMdd")
        return self.obs().withColumn("date8", shifted)

    def crop_samples(self) -> DataFrame:
        """Long table of every target-class pixel and channel."""
        from fieldloom.operators.cleaning import KEEP_CLASSES

        crops = self.labels().where(F.col("cdl_id").isin(*KEEP_CLASSES)).select("pixel_id", F.col("cdl_id").cast("int").alias("crop_id"))
        return self.obs().join(crops, "pixel_id").select("pixel_id", "crop_id", F.concat_ws("_", "band", "date8").alias("channel"), "channel_idx", "band", "date8", "value")

    def vectors(self) -> DataFrame:
        """Samples from ``embeddings``: labels 0 to 7 are the classes in order, others background; 24 channels."""
        ids = F.array(*(F.lit(k) for k in (1, 3, 24, 36, 54, 69, 75, 76)))
        return self.table("embeddings").select(F.col("vec_id").alias("pixel_id"), F.when(F.col("label") < 8, ids[F.col("label")]).otherwise(0).alias("class_label"), F.transform(F.slice("embedding", 1, 24), lambda x: x.cast("double")).alias("features"))

    def predictions(self) -> DataFrame:
        return self.spark.sql(PREDICTIONS, px_labels=self.labels())

    def scene_files(self) -> DataFrame:
        return self.spark.sql(SCENE_FILES.replace("{ymd}", YMD["spark"]), orders=self.table("orders"))

    def areas(self) -> DataFrame:
        return self.spark.sql(AREAS, px_obs=self.obs())


def base_sql() -> str:
    """The same tables as common table expressions, for the oracles. ``obs`` is cleaned, ``samp`` long."""
    labels = PX_LABELS.format(orders="orders")
    raw = PX_OBS.format(px_labels="px_labels")
    return f"""px_labels AS ({labels}), raw_obs AS ({raw}),
obs AS (SELECT pixel_id, r, c, date8, band, band_idx, channel_idx, concat(band, '_', date8) AS channel, CASE WHEN value >= 0 THEN value END AS value FROM raw_obs),
obs2 AS (SELECT pixel_id, r, c, strftime(strptime(date8, '%Y%m%d') - INTERVAL 363 DAY, '%Y%m%d') AS date8, band, band_idx, channel_idx, value FROM obs),
lab AS (SELECT pixel_id, r, c, cdl_id, confidence, custkey, {REMAP} AS model_id FROM px_labels),
samp AS (SELECT o.*, l.cdl_id AS crop_id FROM obs o JOIN lab l USING (pixel_id) WHERE l.model_id > 0),
predictions AS ({PREDICTIONS.format(px_labels="px_labels")}),
scene_files AS ({SCENE_FILES.replace("{ymd}", YMD["duckdb"]).format(orders="orders")}),
areas AS ({AREAS.format(px_obs="obs")})"""


def oracle(body: str, ctes: str = "") -> str:
    """``body`` over the shared tables; ``ctes`` are further ones."""
    return f"WITH RECURSIVE {base_sql()}{', ' + ctes if ctes else ''} {body}"

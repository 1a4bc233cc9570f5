"""Scenes, dates and channels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The scene file name, the four TIFF signatures
SCENE_NAME = r"^S2H_(\d{4})_(\d{4}_\d{2}_\d{2})(_processed)?\.tif$"
DRIFT_NAME = r"_(\d{8})[_.]"
MAGIC = ("49492A00", "4D4D002A", "49492B00", "4D4D002B")


def parse_scene_name(files: DataFrame, column: str = "path", fallback: str = "null") -> DataFrame:
    """Adds ``product_year int, date8, acq_date, processed`` from the file name.

    A name that doesn't match has no year; its date is null, or with
    ``fallback='prefix'`` the first eight characters, or with ``'drift'`` the
    first eight digits between an underscore and an underscore or dot.
    """
    name = F.element_at(F.split(column, "/"), -1)
    part = [F.nullif(F.regexp_extract(name, SCENE_NAME, i), F.lit("")) for i in (1, 2, 3)]
    other = {"null": F.lit(None).cast("string"), "prefix": F.substring(name, 1, 8), "drift": F.nullif(F.regexp_extract(name, DRIFT_NAME, 1), F.lit(""))}[fallback]
    date8 = F.coalesce(F.replace(part[1], F.lit("_"), F.lit("")), other)
    return files.withColumns({"product_year": part[0].cast("int"), "date8": date8, "acq_date": F.try_to_date(date8, "yyyyMMdd"), "processed": part[2].isNotNull()})


def list_files(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """``path, length`` of all files below ``path``; contents aren't read. Files without bytes are passed over, as Spark's readers do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def scene_catalog(files: DataFrame, years: Iterable[int] | None = None) -> DataFrame:
    """Scenes among ``files``: hidden copies (``._*``) dropped, paths once (at their greatest length), years filtered."""
    named = files.where(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    out = parse_scene_name(named.groupBy("path").agg(F.max("length").alias("length"))).where(F.col("product_year").isNotNull())
    return out.where(F.col("product_year").isin(*years)) if years is not None else out


def dates_by_year(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("product_year").agg(F.sort_array(F.collect_set("date8")).alias("dates"))


def verify_inventory(catalog: DataFrame, years: Iterable[int]) -> DataFrame:
    """``product_year, status, n_files, total_bytes``: OK or MISSING for every expected year."""
    want = catalog.sparkSession.createDataFrame([(y,) for y in years], "product_year int")
    have = catalog.groupBy("product_year").agg(F.count("*").alias("n_files"), F.sum("length").alias("total_bytes"))
    return want.join(have, "product_year", "left").select("product_year", F.when(F.col("n_files") > 0, "OK").otherwise("MISSING").alias("status"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def pending_scenes(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Dates present raw but not processed; a processed file of no bytes counts as absent."""
    return raw.select("date8").distinct().join(processed.where("length > 0").select("date8"), "date8", "left_anti")


def check_magic(binary: DataFrame) -> DataFrame:
    """Adds ``magic`` (hexadecimal) and ``ok`` from ``content``."""
    return binary.withColumn("magic", F.hex(F.substring("content", 1, 4))).withColumn("ok", F.col("magic").isin(*MAGIC))


def scan_tiles(obs: DataFrame, height: int, width: int, tile: int = 256) -> DataFrame:
    """Pixels found and expected in every tile of every scene and band; edge tiles are clipped."""
    rows, cols = -(-height // tile), -(-width // tile)
    found = obs.where(F.col("value").isNotNull()).groupBy("date8", "band", F.floor(F.col("r") / tile).alias("tile_r"), F.floor(F.col("c") / tile).alias("tile_c")).agg(F.count("*").alias("n_found"))
    grid = obs.select("date8", "band").distinct().withColumn("tile_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))).withColumn("tile_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    expected = (F.least(F.lit(tile), F.lit(height) - F.col("tile_r") * tile) * F.least(F.lit(tile), F.lit(width) - F.col("tile_c") * tile)).cast("long")
    return grid.join(found, ["date8", "band", "tile_r", "tile_c"], "left").withColumn("n_found", F.coalesce("n_found", F.lit(0).cast("long"))).withColumn("n_expected", expected)


def scan_summary(tiles: DataFrame) -> DataFrame:
    ok = F.col("n_found") == F.col("n_expected")
    out = tiles.groupBy("date8").agg(F.count("*").alias("n_tiles"), F.sum(ok.cast("long")).alias("n_ok"))
    return out.withColumn("status", F.when(F.col("n_ok") == F.col("n_tiles"), "OK").otherwise("FAIL"))


def check_alignment(grids: DataFrame, label_grid: DataFrame) -> DataFrame:
    """Adds ``aligned``: width, height and crs equal those of the labels of the same year, nulls included."""
    other = label_grid.select("year", *(F.col(c).alias(f"_{c}") for c in ("width", "height", "crs")))
    same = F.col("width").eqNullSafe(F.col("_width")) & F.col("height").eqNullSafe(F.col("_height")) & F.col("crs").eqNullSafe(F.col("_crs"))
    return grids.join(other, "year", "left").withColumn("aligned", same).drop("_width", "_height", "_crs")


def build_channels(scenes: DataFrame, bands: list[str]) -> DataFrame:
    """Every band of every scene in order: scene by date, band as listed. A few hundred rows."""
    scenes = scenes.select("date8").distinct().withColumn("scene_idx", (F.row_number().over(Window.orderBy("date8")) - 1).cast("int"))
    listed = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(i).alias("band_idx")) for i, b in enumerate(bands))))
    out = scenes.withColumn("_b", listed).select("date8", "scene_idx", "_b.band", "_b.band_idx")
    return out.select(F.concat_ws("_", "band", "date8").alias("channel"), "band", "date8", F.substring("date8", 5, 4).alias("mmdd"), F.substring("date8", 1, 4).cast("int").alias("year"), "scene_idx", "band_idx", (F.col("scene_idx") * len(bands) + F.col("band_idx")).alias("channel_idx"))


def local_band_map(scenes: DataFrame) -> DataFrame:
    """``mmdd, date8, scene_idx`` of the year with the most scenes (ties: the earliest)."""
    dated = scenes.select("date8").distinct().withColumn("year", F.substring("date8", 1, 4).cast("int"))
    best = dated.groupBy("year").count().orderBy(F.desc("count"), "year").limit(1).select("year")
    own = dated.join(F.broadcast(best), "year")  # one row
    return own.select(F.substring("date8", 5, 4).alias("mmdd"), "date8", (F.row_number().over(Window.orderBy("date8")) - 1).alias("scene_idx"))

"""Cleaning, filtering and refining of observations and label rasters.

Missing values are NULL from :func:`to_null` on. Label rasters are tables with
``pixel_id, r, c, cdl_id``; 0 is background or no data, 255 unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import tiles

# Target land-cover ids in model order, their names, and ids that aren't crops
KEEP_CLASSES = (1, 3, 24, 36, 54, 69, 75, 76)
CLASS_NAMES = {1: "Corn", 3: "Rice", 24: "Winter Wheat", 36: "Alfalfa", 54: "Tomatoes", 69: "Grapes", 75: "Almonds", 76: "Walnuts"}
NON_CROP = (0, 61, 63, 64, 65, 81, 82, 83, 87, 88, 92, 111, 112, 121, 122, 123, 124, 131, 141, 142, 143, 152, 176, 190, 195)
NODATA = -9999.0
UNKNOWN = 255
MIN_CONFIDENCE = 55
WIDEST_HALO = 255  # pixels; such a tile has 1.6 million
HALO_SHARE = 3


LARGEST = 1.7976931348623157e308  # NaN and infinity order above it


def _valid(value: Column) -> Column:
    return value.between(0.0, LARGEST)


def assign_nodata(obs: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Negative, NaN, infinite and null values become ``nodata``."""
    v = F.col("value")
    return obs.withColumn("value", F.when(_valid(v), v).otherwise(F.lit(nodata)))


def invalid_counts(obs: DataFrame, keys: Iterable[str] = ("date8",)) -> DataFrame:
    bad = ~F.coalesce(_valid(F.col("value")), F.lit(False))
    return obs.groupBy(*keys).agg(F.sum(bad.cast("long")).alias("n_invalid"), F.count("*").alias("n_total"))


def to_null(obs: DataFrame) -> DataFrame:
    v = F.col("value")
    return obs.withColumn("value", F.when(_valid(v), v))


def has_valid_data(obs: DataFrame, height: int, width: int, size: int = 1024, min_frac: float = 0.01) -> DataFrame:
    """Per scene: the share of pixels of the centre window all of whose bands are above 0, and whether it suffices."""
    r0, c0 = max(0, (height - size) // 2), max(0, (width - size) // 2)
    inside = obs.where((F.col("r") >= r0) & (F.col("r") < r0 + size) & (F.col("c") >= c0) & (F.col("c") < c0 + size))
    pixels = inside.groupBy("date8", "pixel_id").agg(F.every(F.coalesce(F.col("value") > 0, F.lit(False))).alias("ok"))
    return pixels.groupBy("date8").agg(F.avg(F.col("ok").cast("double")).alias("valid_frac")).withColumn("keep", F.col("valid_frac") >= min_frac)


def probe_windows(height: int, width: int, most: int = 512) -> list[tuple[int, int, int]]:
    """Top-left corners and side of the 3 x 3 windows spread over a scene."""
    side = max(1, min(most, width // 4, height // 4))
    return [((height - side) * i // 2, (width - side) * j // 2, side) for i in range(3) for j in range(3)]


def valid_fraction(obs: DataFrame, height: int | None = None, width: int | None = None, bands: Iterable[str] | None = None) -> DataFrame:
    """Valid share by scene: exact over all pixels, or over probe windows where the grid is given.

    The nine windows are few and fixed, so they are a filter on the scan; a
    pixel counts once for each window that holds it.
    """
    if bands is not None:
        obs = obs.where(F.col("band").isin(*bands))
    weight = F.lit(1)
    if height is not None:
        hits = [((F.col("r") >= r) & (F.col("r") < r + s) & (F.col("c") >= c) & (F.col("c") < c + s)).cast("int") for r, c, s in probe_windows(height, width)]
        weight = sum(hits[1:], hits[0])
    w = obs.withColumn("_w", weight).where("_w > 0")
    return w.groupBy("date8").agg((F.sum(F.when(F.col("value").isNotNull(), F.col("_w")).otherwise(0)) / F.sum("_w")).alias("valid_frac"))


def filter_valid_dates(fractions: DataFrame, dates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``date8, valid_frac, kept``; a date without a fraction is unreadable and counts as 0."""
    return dates.join(fractions, "date8", "left").select("date8", F.coalesce("valid_frac", F.lit(0.0)).alias("valid_frac")).withColumn("kept", F.col("valid_frac") >= threshold)


def keep_valid(obs: DataFrame, checked: DataFrame) -> DataFrame:
    return obs.join(checked.where("kept").select("date8"), "date8", "left_semi")


def coverage_by_date(raw: DataFrame, band: str, line: float = 70.0) -> DataFrame:
    """Share in percent of one band's values that aren't the no-data value (NaN counts as data)."""
    share = 100 * F.avg((F.col("value") != NODATA).cast("double"))
    return raw.where(F.col("band") == band).groupBy("date8").agg(share.alias("valid_pct")).withColumn("above_line", F.col("valid_pct") >= line)


def filter_labels(labels: DataFrame, keep: Iterable[int] = KEEP_CLASSES, nodata: int = 0) -> DataFrame:
    return labels.withColumn("cdl_id", F.when(F.col("cdl_id").isin(*keep), F.col("cdl_id")).otherwise(nodata).cast("int"))


def remap_labels(labels: DataFrame, keep: Iterable[int] = KEEP_CLASSES) -> DataFrame:
    """Adds ``model_id``: 1.. for the kept ids in order, 0 for all else, after clipping to 0..255."""
    pairs = F.create_map(*(F.lit(x) for i, k in enumerate(keep) for x in (k, i + 1)))
    clipped = F.least(F.greatest(F.col("cdl_id"), F.lit(0)), F.lit(255)).cast("int")
    return labels.withColumn("model_id", F.coalesce(pairs[clipped], F.lit(0)))


def collapse_non_crop(labels: DataFrame) -> DataFrame:
    return labels.withColumn("cdl_id", F.when(F.col("cdl_id").isin(*NON_CROP), 0).otherwise(F.col("cdl_id")).cast("int"))


def with_class_names(df: DataFrame, column: str = "cdl_id") -> DataFrame:
    names = F.create_map(*(F.lit(x) for k, v in CLASS_NAMES.items() for x in (k, v)))
    return df.withColumn("class_name", F.coalesce(names[F.col(column).cast("int")], F.when(F.col(column) == 0, "Background").otherwise(F.concat(F.lit("Class "), F.col(column)))))


def confidence_mask(labels: DataFrame, threshold: int = MIN_CONFIDENCE, unknown: int = UNKNOWN) -> DataFrame:
    """Pixels of lower confidence become unknown, background too. A null confidence is kept."""
    return labels.withColumn("cdl_id", F.when(F.col("confidence") < threshold, unknown).otherwise(F.col("cdl_id")).cast("int"))


def resample_labels(src: DataFrame, dst: DataFrame, step: float, row0: float = 0.0, col0: float = 0.0) -> DataFrame:
    """Nearest-neighbour lookup: each target pixel centre falls into a source row and column; outside is 0.

    ``step`` is the target pixel's side in source pixels; ``row0`` and ``col0``
    are the target's corner in source pixels. Only source rows and columns
    under the target are read.
    """
    sr = F.floor((F.col("r") + 0.5) * step + row0).cast("long")
    sc = F.floor((F.col("c") + 0.5) * step + col0).cast("long")
    return _looked_up(src, dst, sr, sc)


def _looked_up(src: DataFrame, dst: DataFrame, row: Column, col: Column) -> DataFrame:
    """``src`` at ``row, col`` of each pixel of ``dst``, outside 0.

    The bounds of the source come from the target's outermost pixels, whose
    places enclose all others' in any continuous projection, and are a filter on the source's scan.
    """
    ends = dst.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    edge = F.col("r").isin(ends["r0"], ends["r1"]) | F.col("c").isin(ends["c0"], ends["c1"])
    low_r, high_r, low_c, high_c = dst.where(edge).agg(F.min(row), F.max(row), F.min(col), F.max(col)).first() if ends["r0"] is not None else (0, -1, 0, -1)
    under = src.where(F.col("r").between(low_r - 1, high_r + 1) & F.col("c").between(low_c - 1, high_c + 1))
    source = under.select(F.col("r").alias("_r"), F.col("c").alias("_c"), "cdl_id")
    at = dst.select("pixel_id", "r", "c", row.alias("_r"), col.alias("_c"))
    return at.join(source, ["_r", "_c"], "left").select("pixel_id", "r", "c", F.coalesce("cdl_id", F.lit(0)).cast("int").alias("cdl_id"))


def resample_albers(src: DataFrame, dst: DataFrame, lon: Column, lat: Column, affine: tuple[float, float, float, float]) -> DataFrame:
    """As :func:`resample_labels`, where ``lon`` and ``lat`` of a target pixel's centre are in degrees and the source is in the
    equal-area grid of :func:`albers_row_col`.
    """
    row, col = albers_row_col(lon, lat, affine)
    return _looked_up(src, dst, row, col)


def albers_row_col(lon: Column, lat: Column, affine: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Source row and column of a point in degrees, in the equal-area conic grid of the contiguous United States.

    ``affine`` is (x of the left edge, pixel width, y of the top edge, pixel
    height). Parallels 29.5 and 45.5, origin 23 N 96 W, GRS80, as EPSG:5070 says.
    """
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_of(s, log, one):
        return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e) * one)

    def number(deg: float) -> float:
        return q_of(math.sin(math.radians(deg)), math.log, 1)

    def m(deg: float) -> float:
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) / math.sqrt(1 - e2 * s * s)

    n = (m(29.5) ** 2 - m(45.5) ** 2) / (number(45.5) - number(29.5))
    c = m(29.5) ** 2 + n * number(29.5)
    rho0 = a * math.sqrt(c - n * number(23.0)) / n
    rho = a * F.sqrt(c - n * q_of(F.sin(F.radians(lat)), F.log, 1)) / n
    theta = n * F.radians(lon + 96.0)
    x, y = rho * F.sin(theta), rho0 - rho * F.cos(theta)
    left, dx, top, dy = affine
    return F.floor((top - y) / dy).cast("long"), F.floor((x - left) / dx).cast("long")


def majority_filter(labels: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent class of the k x k window within the raster; ties go to the least class."""
    half = k // 2
    return tiles.per_tile(labels, labels.columns, tiles.side_for(half), half, {"cdl_id": "int"}, lambda t: {"cdl_id": tiles.as_class(t.of(tiles.majority(t.square, half)))})


def eroded_mask(labels: DataFrame, iterations: int = 1) -> DataFrame:
    """``labels`` plus ``inner``: whether the pixel is left of its class's mask after some rounds of 4-neighbour erosion.

    That is, whether no pixel of another class, and none outside the raster, is
    as many steps away or fewer; so any number of rounds is one pass.
    """
    work = lambda t: {"inner": t.of(tiles.distance(t.square)) > iterations}
    return tiles.per_tile(labels, labels.columns, tiles.side_for(iterations), iterations, {"inner": "boolean"}, work)


def erode_boundaries(labels: DataFrame, iterations: int = 1, unknown: int = UNKNOWN) -> DataFrame:
    """The outer ring of every class, background included, becomes unknown; outside the raster is no class."""
    return eroded_mask(labels, iterations).withColumn("cdl_id", F.when(F.col("inner"), F.col("cdl_id")).otherwise(unknown).cast("int")).select(*labels.columns)


def _small(min_size: int) -> Callable[[np.ndarray], np.ndarray]:
    """Where a square's pixels are of small components.

    Sound for pixels at least ``min_size - 1`` steps from the square's edge: a component that reaches the edge from
    there has ``min_size`` pixels on its way.
    """
    return lambda square: tiles.sizes(tiles.labelled(square)) < min_size


def small_components(mask: DataFrame, min_size: int = 4) -> DataFrame:
    """``r, c`` of the pixels of 4-connected one-class components of fewer than ``min_size``, from ``r, c, cdl_id``.

    Up to ``WIDEST_HALO`` a halo of that many pixels decides it for one
    exchange; for greater sizes the components are labelled over all tiles.
    """
    if min_size - 1 > WIDEST_HALO:
        return tiles.components(mask, least=min_size).where(F.col("size") < min_size).select("r", "c")
    halo = max(0, min_size - 1)
    small = _small(min_size)
    found = tiles.per_tile(mask, ["r", "c"], tiles.side_for(halo, HALO_SHARE), halo, {"_small": "boolean"}, lambda t: {"_small": t.of(small(t.square))})
    return found.where("_small").select("r", "c")


def drop_small_components(labels: DataFrame, min_size: int = 4, iterations: int = 1, unknown: int = UNKNOWN) -> DataFrame:
    """Erosion, then small components of what is left become unknown too; both in one look at the tiles where a halo is enough."""
    if min_size - 1 > WIDEST_HALO:
        inner = eroded_mask(labels, iterations)
        small = small_components(inner.where("inner"), min_size).withColumn("_small", F.lit(True))
        kept = inner.join(small, ["r", "c"], "left").withColumn("_kept", F.col("inner") & F.col("_small").isNull())
    else:
        halo, small = iterations + max(0, min_size - 1), _small(min_size)

        def work(tile: tiles.Tile) -> dict:
            left = np.where(tiles.distance(tile.square) > iterations, tile.square, tiles.ABSENT)
            return {"_kept": tile.of((left != tiles.ABSENT) & ~small(left))}

        kept = tiles.per_tile(labels, labels.columns, tiles.side_for(halo, HALO_SHARE), halo, {"_kept": "boolean"}, work)
    return kept.withColumn("cdl_id", F.when(F.col("_kept"), F.col("cdl_id")).otherwise(unknown).cast("int")).select(*labels.columns)


def process_labels(labels: DataFrame, legacy: bool = False, majority: int = 3, erode: int = 1, min_size: int = 4) -> DataFrame:
    """Native 10 m labels: keep target classes, mask low confidence. Legacy 30 m ones: also majority, then erosion."""
    out = confidence_mask(filter_labels(labels))
    return drop_small_components(majority_filter(out, majority), min_size, erode) if legacy else out


def refine_labels(labels: DataFrame, erode: int = 0, majority: int = 0) -> DataFrame:
    """Erosion, then majority; at least one of them."""
    if not erode and not majority:
        raise ValueError("refine_labels needs erode or majority")
    out = erode_boundaries(labels, erode) if erode else labels
    return majority_filter(out, majority) if majority else out


def overviews(obs: DataFrame, factors: Iterable[int] = (4, 8, 16, 32)) -> DataFrame:
    """Averages over f x f cells, missing values left out. One scan emits a row per factor."""
    f = obs.withColumn("factor", F.explode(F.array(*(F.lit(x) for x in factors))))
    cell = [F.floor(F.col(x) / F.col("factor")).cast("long").alias(x) for x in ("r", "c")]
    return f.groupBy("factor", "date8", "band", *cell).agg(F.avg("value").alias("value"))


def downsample(df: DataFrame, n: int) -> DataFrame:
    return df.where((F.col("r") % n == 0) & (F.col("c") % n == 0))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

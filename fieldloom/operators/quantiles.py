"""Percentiles of groups of any size: exact ones by counting, and stored sketches that merge.

Spark's own ``percentile`` gathers the distinct values of a group in one task.
Here a group is only ever counted: the values between two bounds fall into
equal cells, cells are partial sums, and the cell that holds the wanted place
gives the next bounds, until they hold one value.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.shared import materialise

CELLS = 4096
ROUNDS = 12
SKETCH_K = 200


def _same(a: DataFrame, b: DataFrame, groups: list[str]) -> Column:
    return functools.reduce(operator.and_, (a[g].eqNullSafe(b[g]) for g in groups))


def exact_percentiles(df: DataFrame, groups: Iterable[str], value: str, shares: dict[str, float], cells: int = CELLS) -> DataFrame:
    """``groups`` and a column for each of ``shares`` (name to 0..1): bit for bit what ``percentile`` gives.

    Nulls don't count; a group without values has null. Each round reads the
    values once and narrows a group's bounds to the least and greatest value of
    one of ``cells`` cells; values that are spread at all evenly settle in two
    or three. What hasn't settled after ``ROUNDS`` (values over hundreds of powers of ten) is ordered,
    no more than the values between the last bounds.
    """
    groups = list(groups)
    v = F.col(value).cast("double")
    some = df.select(*groups, v.alias("_v")).where("_v is not null")
    whole = some.groupBy(*groups).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for k, p in shares.items() for up in (False, True))))
    at = F.col("p") * (F.col("n") - 1)
    # the two neighbours of each share's place, as numbers of values before them
    bounds = whole.withColumn("_s", places).select(*groups, "_s.name", "_s.p", "_s.up", "lo", "hi", "n")
    bounds = materialise(bounds.select(*groups, "name", "up", at.alias("at"), F.when(F.col("up"), F.ceil(at)).otherwise(F.floor(at)).cast("long").alias("before"), "lo", "hi"))
    settled = bounds.where("lo = hi")
    bounds = bounds.where("lo < hi")
    for _ in range(ROUNDS):
        if bounds.isEmpty():
            break
        # few rows: groups times places; values outside their bounds go before anything is shuffled
        wanted = bounds.select(*groups, F.struct("name", "up", "lo", "hi").alias("_b")).groupBy(*groups).agg(F.collect_list("_b").alias("_bs"))
        met = some.join(wanted, _same(some, wanted, groups)) if groups else some.join(F.broadcast(wanted), F.lit(True))  # one row
        inside = F.filter("_bs", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
        rows = met.select(*(some[g] for g in groups), "_v", F.explode(inside).alias("_b"))
        share = (F.col("_v") / 2 - F.col("_b.lo") / 2) / (F.col("_b.hi") / 2 - F.col("_b.lo") / 2)  # halves, so that no difference overflows
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        counts = rows.groupBy(*groups, F.col("_b.name").alias("name"), F.col("_b.up").alias("up"), cell.alias("cell")).agg(F.count("*").alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = Window.partitionBy(*groups, "name", "up").orderBy("cell")  # as many rows as cells
        counts = counts.withColumn("below", F.sum("k").over(w) - F.col("k"))
        old = bounds.select(*groups, "name", "up", "at", "before")
        found = counts.join(old, _same(counts, old, [*groups, "name", "up"])).where((F.col("below") <= F.col("before")) & (F.col("before") < F.col("below") + F.col("k")))
        found = materialise(found.select(*(counts[g] for g in (*groups, "name", "up")), "at", (F.col("before") - F.col("below")).alias("before"), "lo", "hi"))
        settled = settled.unionByName(found.where("lo = hi"))
        bounds = found.where("lo < hi")
    else:
        met = some.join(bounds, _same(some, bounds, groups) if groups else F.lit(True)).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        keys = [*(some[g] for g in groups), "name", "up", "at", "before"]
        last = met.select(*keys, "_v").groupBy(*groups, "name", "up", "at", "before").agg(F.sort_array(F.collect_list("_v")).alias("_a"))
        value_at = F.get("_a", F.col("before").cast("int"))
        settled = settled.unionByName(last.select(*groups, "name", "up", "at", "before", value_at.alias("lo"), value_at.alias("hi")))
    low, high = (F.max(F.when(F.col("up") == up, F.col("lo"))).alias(x) for x, up in (("_l", False), ("_h", True)))
    ends = settled.groupBy(*groups, "name").agg(low, high, F.first("at").alias("at"))
    part = (F.ceil("at") - F.col("at")) * F.col("_l") + (F.col("at") - F.floor("at")) * F.col("_h")
    values = ends.select(*groups, "name", F.when(F.floor("at") == F.ceil("at"), F.col("_l")).otherwise(F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(part)).alias("_x"))
    wide = values.groupBy(*groups).agg(*(F.max(F.when(F.col("name") == k, F.col("_x"))).alias(k) for k in shares))
    if not groups:
        return df.sparkSession.range(1).join(wide, F.lit(True), "left").select(*shares)
    every = df.select(*groups).distinct()
    return every.join(wide, _same(every, wide, groups), "left").select(*(every[g] for g in groups), *shares)


def sketch_table(df: DataFrame, groups: Iterable[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``groups, n, sketch``: a KLL sketch of each group's values, to be written once and merged later.

    A sketch takes some kilobytes whatever the group's size; its rank error is
    below 1.65 / k ** 0.9 or so of the values with 99 % confidence (1.4 % for 200).
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*groups).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, groups: Iterable[str], shares: dict[str, float]) -> DataFrame:
    """``groups, n`` and a column for each of ``shares`` from stored sketches, merged over what isn't in ``groups``.

    So the percentiles of any dates or areas come from the table alone, and a
    new scene adds its own sketches without the others being read again.
    """
    merged = sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_k"))
    return merged.select(*groups, "n", *(F.kll_sketch_get_quantile_double("_k", F.lit(float(p))).alias(name) for name, p in shares.items()))

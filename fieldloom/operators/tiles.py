"""Rasters in tiles: neighbourhoods of any reach for one exchange of the pixels.

A pixel goes to its own tile and to those tiles whose border it lies next to, by
no more than a halo; so a task sees a square of known size, whatever the raster.
What needs more than a halo (whole components) is found in each tile and put
together by the pixels along the tiles' edges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.shared import materialise

SIDE = 256
ABSENT = np.iinfo(np.int64).min  # no pixel there
NONE = ABSENT + 1  # a null class; it comes before all others


def side_for(halo: int, share: int = 24) -> int:
    """A tile's side, at which its halo adds about ``2 / share`` to the pixels."""
    return max(SIDE, share * halo)


def dealt(pixels: DataFrame, side: int, halo: int = 0) -> DataFrame:
    """``pixels`` (with ``r, c``) plus ``_tr, _tc``: a row for each tile that a pixel lies in or next to."""
    def span(x: str):
        at = lambda d: F.floor((F.col(x) + d) / side)
        return F.explode(F.sequence(at(-halo), at(halo))) if halo else at(0)

    return pixels.withColumn("_tr", span("r")).withColumn("_tc", span("c"))


class Tile:
    """A tile's pixels with their halo as a square array of ``column``."""

    def __init__(self, key: tuple, table: pa.Table, side: int, halo: int, column: str):
        self.side, self.halo = side, halo
        top, left = (int(k.as_py()) * side - halo for k in key)
        self.r, self.c = table.column("r").to_numpy() - top, table.column("c").to_numpy() - left
        self.own = (np.minimum(self.r, self.c) >= halo) & (np.maximum(self.r, self.c) < halo + side)
        self.corner = (top, left)
        self.square = np.full((side + 2 * halo,) * 2, ABSENT, np.int64)
        self.square[self.r, self.c] = table.column(column).cast(pa.int64()).fill_null(NONE).to_numpy()

    def of(self, square: np.ndarray) -> np.ndarray:
        """The values of a whole square at the tile's own pixels."""
        return square[self.r[self.own], self.c[self.own]]


def per_tile(pixels: DataFrame, columns: list[str], side: int, halo: int, made: dict[str, str], work: Callable[[Tile], dict[str, np.ndarray | pa.Array]], column: str = "cdl_id") -> DataFrame:
    """``columns`` of ``pixels`` and what ``work`` makes of a tile's own pixels, by name and type."""
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}
    kept = [c for c in columns if c not in made]
    names = [*columns, *(n for n in made if n not in columns)]
    schema = ", ".join(f"`{n}` {made.get(n) or kinds[n]}" for n in names)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = Tile(key, table, side, halo, column)
        values = work(tile)
        own = table.filter(pa.array(tile.own))
        return pa.table({n: own.column(n) if n in kept else pa.array(values[n]) for n in names})

    inputs = list(dict.fromkeys([*kept, "r", "c", column]))
    return dealt(pixels.select(*inputs), side, halo).groupBy("_tr", "_tc").applyInArrow(run, schema)


def as_class(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NONE).cast(pa.int32())


def majority(square: np.ndarray, half: int) -> np.ndarray:
    """The most frequent value within ``half`` in each direction, the least one at ties.

    The windows' counts come from running sums, class by class, so they cost the same for any window.
    """
    size, k = len(square) - 2 * half, 2 * half + 1
    best, most = np.full(square.shape, ABSENT), np.zeros((size, size), np.int64)
    inner = best[half : half + size, half : half + size]
    for cls in np.unique(square[square != ABSENT]):  # rising
        sums = np.zeros((len(square) + 1,) * 2, np.int64)
        np.cumsum(np.cumsum(square == cls, axis=0), axis=1, out=sums[1:, 1:])
        n = sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]
        better = n > most
        most[better], inner[better] = n[better], cls
    return best


def distance(square: np.ndarray) -> np.ndarray:
    """City-block distance of each pixel to the nearest one of another value; beyond the square all values are taken for equal.

    Along rows, the distance to the ends of the pixel's run; then down and up
    the columns, where a neighbour of the same value passes its own on.
    """
    n = len(square)
    far = 4 * n
    at = np.arange(n)[None, :]
    starts = np.zeros(square.shape, bool)
    starts[:, 1:] = square[:, 1:] != square[:, :-1]
    left = at - np.maximum.accumulate(np.where(starts, at, -far), axis=1) + 1
    ends = np.zeros(square.shape, bool)
    ends[:, :-1] = starts[:, 1:]
    right = np.minimum.accumulate(np.where(ends, at, n + far)[:, ::-1], axis=1)[:, ::-1] - at + 1
    out = np.minimum(left, right)
    for rows in (range(1, n), range(n - 2, -1, -1)):
        step = 1 if rows.step > 0 else -1
        for i in rows:
            passed = np.where(square[i] == square[i - step], out[i - step] + 1, 1)
            np.minimum(out[i], passed, out=out[i])
    return out


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` members' component by the links ``i, j``."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (root := root[root])).any():
            pass
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def labelled(square: np.ndarray) -> np.ndarray:
    """For each pixel the first pixel, row by row, of its 4-connected component of one value; -1 where there is none."""
    index = np.arange(square.size).reshape(square.shape)
    there = square != ABSENT
    across = (square[:, 1:] == square[:, :-1]) & there[:, 1:]
    down = (square[1:] == square[:-1]) & there[1:]
    root = joined(square.size, np.concatenate([index[:, :-1][across], index[:-1][down]]), np.concatenate([index[:, 1:][across], index[1:][down]]))
    return np.where(there, root.reshape(square.shape), -1)


def sizes(labels: np.ndarray) -> np.ndarray:
    """The pixels of each pixel's component within the square; 0 where there is none."""
    counts = np.bincount(labels[labels >= 0], minlength=labels.size)
    return np.where(labels >= 0, counts[labels], 0)


def connected(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``; a root for each connected component.

    A round hangs each root on the least root beside it, follows the pointers
    until none is longer than one, and moves the edges to the roots. Edges fall
    by half a round or more, as every root but those least among their
    neighbours goes; the order is hashed, so long rows of ids are no chains.
    """
    low, high = (f(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n")), F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))) for f in (F.least, F.greatest))
    edges = materialise(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct())
    found = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        if edges.isEmpty():
            return found.select(F.col("node.n").alias("node"), F.col("root.n").alias("root"))
        up = materialise(edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        while True:
            over = up.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
            up = materialise(up.join(over, F.col("to") == F.col("_from"), "left").select("from", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break

        def follow(df: DataFrame, column: str) -> DataFrame:
            return df.join(up, F.col(column) == F.col("from"), "left").withColumn(column, F.coalesce("to", column)).drop("from", "to")

        found = materialise(follow(found, "root"))
        moved_edges = follow(follow(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialise(moved_edges.distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(pixels: DataFrame, column: str = "cdl_id", side: int = SIDE, least: int | None = None) -> DataFrame:
    """``r, c, component, size``: the 4-connected component of one class of every pixel, and its pixels in all.

    Components are found in each tile. Those that touch its edge are linked
    with what lies across, by the pixels of the edges alone; the graph of these
    is contracted, and a second look at the tiles gives every pixel its total.
    ``component`` is made of the row and column of one of its pixels. With ``least``, sizes of that many or
    more may be too small, but never below it: links between two parts that are large enough are left out.
    """
    kind = pixels.schema[column].dataType.simpleString()

    def part_of(tile: Tile) -> tuple[np.ndarray, np.ndarray]:
        labels = labelled(tile.square)
        at = tile.of(labels)
        first_r, first_c = at // side + tile.corner[0], at % side + tile.corner[1]
        return (first_r.astype(np.int64) << 31) + first_c + (1 << 30), tile.of(sizes(labels))

    def edge(tile: Tile) -> dict:
        part, n = part_of(tile)
        return {"part": part, "n": n}

    parts = per_tile(pixels, ["r", "c", column], side, 0, {"part": "long", "n": "long"}, edge, column)
    last = lambda x: F.pmod(F.col(x), F.lit(side)) == side - 1
    first = lambda x: F.pmod(F.col(x), F.lit(side)) == 0
    border = materialise(parts.where(last("r") | last("c") | first("r") | first("c")))
    links = []
    for x, y in (("r", "c"), ("c", "r")):
        here = border.where(last(x)).select((F.col(x) + 1).alias(x), y, column, F.col("part").alias("a"), F.col("n").alias("n_a"))
        there = border.where(first(x)).select(x, y, F.col(column).alias("_cls"), F.col("part").alias("b"), F.col("n").alias("n_b"))
        links.append(here.join(there, [x, y]).where(F.col(column).eqNullSafe(F.col("_cls"))).select("a", "b", "n_a", "n_b"))
    both = links[0].union(links[1])
    if least is not None:
        both = both.where(F.least("n_a", "n_b") < least)
    linked = materialise(connected(both.select("a", "b")))
    known = border.select("part", "n").distinct().join(linked, F.col("part") == F.col("node"))
    totals = known.groupBy("root").agg(F.sum("n").alias("total"))
    whole = linked.join(totals, "root").select("node", "root", "total", F.shiftright("node", 31).alias("r"), (F.col("node").bitwiseAND((1 << 31) - 1) - (1 << 30)).alias("c"))
    whole = dealt(whole, side).select("_tr", "_tc", F.col("node").alias("part"), "root", "total")

    def settle(key: tuple, table: pa.Table, more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_type.empty_table()
        tile = Tile(key, table, side, 0, column)
        part, n = part_of(tile)
        own, root, total = (more.column(x).to_numpy() for x in ("part", "root", "total"))
        order = np.argsort(own)
        at = np.searchsorted(own[order], part)
        hit = np.zeros(len(part), bool)
        if len(own):
            at = order[np.minimum(at, len(own) - 1)]
            hit = own[at] == part
            part, n = np.where(hit, root[at], part), np.where(hit, total[at], n)
        return pa.table({"r": table.column("r"), "c": table.column("c"), "component": part, "size": n})

    out_type = pa.schema([("r", pa.int64()), ("c", pa.int64()), ("component", pa.int64()), ("size", pa.int64())])
    again = dealt(pixels.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(column).cast(kind).alias(column)), side).groupBy("_tr", "_tc")
    return again.cogroup(whole.groupBy("_tr", "_tc")).applyInArrow(settle, "r long, c long, component long, size long")

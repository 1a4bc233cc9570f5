"""Sharding by histogram sort.

Rows are ordered by a 192-bit key: 64-bit hashes of the text, of the id, and of
the row's place in the input. So copies of a text lie next to each other, a
large group of copies is cut between its ids, and rows that are equal in both
are cut as well. The splitters are found by counting: every round sends
a few candidate boundaries for each unsettled splitter to all partitions, adds
up the exact bytes (and rows) below each, and narrows the interval that holds
the splitter, until the nearest boundary misses its target by no more than the
tolerance or the interval holds one row. Then the rows are exchanged once.

A shard is cut further into pieces of about ``piece_bytes``, by even ranges of
the hashes, which needs no search. Their rows are counted once. The exchange has as
many partitions as there are pieces, dealt by the piece's number, and a task
orders its pieces; the rows of the pieces before turn places
within a piece into slots of the shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.tables import fresh, materialise, text_or_empty

BITS = 192
TOP = 1 << BITS
PARTS = ("_high", "_low", "_tie")
MAX_PIECES = 65_536


class Boundaries:
    """Sorted keys, searched by arrays of their three parts."""

    def __init__(self, keys: list[int]):
        self.keys = np.array([k.to_bytes(BITS // 8, "big") for k in keys], f"S{BITS // 8}")

    def place(self, *parts: np.ndarray) -> np.ndarray:
        """How many boundaries are at or below each key."""
        whole = np.stack(parts, axis=1).astype(">u8")
        return np.searchsorted(self.keys, whole.view(self.keys.dtype)[:, 0], "right")


def _unsigned(*parts: pd.Series) -> list[np.ndarray]:
    """Signed 64-bit parts in unsigned order."""
    return [p.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for p in parts]


def count_below(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe. One small row per probe interval and task is shuffled."""
    found = Boundaries(probes)

    def histogram(batches):
        bytes_, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = found.place(*_unsigned(*(b[p] for p in PARTS)))
            np.add.at(bytes_, at, b["size"].to_numpy(np.int64))
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"at": some, "bytes": bytes_[some], "rows": rows[some]})

    counted = keys.mapInPandas(histogram, "at long, bytes long, rows long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    bytes_, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in counted.collect():  # as many rows as probes at most
        bytes_[r["at"]], rows[r["at"]] = r["bytes"], r["rows"]
    return np.cumsum(bytes_)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keys: DataFrame, targets: list[int], tolerances: list[float], fan_out: int = 16, heavy: list[int] | None = None) -> list[tuple[int, int]]:
    """For each target number of bytes, a boundary key and the exact rows below it.

    ``heavy`` are keys to probe in the first round beside the evenly spread ones.

    At most about 192 / log2(fan_out) rounds; some five in practice, as hashes
    are spread evenly. No two rows have one key.
    """
    low, high = [(0, 0, 0)] * len(targets), [(TOP, None, None)] * len(targets)
    done: dict[int, tuple[int, int]] = {}
    total_bytes, total_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    high = [(TOP, total_bytes, total_rows)] * len(targets)
    while True:
        for i, t in enumerate(targets):
            if i not in done:
                best = min((low[i], high[i]), key=lambda x: abs(x[1] - t))
                if abs(best[1] - t) <= tolerances[i] or high[i][2] - low[i][2] <= 1:  # one row lies across
                    done[i] = (best[0], best[2])
        open_ = [i for i in range(len(targets)) if i not in done]
        if not open_:
            return [done[i] for i in range(len(targets))]
        probes, heavy = {*(heavy or ())}, None
        for i in open_:
            (a, below, _), (b, above, _) = low[i], high[i]
            probes.update(a + (b - a) * j // fan_out for j in range(1, fan_out))
            if above > below:  # and near the place that even spread would give
                guess = a + (b - a) * (targets[i] - below) // (above - below)
                width = max(1, (b - a) // (4 * fan_out**2))
                probes.update(guess + d * width for d in range(-4, 5))
        probes = sorted(p for p in probes if 0 < p < TOP)
        bytes_, rows = count_below(keys, probes)
        for i in open_:
            at = int(np.searchsorted(bytes_, targets[i], "right"))
            if at > 0 and probes[at - 1] > low[i][0]:
                low[i] = (probes[at - 1], int(bytes_[at - 1]), int(rows[at - 1]))
            if at < len(probes) and probes[at] < high[i][0]:
                high[i] = (probes[at], int(bytes_[at]), int(rows[at]))


class Pieces:
    """The pieces of all shards, from the shards' boundaries and the edges of texts, and of equal rows, that are many.

    These cut the keys into segments, within which pieces are equal ranges of
    the text's hash, or, within the copies of one text, of the id's hash, or,
    within equal rows, of their place's. So a row's piece follows from its
    segment by arithmetic, and only segments are listed.
    """

    def __init__(self, bounds: list[int], edges: list[int], pieces: int):
        inner = sorted({k for k in (*bounds, *edges) if 0 < k < TOP})
        self.edges = [0, *inner]
        ends = [*inner, TOP]
        self.found = Boundaries(inner)
        self.shards = np.searchsorted(Boundaries([k for k in bounds if k < TOP]).keys, Boundaries(self.edges).keys, "right").astype(np.int32)
        self.level = np.array([(a >> 128 == (b - 1) >> 128) + (a >> 64 == (b - 1) >> 64) for a, b in zip(self.edges, ends, strict=True)])
        part = lambda k, level: k >> (128 - 64 * int(level)) & ((1 << 64) - 1)
        self.low = np.array([part(a, c) for a, c in zip(self.edges, self.level, strict=True)], np.uint64)
        self.span = np.array([float(part(b - 1, c) - part(a, c) + 1) for a, b, c in zip(self.edges, ends, self.level, strict=True)])
        self.pieces = pieces
        self.count = np.ones(len(self.edges), np.int64)

    def share(self, bytes_: np.ndarray) -> None:
        """Give each segment its number of pieces by its bytes, one at least."""
        total = np.bincount(self.shards, bytes_).astype(float)
        self.count = np.maximum(1, np.rint(self.pieces * bytes_ / np.maximum(total[self.shards], 1))).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def place(self, high: np.ndarray, low: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment and piece of each key."""
        at = self.found.place(high, low, tie)
        part = np.choose(self.level[at], (high, low, tie)) - self.low[at]
        within = np.minimum((part.astype(float) / self.span[at] * self.count[at]).astype(np.int64), self.count[at] - 1)
        return at, self.first[at] + within


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, piece_bytes: int = 64 << 20, max_pieces: int = MAX_PIECES) -> DataFrame:
    """``docs`` plus ``size, shard, slot``: ``n_shards`` shards of nearly equal bytes.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8. A shard's
    boundary misses the ideal place by ``tolerance`` of a shard's bytes, or by
    less than the one row that lies across it. Slots run from 0 in key order.
    Ids may be of any type, null or repeated; rows with equal id and text are
    told apart by their place in the input, for which the table is written once more. An empty table gives an empty
    result. A new column whose name ``docs`` has gets an underscore.

    The driver searches the shards' boundaries alone. It also holds the row
    counts of the pieces, and the hashes of texts whose copies fill a piece: as
    many as pieces, ``max_pieces`` or so at most, beyond which pieces grow (they are sorted with spill, so they may). No rows.
    """
    size, shard, slot = (fresh(docs, x) for x in ("size", "shard", "slot"))
    own_size, piece, *parts = (fresh(docs, x) for x in ("_size", "_piece", *PARTS))
    text = text_or_empty(text_col)
    keyed = docs.select(
        "*",
        (F.octet_length(text) + 8).cast("long").alias(own_size),
        F.xxhash64(text).alias(parts[0]),
        F.xxhash64(F.lit(1), F.col(id_col)).alias(parts[1]),
    )
    repeated = not keyed.groupBy(*parts[:2]).count().where("count > 1").isEmpty()
    # equal rows are told apart by a number that is written with them, so that it is the same in every pass
    keyed = materialise(keyed.withColumn(parts[2], F.xxhash64(F.monotonically_increasing_id()))) if repeated else keyed.withColumn(parts[2], F.lit(0).cast("long"))
    keys = materialise(keyed.select(F.col(own_size).alias("size"), *(F.col(a).alias(b) for a, b in zip(parts, PARTS, strict=True))))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    each = max(1, min(round(total / n_shards / piece_bytes), max_pieces // n_shards))  # pieces of each shard
    full = total / n_shards / each
    frequent = keys.groupBy("_high").agg(F.sum("size").alias("s")).where(F.col("s") > min(full, total / n_shards / 8)).collect()  # as many as pieces, or 8 * n_shards
    hashes = {r["_high"] + (1 << 63): r["s"] for r in frequent}
    # the edges of texts whose copies fill a good part of a shard are probed first
    edges = [e << 128 for h, s in hashes.items() if s > total / n_shards / 8 for e in (h, h + 1)]
    cuts = [e << 128 for h, s in hashes.items() if s > full for e in (h, h + 1)]
    if repeated:
        equal = keys.groupBy("_high", "_low").agg(F.sum("size").alias("s")).where(F.col("s") > full).collect()  # as many as pieces
        cuts += [(((r["_high"] + (1 << 63)) << 64) + r["_low"] + (1 << 63) + e) << 64 for r in equal for e in (0, 1)]
    splitters = find_splitters(keys, [total * i // n_shards for i in range(1, n_shards)], [total / n_shards * tolerance] * (n_shards - 1), heavy=edges)
    pieces = Pieces([k for k, _ in splitters], cuts, each)
    pieces.share(np.diff([0, *count_below(keys, pieces.edges[1:])[0], total]))

    def counted(batches):
        rows = np.zeros(int(pieces.count.sum()), np.int64)
        for b in batches:
            np.add.at(rows, pieces.place(*_unsigned(*(b[p] for p in PARTS)))[1], 1)
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"piece": some, "rows": rows[some]})

    rows = np.zeros(int(pieces.count.sum()), np.int64)
    for r in keys.mapInPandas(counted, "piece long, rows long").groupBy("piece").agg(F.sum("rows").alias("rows")).collect():  # as many as pieces
        rows[r["piece"]] = r["rows"]
    below = np.cumsum(rows) - rows
    shard_of = np.repeat(pieces.shards, pieces.count)
    before = below - below[np.searchsorted(shard_of, shard_of)]  # rows of the shard's earlier pieces

    @F.pandas_udf("struct<piece int, shard int, before long>")
    def place(high: pd.Series, low: pd.Series, tie: pd.Series) -> pd.DataFrame:
        segment, at = pieces.place(*_unsigned(high, low, tie))
        return pd.DataFrame({"piece": at.astype(np.int32), "shard": pieces.shards[segment], "before": before[at]})

    placed = keyed.withColumn(piece, place(*parts)).withColumn(at := fresh(docs, "_at"), F.col(f"{piece}.piece"))
    here = Window.partitionBy(at).orderBy(*parts)
    out = placed.repartitionById(len(rows), at).withColumns({size: F.col(own_size), shard: F.col(f"{piece}.shard"), slot: F.col(f"{piece}.before") + F.row_number().over(here) - 1})
    return out.select(*docs.columns, size, shard, slot)

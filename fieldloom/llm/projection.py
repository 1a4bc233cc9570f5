"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of one label are one node. In each of ``PASSES`` passes the nodes
of a label are ordered by the concatenated bits of their own random hyperplane
hashes, over all partitions, and each is compared with the ``WINDOW`` nodes
that follow it. What moves for a pass is a vector in bytes, with the length of
its rounding error, so a comparison can only err towards keeping a pair. The
pairs kept are joined over all passes to coarse groups.

A window holds few neighbours, and a node of a large group has many more. So
the passes only have to connect a group; within it all vectors are then
compared exactly, in blocks of ``BLOCK``, each pair of blocks in a task of its
own. Blocks yield a count for each node and as few verified pairs as connect
what is linked, never all pairs. Joined, these are the components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.components import components
from fieldloom.llm.tables import fresh, materialise

COSINE = 0.98
PASSES = 12
WINDOW = 64
BITS = 64
BLOCK = 1024
ROWS_PER_TASK = 100_000
SEED = 20


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values as double, and where each vector starts; null vectors are empty and null values NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def by_length(column: pa.Array):
    """For each length of vectors: the rows that have it, and their matrix."""
    values, starts = _vectors(column)
    lengths = np.diff(starts)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, values[starts[at][:, None] + np.arange(d)]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their greatest entry first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _digests(rows: DataFrame) -> DataFrame:
    """``_id, digest, label, v``; the digest is null where a row links with nothing."""

    def digest(batches):
        for b in batches:
            labels, out = b.column("label").to_pylist(), [None] * b.num_rows
            for d, at, x in by_length(b.column("v")):
                if d:
                    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    for i, row in zip(at[fine], x[fine] + 0.0, strict=True):  # -0.0 is 0.0
                        if labels[i] is not None:
                            out[i] = xxhash.xxh128_digest(repr(labels[i]).encode() + row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.binary()), b.column("label"), b.column("v")], ["_id", "digest", "label", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(digest, f"_id {kinds['_id']}, digest binary, label {kinds['label']}, v {kinds['v']}")


def _keys(passes: int):
    """From ``node, label, v``: a row for each pass with its key and the vector in bytes."""

    def project(batches):
        planes: dict = {}
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                c = b.slice(k, 2000)
                for d, at, x in by_length(c.column("v")):
                    if d not in planes:
                        planes[d] = np.random.default_rng((SEED, d)).normal(size=(d, passes * BITS))
                    u = units(x)
                    scale = np.abs(u).max(axis=1) / 127
                    q = np.rint(u / scale[:, None]).astype(np.int8)
                    error = np.linalg.norm(u - q * scale[:, None], axis=1)
                    keys = np.packbits((u @ planes[d] > 0).reshape(-1, passes, BITS), axis=2).view(">i8")[:, :, 0].astype("<i8")
                    few = c.take(pa.array(at))
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), p, np.int32)), few.column("label"), pa.array(np.full(len(at), d, np.int32)), pa.array(keys[:, p]), few.column("node"), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(error.astype(np.float32))],
                            ["pass", "label", "d", "key", "node", "q", "scale", "error"],
                        )

    return project


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``i < j`` of ``n`` rows, few that connect the same rows: about one a row."""
    if not len(i):
        return i, j
    parent = np.arange(n)
    np.minimum.at(parent, j, i)
    at = np.flatnonzero(parent != np.arange(n))
    root = parent
    while (root != (root := root[root])).any():
        pass
    rest = root[i] != root[j]
    low, high = np.minimum(root[i[rest]], root[j[rest]]), np.maximum(root[i[rest]], root[j[rest]])
    more = np.unique(low * n + high)
    return np.concatenate([parent[at], more // n]), np.concatenate([at, more % n])


def _windows(cosine: float, window: int):
    """From rows in order of pass, label, length and key: pairs of near nodes of a window."""
    reach = math.sqrt(2 - 2 * cosine)

    def near(batches):
        kept = None  # the last rows of the batch before
        for b in batches:
            table = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            old = 0 if kept is None else kept.num_rows
            n = table.num_rows
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            group = np.stack([table.column("pass").to_numpy(), table.column("d").to_numpy(), label])
            starts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
            node, scale, error = (table.column(c).to_numpy() for c in ("node", "scale", "error"))
            q = table.column("q").combine_chunks()
            firsts, seconds = [], []
            for a, z in zip(starts, [*starts[1:], n], strict=True):
                d = int(group[1, a])
                x = np.frombuffer(b"".join(q.slice(a, z - a).to_pylist()), np.int8).reshape(-1, d) * scale[a:z, None]
                size = np.einsum("ij,ij->i", x, x)
                for s in range(0, z - a, 256):
                    e, f = min(s + 256, z - a), min(s + 256 + window, z - a)
                    apart = size[s:e, None] + size[None, s:f] - 2 * (x[s:e] @ x[s:f].T)
                    most = (reach + error[a + s : a + e, None] + error[None, a + s : a + f] + 1e-3) ** 2
                    i, j = np.nonzero(apart <= most)
                    here = (j > i) & (j - i <= window) & (a + s + j >= old)
                    firsts.append(i[here] + a + s), seconds.append(j[here] + a + s)
            i, j = forest(n, np.concatenate(firsts), np.concatenate(seconds))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])
            kept = table.slice(max(0, n - window))

    return near


def coarse_pairs(nodes: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``a, b``: pairs of ``nodes (node, label, v)`` that meet in a window of some pass and may be alike."""
    rows = nodes.count() * passes
    n = max(1, min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // (16 * window)), rows // ROWS_PER_TASK)
    label = nodes.schema["label"].dataType.simpleString()
    keyed = nodes.select("node", "label", "v").mapInArrow(_keys(passes), f"pass int, label {label}, d int, key long, node long, q binary, scale float, error float")
    order = ["pass", "label", "d", "key", "node"]
    # the keys are written, as the bounds of the partitions are found in a pass of their own
    placed = materialise(keyed).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(_windows(cosine, window), "a long, b long").distinct()


def _blocks(cosine: float):
    """From rows in order of group and pair of blocks: counts ``(a, null, copies)`` and connecting pairs ``(a, b, 0)``."""

    def compared(parts: list):
        """Whole pairs of blocks, of one length of vectors each."""
        table = pa.concat_tables(parts)
        key = np.stack([table.column(c).to_numpy() for c in ("root", "low", "high")])
        run = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        block, node, copies = (table.column(c).to_numpy() for c in ("block", "node", "copies"))
        across = key[1] != key[2]
        for _, at, x in by_length(table.column("v")):
            u = units(x)
            for s in range(0, len(at), BLOCK):
                rows = at[s : s + BLOCK]
                last = np.searchsorted(run[at], run[rows[-1]], "right")  # the rest belongs to other pairs of blocks
                others = at[s:last]
                linked = u[s : s + BLOCK] @ u[s:last].T >= cosine
                linked &= run[rows][:, None] == run[others][None, :]
                linked &= ~across[rows][:, None] | (block[rows][:, None] != block[others][None, :])
                i, j = np.nonzero(linked)
                i, j = rows[i[j > i]], others[j[j > i]]
                if len(i):
                    sums = np.bincount(i, copies[j], len(run)) + np.bincount(j, copies[i], len(run))
                    some = np.flatnonzero(sums)
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(len(some), pa.int64()), pa.array(sums[some].astype(np.int64))], ["a", "b", "n"])
                    i, j = forest(len(run), i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(np.zeros(len(i), np.int64))], ["a", "b", "n"])

    def compare(batches):
        parts, held = [], 0
        for b in batches:
            table = pa.Table.from_batches([b])
            key = np.stack([table.column(c).to_numpy() for c in ("root", "low", "high")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if parts and tuple(parts[-1].slice(parts[-1].num_rows - 1).select(["root", "low", "high"]).to_pylist()[0].values()) != tuple(key[:, 0]):
                ends = np.concatenate([[0], ends])
            a = 0
            for z in ends:  # what comes before an end is whole
                if held + z - a >= BLOCK:
                    parts.append(table.slice(a, z - a))
                    yield from compared(parts)
                    parts, held, a = [], 0, z
            parts.append(table.slice(a))
            held += table.num_rows - a
        if held:
            yield from compared(parts)

    return compare


def exact_links(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of ``members (root, node, v, copies)``: the copies linked with each node, and pairs that connect what is linked."""
    sizes = materialise(members.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")).withColumnRenamed("root", "_root")
    cut = members.hint("merge").join(sizes, F.col("root") == F.col("_root"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "v")
    key = ["root", "low", "high"]
    found = materialise(cut.repartition(*key).sortWithinPartitions(*key).mapInArrow(_blocks(cosine), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    return counts, found.where("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``id_col, n_links, component_id, kept``: one row per row of ``vectors``.

    Rows of equal label and length whose vectors have a cosine of ``cosine`` or
    more are linked; ``n_links`` counts the other rows linked directly and
    ``component_id`` is the least id reachable, the row's own included. A row
    whose label or vector is null, or whose vector is empty, zero or holds a
    null or non-finite entry, links with nothing. Repeated rows and ids are
    rows of their own; a null id is never ``kept`` and passed over as least id.
    An empty table gives no rows.

    No pair below ``cosine`` is linked. A pair is found if some pass brings its
    group together: at the limit of 0.98 and a million rows of a label, a pass
    fails for two rows that nothing else connects with a chance of 0.6, and all
    twelve with 0.002. Within a group that is connected, all links are counted.
    """
    kind = vectors.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"column {id_col} must hold integers, not {kind.simpleString()}")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    rows = materialise(_digests(rows))
    linking = rows.where("digest is not null")
    classes = linking.groupBy("digest").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("_id").alias("least_id"), F.count("*").alias("copies"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "*"))
    groups = components(coarse_pairs(classes, cosine, passes, window)).withColumnRenamed("node", "_node")
    members = classes.select("node", "v", "copies").hint("merge").join(groups, F.col("node") == F.col("_node")).select("root", "node", "v", "copies")
    counts, pairs = exact_links(materialise(members), cosine, block)
    roots = components(pairs).withColumnRenamed("node", "_node")
    placed = classes.select("node", "digest", "least_id", "copies").hint("merge").join(roots, F.col("node") == F.col("_node"), "left")
    placed = placed.join(counts.hint("merge"), "node", "left").select("digest", "least_id", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"))
    placed = materialise(placed)
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = materialise(placed.hint("merge").join(least, "root").select(F.col("digest").alias("_digest"), (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.select("_id", "digest").hint("merge").join(found, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("_digest").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept")
    )


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """The rows of ``vectors`` that :func:`near_duplicates` keeps; of a repeated id that is kept, all its rows."""
    kept = near_duplicates(vectors, id_col, vector_col, label_col, cosine).where("kept").select(F.col(id_col).alias(name := fresh(vectors, "_kept"))).distinct()
    return vectors.hint("merge").join(kept, F.col(f"`{id_col}`") == F.col(name), "left_semi")

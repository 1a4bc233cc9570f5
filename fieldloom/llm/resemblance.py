"""Near-duplicates by word shingles: all pairs of texts whose sets have a Jaccard similarity of 0.8 or more.

A text stands for the set of the hashes of its five-word shingles; equal sets
are one node. The SimHash fingerprints of the sets find the closest pairs first,
by multi-index hashing as in :mod:`simhash`, and their sets are compared. Most
pairs at 0.8 lie further apart than small Hamming balls reach, so the rest is
found on the sets themselves.

Of the least hashes of two sets' union, each lies in both sets with a chance of
0.8 or more. So alike sets share at least ``MEET`` of their ``PREFIX`` least
hashes each, but for a chance of 3e-12; of short sets fewer hashes do, for
certain: sorted by hash, sets of sizes ``n`` and ``m`` share ``n // 10 + 1`` of the
first ``n - ceil(0.8 n) + 1 + n // 10`` of one of them. Only these prefixes are
joined, whatever a text's length. Pairs that share too few of them are left out,
and the others are verified on whole sets.

A hash in the prefixes of more than ``dense`` sets would give pairs in the
square of their number. A pair can lie within such hashes alone only if both
sets have several of them. Each of those sets is first compared with one that
shares most of its crowded hashes, of those with the most links so far: near
copies of a text are likest its middle, so that one brings them together, and
pairs within their group are not listed later. Then the ``SKETCH`` least hashes of a set are put in another order, the rarest
first, and the prefixes of that order are joined (alike sets share half of
these sketches, but for a chance of 3e-9): a passage that many sets share
comes last there, so it brings two sets together only if they hold little else.

Before sets move to be compared, a pair has to pass the parities of its sets'
hashes in ``PARITIES`` classes: alike sets have few hashes apart and differ in
no more classes. So near copies that are just not alike leave no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import simhash
from fieldloom.llm.components import components
from fieldloom.llm.tables import materialise, scratch

SHINGLE = 5
SIMILARITY = 80  # hundredths
DENSE = 32
PREFIX, MEET = 32, 8
SKETCH = 64
PARITIES = 512
FIRST = 32
MOST_SENT = 2_000_000  # numbers of rows, 16 MB, that may be broadcast


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles; fewer words make one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([xxh(b" ".join(words), 42)], np.uint64)
    return np.unique(np.array([xxh(b" ".join(g), 42) for g in zip(*(words[i:] for i in range(shingle)), strict=False)], np.uint64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def with_set_id(docs: DataFrame, text_col: str = "text", name: str = "_fp") -> DataFrame:
    """``docs`` plus the hash of the set of shingles as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for t in texts:
            if t not in known:
                known[t] = set_id(shingle_set(t))
        return pd.Series(np.array([known[t] for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text_col)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITIES`` classes of hashes, by their first bits, holds an odd number, as 64-bit integers."""
    odd = np.bincount((hashes // np.uint64((1 << 64) // PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _with_sets(docs: DataFrame) -> DataFrame:
    """``row, _id, fp, print, odd, n, low, hashes`` from ``_id, _text``.

    ``print`` is the set's SimHash, ``odd`` its parities, ``n`` its size and ``low`` its least hashes.
    """

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int64)))

    def of(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 500):  # few texts at a time, so that a worker stays small
                b = whole.slice(i, 500)
                sets = [shingle_set(t.as_py()) for t in b.column("_text")]
                ids, prints = (pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64)) for f in (set_id, simhash.majority))
                signed = [s.view(np.int64) for s in sets]
                columns = [b.column("row"), b.column("_id"), ids, prints, lists([parities(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32()), lists([s[:SKETCH] for s in signed]), lists(signed)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "_id", "fp", "print", "odd", "n", "low", "hashes"])

    kind = docs.schema["_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "_id", "_text")
    return numbered.mapInArrow(of, f"row long, _id {kind}, fp long, print long, odd array<long>, n int, low array<long>, hashes array<long>")


def _alike_in_size(n, m):
    return (n * 100 >= m * SIMILARITY) & (m * 100 >= n * SIMILARITY)


def _may_be_alike(x: str, y: str):
    """Whether the parities of ``x`` and ``y`` allow it; alike sets differ in at most a ninth of their hashes."""
    differ = sum((F.bit_count(F.col(f"{x}odd")[i].bitwiseXOR(F.col(f"{y}odd")[i])) for i in range(1, PARITIES // 64)), F.bit_count(F.col(f"{x}odd")[0].bitwiseXOR(F.col(f"{y}odd")[0])))
    return _alike_in_size(F.col(f"{x}n"), F.col(f"{y}n")) & (differ * 9 <= F.col(f"{x}n") + F.col(f"{y}n"))


class _Sets:
    """The distinct sets: ``heads (fp, row, print, odd, n, low)``, and the whole sets of all rows."""

    def __init__(self, sets: DataFrame):
        self.sets = sets
        first = [F.first(c).alias(c) for c in ("print", "odd", "n", "low")]
        self.heads = materialise(sets.where("n > 0").groupBy("fp").agg(F.min("row").alias("row"), *first))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of ``a, b`` those that are alike; whole sets move for pairs that pass the parities."""
        own = self.heads.select("fp", "row", "odd", "n")
        for end in ("a", "b"):
            pairs = pairs.hint("merge").join(own.select(F.col("fp").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("row", "odd", "n"))), end)
        with scratch(pairs.sparkSession) as write:
            pairs = write(pairs.where(_may_be_alike("a_", "b_")).select("a", "b", "a_row", "b_row"))
            rows = write(pairs.select(F.explode(F.array("a_row", "b_row")).alias("row")).distinct())
            # the sets of a pair are a small part of all: few enough wanted rows go to the sets, and more of them meet by a shuffle
            few = rows.count() <= MOST_SENT
            whole = write(self.sets.select("row", "hashes").join(F.broadcast(rows) if few else rows.hint("merge"), "row", "left_semi"))
            both = pairs.hint("merge").join(whole.select(F.col("row").alias("a_row"), F.col("hashes").alias("x")), "a_row")
            both = both.hint("merge").join(whole.select(F.col("row").alias("b_row"), F.col("hashes").alias("y")), "b_row")
            shared = F.size(F.array_intersect("x", "y"))
            return materialise(both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), shared.alias("c")).where(F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * SIMILARITY).select("a", "b"))

    def by_fingerprint(self) -> DataFrame:
        """``a, b``: pairs of sets whose SimHash fingerprints are equal or linked."""
        prints = self.heads.select("fp", "print")
        least = materialise(prints.groupBy("print").agg(F.min("fp").alias("head")))
        within = prints.hint("merge").join(least, "print").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
        near = simhash.links(least.select(F.col("print").alias("fp")))
        for end in ("a", "b"):
            near = near.join(least.toDF(end, f"_{end}"), end).drop(end).withColumnRenamed(f"_{end}", end)
        return within.union(near.select("a", "b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """``a, b`` of the pairs that meet at enough keys; ``rows``: key, fp, n, and d, the keys of the set that are left out."""
    x, y = rows.alias("x"), rows.alias("y")
    met = x.hint("merge").join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _alike_in_size(F.col("x.n"), F.col("y.n")))
    least = F.least(F.expr("x.n div 10") + 1, F.expr("y.n div 10") + 1, F.lit(MEET)) - F.least("x.d", "y.d")
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), least.alias("least")).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("least").alias("least")).where("c >= least").select("a", "b")


def links(sets: DataFrame, dense: int = DENSE) -> DataFrame:
    """``a, b``: pairs that connect all sets of ``sets`` (as :func:`_with_sets` gives them) that are alike."""
    own = _Sets(sets)
    n = F.col("n")
    prefix = F.least(n - F.ceil(n * SIMILARITY / 100) + 1 + F.floor(n / 10), F.lit(PREFIX)).cast("int")
    rows = own.heads.select(F.explode(F.slice("low", F.lit(1), prefix)).alias("key"), "fp", "n")
    # counted as partial sums; the join that follows may split the rows of a key
    often = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    shared = materialise(rows.hint("merge").join(often, "key"))
    crowded = shared.where(F.col("times") > dense)
    some = not crowded.isEmpty()
    many = materialise(crowded.groupBy("fp").agg(F.count("*").alias("d"))) if some else None
    rest = shared.where(F.col("times") <= dense).select("key", "fp", "n")
    rest = rest.join(many, "fp", "left").select("key", "fp", "n", F.coalesce("d", F.lit(0)).alias("d")) if some else rest.withColumn("d", F.lit(0))
    edges = own.verified(materialise(own.by_fingerprint().union(_pairs(rest)).distinct()))
    if not some:
        return edges
    full = materialise(crowded.select("key", "fp", "n").join(many, "fp").where(F.col("d") > F.least(F.expr("n * 8 div 100"), F.lit(MEET - 1))).select("key", "fp", "n"))

    def labelled(rows: DataFrame) -> DataFrame:
        linked = edges.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("links"))
        roots = components(edges).join(linked, F.col("node") == F.col("end"))
        return materialise(rows.join(roots, rows["fp"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "fp").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))

    rare = materialise(_rare_first(own.heads, full.select("fp").distinct()))
    for salt, rows in enumerate((full, rare)):
        edges = materialise(edges.union(own.verified(_stars(labelled(rows), salt))))
    return edges.union(own.verified(materialise(_apart(labelled(rare).drop("links"), own.heads)))).distinct()


def _stars(rows: DataFrame, salt: int) -> DataFrame:
    """``a, b``: each set with one of another group, of the most linked sets of its keys (by hash, of equals) the one that it meets most often."""
    heads = rows.groupBy("key").agg(F.min(F.struct((-F.col("links")).alias("fewer"), F.xxhash64("fp", F.lit(salt)).alias("h"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("to"))).alias("k")).select("key", "k.*")
    met = rows.hint("merge").join(heads, "key").where((F.col("root") != F.col("to")) & _alike_in_size(F.col("n"), F.col("m")))
    times = met.groupBy("fp", "b").agg(F.count("*").alias("c"), F.first("h").alias("h"))
    return times.groupBy(F.col("fp").alias("a")).agg(F.max_by("b", F.struct("c", "h")).alias("b"))


def _rare_first(heads: DataFrame, chosen: DataFrame) -> DataFrame:
    """``key, fp, n, first``: the first hashes of the chosen sets' sketches, by rarity among them and then by hash.

    Sets of up to ``0.8 * SKETCH`` hashes share 0.8 of the lesser, larger ones half of their sketches. A hash that no other
    chosen set has takes a place but meets nothing, so it isn't listed.
    ``first`` holds the first ``FIRST`` of a set that are.
    """
    n = F.col("n")
    own = heads.select("fp", "n", "low").hint("merge").join(chosen, "fp", "left_semi")
    rows = materialise(own.select(F.explode("low").alias("key"), "fp", "n", F.size("low").alias("own")))
    often = materialise(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"))
    met = rows.hint("merge").join(often, "key").groupBy("fp").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.sort_array(F.collect_list(F.struct("times", "key"))).alias("k"))
    wanted = F.when(n <= SKETCH * SIMILARITY // 100, n - F.ceil(n * SIMILARITY / 100) + 1).otherwise(F.col("own") - SKETCH // 2 + 1)
    left = wanted - (F.col("own") - F.size("k"))
    prefix = met.where(left > 0).select("fp", "n", F.slice("k.key", F.lit(1), left.cast("int")).alias("k"))
    return prefix.select(F.explode("k").alias("key"), "fp", "n", F.slice("k", 1, FIRST).alias("first"))


def _apart(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``a, b``: sets of different groups that share a hash of ``rows (key, fp, n, first, root)`` and may be alike by their parities."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = rows.hint("merge").join(mixed, "key", "left_semi")
    rows = materialise(rows.hint("merge").join(heads.select("fp", "odd"), "fp"))
    x, y = rows.alias("x"), rows.alias("y")
    # of the keys that a pair shares, the first is enough
    may = _may_be_alike("x.", "y.") & (F.coalesce(F.get(F.array_intersect("x.first", "y.first"), F.lit(0)), F.col("x.key")) == F.col("x.key"))
    met = x.hint("merge").join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & may)
    return met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """As :func:`simhash.near_duplicates`, with the hash of the set of shingles as fingerprint."""
    sets, groups = _grouped(docs, id_col, text_col, dense)
    return simhash.placed(sets.select("_id", "fp"), groups, id_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str, dense: int, write: Callable[[DataFrame], DataFrame] = materialise) -> tuple[DataFrame, DataFrame]:
    sets = write(_with_sets(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))))
    return sets, simhash.grouped(sets.select("_id", "fp"), lambda _: links(sets, dense))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """As :func:`simhash.deduplicate`, of groups by Jaccard similarity."""
    with scratch(docs.sparkSession) as write:
        _, groups = _grouped(docs, id_col, text_col, dense, write)
    return simhash.keep_heads(docs, groups, with_set_id, id_col, text_col)

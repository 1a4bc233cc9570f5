"""SimHash near-duplicates through multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that
differ in at most two bits differ in at most one bit of some segment. So every
distinct fingerprint is entered into one table for each segment, and looks up
each segment's value and the values with one of its set bits cleared (the other
half of the Hamming ball of radius 1 is covered by the partner's lookups).
Matches are verified on all 64 bits.

A table entry that many fingerprints share would give pairs in the square of
their number. Entries of more than ``dense`` fingerprints are therefore linked
another exact way: each member looks up whole fingerprints half way, its
segment with at most one bit of the other segment flipped. All that meet at one
such point differ in at most two bits, and every pair that the entry holds
meets at one, so linking each to the least that meets there loses no link.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.tables import fresh, materialise

SHINGLE = 3
BITS = 2
DENSE = 32
COPIES = 100_000  # rows of one fingerprint that may go to a task


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words or null."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [xxh(b" ".join(words), 42)]
    else:
        hashes = [xxh(b" ".join(g), 42) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return majority(hashes)


def majority(hashes) -> int:
    """The bits that more than half the hashes have; 0 for none."""
    totals = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "_fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` plus the fingerprint as a signed long; 0 for a null text or one without words."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for t in texts:
            if t not in known:
                known[t] = simhash(t, shingle)
        return pd.Series(np.array([known[t] for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, of(F.col(text_col)))


def _lookups(batches):
    """From ``fp``: its entries (own) and lookups by segment."""
    bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for segment, shift in ((0, np.uint64(0)), (1, np.uint64(32))):
            value = (fp >> shift) & np.uint64(0xFFFFFFFF)
            at, bit = np.nonzero((value[:, None] & bits[None, :]) > 0)
            key = np.concatenate([value, value[at] & ~bits[bit]]) * np.uint64(2) + np.uint64(segment)
            who = np.concatenate([fp, fp[at]])
            own = np.concatenate([np.ones(len(fp), bool), np.zeros(len(at), bool)])
            for i in range(0, len(key), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(who[s].view(np.int64)), pa.array(own[s])], ["key", "fp", "own"])


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """``a, b``: pairs that connect all distinct fingerprints (``fp long``) within two bits.

    Every pair is returned but those within dense entries, which are connected
    through common neighbours instead.
    """
    lookups = distinct.select("fp").mapInArrow(_lookups, "key long, fp long, own boolean")
    table = distinct.select(
        F.col("fp").alias("other"),
        F.explode(
            F.array(
                F.col("fp").bitwiseAND(0xFFFFFFFF) * 2,
                F.shiftrightunsigned("fp", 32) * 2 + 1,
            )
        ).alias("key"),
    )
    crowded = materialise(table.groupBy("key").count().where(F.col("count") > dense).select("key"))
    sparse = table.join(crowded, "key", "left_anti")
    pairs = (
        lookups.hint("merge").join(sparse, "key")  # a few dozen rows for each fingerprint, which Spark does not foresee
        .where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS) & (F.col("fp") != F.col("other")))
        .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    )
    if crowded.isEmpty():
        return pairs.distinct()

    def half_way(batches):
        bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
        low = np.uint64(0xFFFFFFFF)
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                c = b.slice(i, 5000)
                key, fp = (c.column(j).to_numpy(zero_copy_only=False).view(np.uint64) for j in (0, 1))
                own = c.column(2).to_numpy(zero_copy_only=False)
                upper = (key & np.uint64(1)) == 1
                value = key >> np.uint64(1)
                point = np.where(upper, (value << np.uint64(32)) | (fp & low), (fp & ~low) | value)
                shift = np.where(upper, np.uint64(0), np.uint64(32))  # of the other segment
                flips = point[own][:, None] ^ (bits[None, :] << shift[own][:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([point, flips.ravel()]).view(np.int64)), pa.array(np.concatenate([fp, np.repeat(fp[own], 32)]).view(np.int64))],
                    ["point", "fp"],
                )

    meeting = materialise(lookups.join(crowded, "key", "left_semi").select("key", "fp", "own").mapInArrow(half_way, "point long, fp long").distinct())
    least = meeting.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = meeting.join(least, "point").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fingerprint, component_id, class_fingerprint``, one row per row of ``docs``.

    Lower-cased (A-Z) words between ASCII blanks, ``shingle``-word shingles with
    repeats; fewer words make one shingle of all; no words, or null, give the
    fingerprint 0, linked like any other. Fingerprints within two bits are
    linked; ``component_id`` is the least id reachable (null only where all ids
    are null). Repeated rows stay and get equal values; an empty table gives no rows.
    """
    printed = materialise(_printed(docs, id_col, text_col, shingle))
    return placed(printed, grouped(printed, links), id_col)


def _printed(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    return fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", shingle=shingle).select("_id", F.col("_fp").alias("fp"))


def grouped(printed: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fp, least_id, root`` of the distinct ``fp`` of ``printed (_id, fp long)``, by the pairs that ``link`` finds among them."""
    groups = materialise(printed.groupBy("fp").agg(F.min("_id").alias("least_id")))
    roots = components(materialise(link(groups)))
    return materialise(groups.hint("merge").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))


def placed(printed: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``printed`` with what ``groups`` says of their fingerprints.

    Copies share a fingerprint. The classes are listed once for every ``COPIES`` of a
    fingerprint's rows, and a row meets one of these by its id, so no task gets all copies.
    """
    least = materialise(groups.groupBy("root").agg(F.min("least_id").alias("component_id")))
    times = printed.groupBy("fp").agg(F.count("*").alias("times")).where(F.col("times") > COPIES)
    times = materialise(times.select(F.col("fp").alias("_fp"), F.ceil(F.col("times") / COPIES).alias("parts")))
    classes = groups.hint("merge").join(least, "root").select("fp", "component_id", _hex("root").alias("class_fingerprint"))
    widest = times.agg(F.max("parts")).first()[0] or 1
    classes = classes.hint("merge").join(times, F.col("fp") == F.col("_fp"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a row's part is drawn from the parts of the most frequent fingerprint; every class answers to all of them, the frequent ones part by part
    split = classes.where("parts > 1").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(widest).cast("long") - 1)))
    whole = materialise(classes.where("parts = 1").withColumn("_part", F.lit(None).cast("long")).union(split).select(F.col("fp").alias("_fp"), "_part", "component_id", "class_fingerprint"))
    rows = printed.join(F.broadcast(times.select("_fp")), F.col("fp") == F.col("_fp"), "left") if widest > 1 else printed.withColumn("_fp", F.lit(None).cast("long"))
    rows = rows.select("_id", "fp", F.when(F.col("_fp").isNotNull(), F.pmod(F.xxhash64("_id"), F.lit(widest))).alias("_part"))
    met = rows.hint("merge").join(whole, (F.col("fp") == F.col("_fp")) & rows["_part"].eqNullSafe(whole["_part"]))
    return met.select(F.col("_id").alias(id_col), _hex("fp").alias("fingerprint"), "component_id", "class_fingerprint")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the least id of each group of near-duplicates, with the columns of ``docs``.

    A row that repeats that id within the group is a copy and goes too; of a
    group without any id one row of the least fingerprint stays.
    """
    return keep_heads(docs, grouped(materialise(_printed(docs, id_col, text_col)), links), fingerprint, id_col, text_col)


def keep_heads(docs: DataFrame, groups: DataFrame, prints: Callable[[DataFrame, str, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """One row of each of the ``groups``: that of the least id, of ids that are all null the one of the least fingerprint; ``prints`` adds the fingerprint to ``docs``."""
    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("_id"), _hex("fp").alias("_hex")))
    kept = materialise(groups.groupBy("root").agg(least.alias("k")).select("k._id", "k._hex"))
    plain = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty()
    if plain:
        # kept ids grow with the input; without the hint small inputs would broadcast them and large ones not
        return docs.join(kept.select(F.col("_id").alias(id_col)).hint("merge"), id_col, "left_semi").select(*docs.columns)
    # some ids repeat: tell their rows apart by fingerprint, and keep one of each
    hex_col = fresh(docs, "_fp_hex")
    printed = prints(docs, text_col, hex_col).withColumn(hex_col, _hex(hex_col))
    again = printed.join(kept, printed[id_col].eqNullSafe(kept["_id"]) & (printed[hex_col] == kept["_hex"]), "left_semi")
    return again.dropDuplicates([id_col, hex_col]).select(*docs.columns)

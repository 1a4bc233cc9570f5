"""Mixing sources to target weights, with column expressions only.

Each source's documents form one stream of words in a pseudorandom order,
packed into blocks of ``block`` words (the last one may be shorter). A source's
target says how many words the mix takes from it, and so how many slots: passes
over its blocks, each block once a pass, and a last pass as far as the target
reaches. First the output shards draw how many slots of each source they hold:
a multinomial draw, conditioned on the run taking every source's slots exactly,
which makes the totals of a run meet the targets and not only their
expectation. The counts number a source's slots shard by shard. Within a pass,
slots meet blocks through a permutation of the full blocks' indices seeded by
source and pass, a Feistel network that walks its cycle until it is back among
the indices (the short block comes last). The slots are then joined to the
blocks by index, and every word taken belongs to a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.tables import WORD, fresh, materialise, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 256
MAX_REPEAT = 3
SLOTS_PER_SHARD = 4096
ROWS_PER_STEP = 4096
ROWS_PER_TASK = 16 * ROWS_PER_STEP
FEISTEL_ROUNDS = 6
WALK = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``source, source_size, weight, target, rank`` from ``source, source_size``.

    Sources rank by code point, null last, and the weights repeat along the
    ranks. Targets share all words by weight; those above ``max_repeat`` times
    the source's size stop there and the excess is shared again by weight among
    the others until none is above. Each round takes two sums to the driver.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialise(ordered)
    part = F.shiftright("_id", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    if not starts:
        return ordered.select("source", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("rank"))
    before = F.create_map(*(F.lit(x) for p, n in starts.items() for x in (p, n)))
    rank = before[part] + F.col("_id").bitwiseAND((1 << 33) - 1)
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ordered.withColumn("rank", rank.cast("long")).withColumn("weight", table[(F.col("rank") % len(weights)).cast("int")])
    ranked = ranked.select("source", "source_size", "weight", "rank", (F.col("source_size") * float(max_repeat)).alias("_most"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words for each unit of weight
    while True:
        free = F.col("_most") > F.lit(level) * F.col("weight")
        fixed, weight = ranked.agg(F.sum(F.when(~free, F.col("_most")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        new = (total - fixed) / weight if weight else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return ranked.select("source", "source_size", "weight", F.least(F.lit(level) * F.col("weight"), F.col("_most")).alias("target"), "rank")


def stream(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """``units (id, h, occ, source, size)`` plus ``low``: the words before each in its source's stream.

    The order is by hash. A source is cut into buckets, about as many as the
    square root of all rows; the buckets are summed first, so a source that
    holds a third of all rows is no task's alone.
    """
    n_buckets = math.isqrt(units.count()) + 1
    order = F.xxhash64("id", "h", "occ")
    placed = units.withColumn("_o", order).withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(n_buckets)))
    by_source = Window.partitionBy("source").orderBy("_b")
    buckets = placed.groupBy("source", "_b").agg(F.sum("size").alias("_s")).withColumn("_before", F.sum("_s").over(by_source) - F.col("_s")).select(F.col("source").alias("_src"), F.col("_b").alias("_bb"), "_before")
    here = Window.partitionBy("source", "_b").orderBy("_o", "id", "h", "occ").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_w", F.coalesce(F.sum("size").over(here), F.lit(0)))
    joined = within.join(materialise(buckets), F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_bb")))
    return joined.select("id", "h", "occ", "source", "size", (F.col("_before") + F.col("_w")).alias("low"))


def permute(index: Column, size: Column, *key: Column) -> Column:
    """The place of ``index`` in a permutation of ``0 .. size - 1`` chosen by ``key``; for sizes up to ``2**62``.

    An unbalanced Feistel network over the bits of ``size - 1``. An index that
    leaves the range goes through it again; with at least half of the numbers
    inside, ``WALK`` times are enough but for a chance of ``2**-64``, which is an error.
    """
    bits = F.length(F.bin(F.greatest(size - 1, F.lit(1))))
    low_bits = F.floor(bits / 2).cast("int")
    one = F.lit(1).cast("long")
    low, high = (F.call_function("shiftleft", one, n) - 1 for n in (low_bits, bits - low_bits))

    def turn(i: int):
        def mixed(p: Column) -> Column:
            l, h = p["l"], p["h"]
            if i % 2:
                l = l.bitwiseXOR(F.xxhash64(h, F.lit(i), *key).bitwiseAND(low))
            else:
                h = h.bitwiseXOR(F.xxhash64(l, F.lit(i), *key).bitwiseAND(high))
            return F.struct(l.alias("l"), h.alias("h"))

        return mixed

    def network(x: Column) -> Column:
        # the low and high part in a struct, each mixed by the other in turn
        halves = F.struct(x.bitwiseAND(low).alias("l"), F.call_function("shiftrightunsigned", x, low_bits).alias("h"))
        for i in range(FEISTEL_ROUNDS):
            halves = F.transform(F.array(halves), turn(i))[0]
        return F.transform(F.array(halves), lambda p: F.call_function("shiftleft", p["h"], low_bits).bitwiseOR(p["l"]))[0]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(index), lambda x, _: F.when(x < size, x).otherwise(network(x)))
    return F.when(size <= 1, F.lit(0).cast("long")).when(walked < size, walked).otherwise(F.raise_error(F.lit("the permutation did not return")).cast("long"))


def _listed(rows: DataFrame, count: Column, name: str, total: int | None = None) -> DataFrame:
    """A row for each of ``0 .. count - 1``, in steps, so that no array is long.

    With ``total``, the number of rows to come, the steps are dealt to as many
    tasks as the rows need; by their own few bytes they would all go to one.
    """
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / ROWS_PER_STEP)))
    steps = rows.where(count > 0).withColumn("_step", step).withColumn("_at", F.col("_step") * ROWS_PER_STEP)
    if total is not None:
        steps = steps.repartition(max(1, total // ROWS_PER_TASK), *(c for c in ("rank", "shard") if c in rows.columns), "_step")
    return steps.withColumn(name, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + ROWS_PER_STEP, count) - 1))).drop("_step", "_at")


def shard_draws(targets: DataFrame, block: int = BLOCK, seed: str = "mix", slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``shard, source, n, first`` and the source's ``rank, source_size, wanted, full, rest, per_pass``.

    ``n`` is the number of the source's slots that the shard draws, and
    ``first`` the number of its first slot. Each of a source's slots falls into
    a shard by a hash, all shards alike, so the counts are multinomial.
    """
    b = F.lit(block)
    t = targets.where("source_size > 0 and target >= 0.5").select(
        "source", "rank", "source_size", F.floor(F.col("target") + 0.5).alias("wanted"), F.floor(F.col("source_size") / b).alias("full"), (F.col("source_size") % b).alias("rest"),
    )
    t = t.withColumn("per_pass", F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).withColumn("passes", F.floor((F.col("wanted") - 1) / F.col("source_size")))
    left = F.col("wanted") - F.col("passes") * F.col("source_size")
    t = t.withColumn("n_slots", F.col("passes") * F.col("per_pass") + F.ceil(left / b)).drop("passes")
    total = t.agg(F.sum("n_slots")).first()[0] or 0
    shards = max(1, -(-total // slots_per_shard))
    drawn = _listed(t.select("rank", "n_slots"), F.col("n_slots"), "_slot", total).select("rank", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "rank", "_slot"), F.lit(shards)).cast("int").alias("shard"))
    counts = materialise(drawn.groupBy("rank", "shard").agg(F.count("*").alias("n")))
    first = F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")
    return counts.withColumn("first", first).join(t, "rank")


def slots(targets: DataFrame, block: int = BLOCK, seed: str = "mix", slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """``source, shard, slot, pass, block, words``: the mix, one row per block taken.

    ``words`` is how many of the block's first words are taken: all, but for
    the last slot of a source, which stops at the target.
    """
    b = F.lit(block)
    draws = materialise(shard_draws(targets, block, seed, slots_per_shard))
    total = draws.agg(F.sum("n")).first()[0] or 0
    listed = _listed(draws, F.col("n"), "_i", total).withColumn("slot", F.col("first") + F.col("_i"))
    number, in_pass = F.floor(F.col("slot") / F.col("per_pass")), F.col("slot") % F.col("per_pass")
    listed = listed.withColumns({"pass": number.cast("long"), "_in": in_pass})
    is_full = F.col("_in") < F.col("full")
    before = F.col("pass") * F.col("source_size") + F.col("_in") * b
    at = F.when(is_full, permute(F.col("_in"), F.col("full"), F.lit(seed), F.col("rank"), F.col("pass"))).otherwise(F.col("full"))
    taken = F.least(F.when(is_full, b).otherwise(F.col("rest")), F.col("wanted") - before)
    return listed.select("source", "shard", "slot", F.col("pass").cast("int").alias("pass"), at.cast("long").alias("block"), taken.cast("long").alias("words"))


def pieces(streamed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents cut at the block boundaries: ``id, h, occ, source, block, from_word, begin, end``.

    ``begin`` and ``end`` count words within the block; ``from_word`` is where
    the piece starts in its document.
    """
    b = F.lit(block)
    first, last = F.floor(F.col("low") / b), F.floor((F.col("low") + F.col("size") - 1) / b)
    cut = streamed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("low") - F.col("block") * b, F.lit(0))
    end = F.least(F.col("low") + F.col("size") - F.col("block") * b, b)
    return cut.select("id", "h", "occ", "source", "block", F.greatest(F.col("block") * b - F.col("low"), F.lit(0)).alias("from_word"), begin.alias("begin"), end.alias("end"))


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per row of ``docs``: rows with equal id, source and text are told apart by ``occ``."""
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    counted = narrow.groupBy("id", "h", "source", "size").agg(F.count("*").alias("_n"))
    return materialise(_listed(counted, F.col("_n"), "occ").drop("_n"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_repeat, block, seed):
    units = _units(docs, id_col, text_col, source_col)
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, max_repeat))
    mix = slots(targets, block, seed).withColumnRenamed("source", "_src").withColumnRenamed("block", "_block")
    cut = pieces(stream(units, sizes), block)
    # blocks by index; no source and block holds more than block pieces, nor more than max_repeat slots.
    # The slots are listed from a small table and would be taken for small themselves, hence the hint.
    met = cut.join(mix.hint("merge"), F.col("source").eqNullSafe(F.col("_src")) & (F.col("block") == F.col("_block"))).where(F.col("begin") < F.col("words"))
    met = met.withColumn("taken", F.least("end", "words") - F.col("begin"))
    return units, targets, met


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """``id_col, size, source, source_size, target, taken, shards``: one row per row of ``docs``.

    A null text has the size 0 and is never taken; null sources are a source of
    their own. A source takes its target, rounded to a word, and no document
    more than ``max_repeat`` times its words; ``shards`` are the output shards
    that its words went to. Repeated rows are documents of
    their own. Where all sizes are 0, nothing is taken; an empty table gives no
    rows.
    """
    units, targets, met = _mixed(docs, id_col, text_col, source_col, weights, max_repeat, block, seed)
    taken = met.groupBy("id", "h", "source", "occ").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    taken = materialise(taken).toDF("_id", "_h", "_source", "_occ", "taken", "shards")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("occ") == F.col("_occ"))
    out = units.join(taken, same, "left")
    t = targets.select(F.col("source").alias("_t"), "source_size", "target")
    out = out.join(t, F.col("source").eqNullSafe(F.col("_t")), "left")
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for each pass that takes words of a document.

    A pass that takes all its words has the text as it is; one that takes part
    has the words taken, in their order and joined by spaces. ``n_chars``, where
    there is one, is counted anew. Documents without words aren't taken.
    """
    units, _, met = _mixed(docs, id_col, text_col, source_col, weights, max_repeat, block, seed)
    part = F.struct("from_word", "taken")
    turns = met.groupBy("id", "h", "source", "occ", "pass").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum("taken").alias("_taken"))
    i, h, src, parts, taken_col, own_h = (fresh(docs, x) for x in ("_id", "_h", "_source", "_parts", "_taken", "_hash"))
    turns = materialise(turns.select(F.col("id").alias(i), F.col("h").alias(h), F.col("source").alias(src), F.col("parts").alias(parts), F.col("_taken").alias(taken_col)))
    keyed = docs.withColumn(own_h, F.xxhash64(text_or_empty(text_col)))
    repeats = not units.where("occ > 1").isEmpty()
    distinct = keyed.dropDuplicates([id_col, source_col, own_h]) if repeats else keyed
    joined = distinct.join(turns, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own_h) == F.col(h)) & F.col(source_col).eqNullSafe(F.col(src)))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    # in an array of one, so that the words are found once and not for each part
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(w, p["from_word"].cast("int") + 1, p["taken"].cast("int")))), " "))[0]
    text = F.when(F.col(taken_col) == n_words(F.col(text_col)), F.col(text_col)).otherwise(some)
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*docs.columns)


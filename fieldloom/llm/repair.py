"""Repair of conversations whose turns don't fit a grammar of roles.

The grammar's rules become shift and reduce tables. A generalised LR parser
reads the initials of a conversation's roles and may, at a cost, delete a turn,
give it another role or insert one. Its stacks share their lower parts in a
graph, and equal stacks are one node that keeps the least (cost, audit); the
audit is the string of the edits' initials. Cost follows from the audit's
letters, so of two audits of one node and cost none starts the other, and the
lesser one stays the lesser whatever is appended: merging loses no answer.

A conversation is parsed where its turns lie. The turns are ordered over all
partitions by conversation and turn, without their texts. A run of turns that
is cut by a partition's edge, or is longer than ``CHUNK``, is parsed from each
stack that the grammar can have, and the pieces are put together in order. So
no conversation has to fit into one task until its audit is one string.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import materialise

# A system turn may come first; then user and assistant take turns. Capitals are the grammar's own symbols.
RULES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = (("u", "user"), ("a", "assistant"))  # of those that may be inserted or given
FOLLOWS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
END = ""
CHUNK = 2048
MAX_STACKS = 1024

#: What a turn is: kept as it may be, only to be deleted (blank or seen before), cut off, or not there at all.
FINE, BLANK, SEEN, CUT, ABSENT = range(5)


class Stacks:
    """The LR tables of a grammar and the graph of the stacks met so far; node 0 is the empty stack."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = (("", rules[0][0]), *rules)
        self.heads = {head for head, _ in rules}
        self.terminals = sorted({x for _, body in rules for x in body} - self.heads)
        follow = self._follow()
        start = self._closed({(0, 0)})
        states, self.moves, self.reductions, self.accepting = {start: 0}, [], [], set()
        for state in (queue := [start]):  # grows while it is read
            moves: dict[str, int] = {}
            for x in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                to = self._closed({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == x})
                if to not in states:
                    states[to] = len(states)
                    queue.append(to)
                moves[x] = states[to]
            whole = [self.rules[r] for r, d in state if d == len(self.rules[r][1])]
            self.moves.append(moves)
            self.reductions.append([(head, len(body), follow[head]) for head, body in whole if head])
            if any(not head for head, _ in whole):
                self.accepting.add(states[state])
        self.nodes = [(0, 0)]  # state, node below
        self.known = {(0, 0): 0}
        self.memo: dict[tuple[int, str], tuple[int, ...]] = {}

    def _closed(self, items: set) -> frozenset:
        open_ = list(items)
        while open_:
            r, d = open_.pop()
            x = self.rules[r][1][d : d + 1]
            new = {(i, 0) for i, (head, _) in enumerate(self.rules) if x and head == x} - items
            items |= new
            open_ += new
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty: set[str] = set()
        while new := {h for h, body in self.rules if h and h not in empty and all(x in empty for x in body)}:
            empty |= new
        first = {x: {x} for x in self.terminals} | {h: set() for h in self.heads}
        follow: dict[str, set[str]] = {h: set() for h in self.heads}
        follow[self.rules[0][1]].add(END)
        before = -1
        while before != (before := sum(map(len, [*first.values(), *follow.values()]))):
            for head, body in self.rules:
                after = set(follow[head]) if head else {END}
                for x in reversed(body):
                    if x in self.heads:
                        follow[x] |= after
                    after = first[x] | (after if x in empty else set())
                if head:
                    for x in body:
                        first[head] |= first[x]
                        if x not in empty:
                            break
        return follow

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self.known:
            if len(self.nodes) >= MAX_STACKS:
                raise ValueError(f"the grammar nests: it has more than {MAX_STACKS} stacks")
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def after(self, node: int, symbol: str) -> tuple[int, ...]:
        """The stacks that ``node`` can become by ``symbol``; for ``END``, those that accept."""
        if (node, symbol) not in self.memo:
            out, seen, open_ = set(), {node}, [node]
            while open_:
                at = open_.pop()
                state = self.nodes[at][0]
                if symbol == END and state in self.accepting:
                    out.add(at)
                elif symbol != END and symbol in self.moves[state]:
                    out.add(self._node(self.moves[state][symbol], at))
                for head, n, follow in self.reductions[state]:
                    if symbol in follow:
                        base = at
                        for _ in range(n):
                            base = self.nodes[base][1]
                        to = self._node(self.moves[self.nodes[base][0]][head], base)
                        if to not in seen:
                            seen.add(to)
                            open_.append(to)
            self.memo[node, symbol] = tuple(sorted(out))
        return self.memo[node, symbol]

    def all(self) -> list[int]:
        """The stacks that any turns can leave behind."""
        found, open_ = {0}, [0]
        while open_:
            node = open_.pop()
            new = {to for x in self.terminals for to in self.after(node, x)} - found
            found |= new
            open_ += new
        return sorted(found)


class Repair:
    """Cheapest edits of a sequence of turns.

    ``heads`` are the stacks' tops with their least (cost, audit, given);
    ``given`` has the initials of the roles that Rerole and Insert gave.
    """

    def __init__(self, rules=RULES, roles=ROLES):
        self.stacks = Stacks(tuple(rules))
        self.given = [x for x, _ in roles if x in self.stacks.terminals]

    @staticmethod
    def _merge(heads: dict, nodes: tuple[int, ...], *label) -> list[int]:
        better = [n for n in nodes if n not in heads or label < heads[n]]
        for n in better:
            heads[n] = label
        return better

    def inserted(self, heads: dict) -> dict:
        out, open_ = dict(heads), list(heads)
        while open_:
            node = open_.pop()
            cost, audit, given = out[node]
            for x in self.given:
                open_ += self._merge(out, self.stacks.after(node, x), cost + INSERT, audit + "I", given + x)
        return out

    def turn(self, heads: dict, initial: str, kind: int) -> dict:
        out: dict = {}
        for node, (cost, audit, given) in self.inserted(heads).items():
            self._merge(out, (node,), cost + DELETE, audit + "D", given)
            if kind in (FINE, CUT):
                cost += TRUNCATED * (kind == CUT)
                self._merge(out, self.stacks.after(node, initial) if initial else (), cost, audit + "K", given)
                for x in self.given:
                    self._merge(out, self.stacks.after(node, x), cost + REROLE, audit + "R", given + x)
        return out

    def run(self, start: int, turns) -> dict:
        heads = {start: (0, "", "")}
        for initial, kind in turns:
            heads = self.turn(heads, initial, kind)
        return heads

    def join(self, heads: dict, paths: dict[int, dict]) -> dict:
        """``heads`` followed by a piece that was parsed from each stack."""
        out: dict = {}
        for node, (cost, audit, given) in heads.items():
            for to, (more, edits, roles) in paths[node].items():
                self._merge(out, (to,), cost + more, audit + edits, given + roles)
        return out

    def end(self, heads: dict) -> tuple[int, str, str]:
        return min(best for node, best in self.inserted(heads).items() if self.stacks.after(node, END))


PIECE = (
    "conv {conv}, part int, number int, closed boolean, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, first_turn long, last_turn long, turns long, paths array<struct<start:int,end:int,cost:long,audit:string,given:string>>"
)
PATH = ("start", "end", "cost", "audit", "given")
AUDIT = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, given string"


def _pieces(rules, roles):
    """From ordered ``conv, turn, initial, kind``: one row for each run of a conversation's turns, cut at ``CHUNK`` turns."""

    def parse(batches):
        repair = Repair(rules, roles)
        starts = repair.stacks.all()

        @functools.lru_cache(20_000)
        def paths(turns: tuple, closed: bool):
            if closed:
                return [dict(zip(PATH, (0, 0, *repair.end(repair.run(0, turns))), strict=True))]
            return [dict(zip(PATH, (a, b, *best), strict=True)) for a in starts for b, best in repair.run(a, turns).items()]

        part, number = TaskContext.get().partitionId(), 0

        def piece(conv, run: list, closed: bool) -> dict:
            nonlocal number
            number += 1
            there = [(x, k) for _, x, k in run if k != ABSENT]
            said = [t for t, _, k in run if k != ABSENT and t is not None]
            count = [sum(k == kind for _, k in there) for kind in (BLANK, SEEN, CUT)]
            return {
                "conv": conv, "part": part, "number": number, "closed": closed, "blank": count[0], "duplicate": count[1], "truncated": count[2],
                "illegal": sum(x + y not in FOLLOWS for (x, _), (y, _) in zip(there, there[1:], strict=False)),
                "first": there[0][0] if there else None, "last": there[-1][0] if there else None,
                "first_turn": said[0] if said else None, "last_turn": said[-1] if said else None, "turns": len(set(said)), "paths": paths(tuple(there), closed),
            }

        # a conversation is whole here if another one comes before it and after it in this partition
        now, run, whole, out, schema = None, [], False, [], None
        for b in batches:
            schema = schema or _arrow_piece(b.schema.field("conv").type)
            for conv, turn, initial, kind in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "initial", "kind")), strict=True):
                if run and conv != now:
                    out.append(piece(now, run, whole))
                    run, whole = [], True
                elif len(run) >= CHUNK:
                    out.append(piece(now, run, False))
                    run, whole = [], False
                now = conv
                run.append((turn, initial, kind))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if run:
            out.append(piece(now, run, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return parse


def _arrow_piece(conv: pa.DataType) -> pa.Schema:
    path = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("given", pa.string())]))
    kinds = {"conv": conv, "part": pa.int32(), "number": pa.int32(), "closed": pa.bool_(), "first": pa.string(), "last": pa.string(), "paths": path}
    names = ("conv", "part", "number", "closed", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns", "paths")
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in names])


def _joined(rules, roles):
    """From pieces in order: one row for each conversation."""

    def join(batches):
        repair = Repair(rules, roles)
        repair.stacks.all()  # numbers the stacks as the pieces' tasks did
        now, open_, out, schema = None, None, [], None

        def done():
            cost, audit, given = repair.end(open_["heads"])
            low, high = open_["low"], open_["last_turn"]
            gaps = 0 if low is None else high - low + 1 - open_["turns"]
            return {"conv": now, "gaps": gaps, **{k: open_[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "given": given}

        for b in batches:
            schema = schema or pa.schema([("conv", b.schema.field("conv").type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("given", pa.string())])
            for x in b.to_pylist():
                if open_ is None or x["conv"] != now:
                    if open_ is not None:
                        out.append(done())
                    now, open_ = x["conv"], {"heads": {0: (0, "", "")}, "low": None, "last": None, "last_turn": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                paths: dict[int, dict] = {}
                for p in x["paths"]:
                    paths.setdefault(p["start"], {})[p["end"]] = (p["cost"], p["audit"], p["given"])
                open_["heads"] = repair.join(open_["heads"], paths)
                for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    open_[k] += x[k]
                if x["first"] is not None:
                    open_["illegal"] += open_["last"] is not None and open_["last"] + x["first"] not in FOLLOWS
                    open_["last"] = x["last"]
                if x["first_turn"] is not None:
                    open_["turns"] -= open_["last_turn"] == x["first_turn"]
                    open_["low"] = x["first_turn"] if open_["low"] is None else open_["low"]
                    open_["last_turn"] = x["last_turn"]
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if open_ is not None:
            out.append(done())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return join


ORDER = ("turn", "role", "said")  # of a conversation's turns, nulls first; said is a digest of role and text


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column) -> DataFrame:
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    out = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("there"))
    return out.withColumn("said", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))))


def _kinds(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, said, initial, kind`` of the turns, without their texts."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(~F.col("there"), ABSENT).when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    narrow = materialise(rows.select("conv", "turn", "role", "said", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("n")))
    # equal turns of a conversation: all but the first of them were seen before
    again = narrow.where(F.col("fault") != ABSENT).groupBy("conv", "said").agg(F.min(F.struct("turn", "n")).alias("f"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), F.col("f.n").alias("first"))
    met = narrow.hint("merge").join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    repeats = F.col("first").isNotNull() & (F.col("first") != F.col("n")) & F.col("fault").isin(FINE, CUT)
    return met.select("conv", "turn", "role", "said", "n", "initial", F.when(repeats, SEEN).otherwise(F.col("fault")).alias("kind"))


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, rules=RULES, roles=ROLES) -> DataFrame:
    """``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, given``: one row for each conversation.

    Null ids are one conversation. Turns come in the order of their numbers,
    nulls first and those of one number by role and digest of the text; a null
    role or text is one space. A turn without other than blanks is ``blank``, one whose
    role and text came before is a ``duplicate``, one that doesn't end in
    ``.``, ``!`` or ``?`` is ``truncated``; the first of these counts. ``gaps``
    are missing numbers between the least and the greatest, and ``illegal``
    counts neighbours whose roles may not follow each other.

    ``audit`` has the initials of the cheapest edits that make the roles a
    sentence of ``rules``: Keep, Delete (3; the only one for blank turns and
    duplicates), Rerole (2), Insert (2), and 1 for a truncated turn that stays;
    of equal costs the ASCII-least. ``given`` has the initials of the roles that
    were given by Rerole and Insert, in order. Turns that aren't ``present`` count for
    nothing but keep their conversation in the result; one without other turns
    has zeros and an empty audit. A grammar that nests without end is a ValueError.
    """
    Repair(rules, roles).stacks.all()  # fails here and not in a task
    rows = _turns(turns, conv_col, turn_col, role_col, text_col, F.lit(True) if present is None else present)
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", *ORDER, "n"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(_kinds(rows)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = materialise(placed.mapInArrow(_pieces(rules, roles), PIECE.format(conv=kind)))
    closed = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    whole = pieces.where("closed").select("conv", closed.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit"), F.col("paths")[0]["given"].alias("given"))
    rest = pieces.where("not closed").repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_joined(rules, roles), AUDIT.format(conv=kind))
    return whole.union(rest).withColumnRenamed("conv", conv_col)


def _applied(roles):
    """From turns in order, each conversation's audit before them: the repaired turns."""
    named = dict(roles)

    def apply(batches):
        now, audit, given, at, gave, place = None, "", "", 0, 0, 0
        for b in batches:
            out = {k: [] for k in ("conv", "place", "turn", "role", "text", "edit")}

            def say(edit: str, turn, role: str | None, text: bytes):
                nonlocal place, gave, at
                at += 1
                if edit != "K":
                    role = named[given[gave]]
                    gave += 1
                for k, v in zip(out, (now, place, turn, role, text, edit), strict=True):
                    out[k].append(v)
                place += 1

            for conv, own, roles_given, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "audit", "given", "turn", "role", "text")), strict=True):
                if own is not None:
                    now, audit, given, at, gave, place = conv, own, roles_given, 0, 0, 0
                elif audit[at] == "D":
                    at += 1
                else:
                    say(audit[at], turn, role, text)
                while at < len(audit) and audit[at] == "I":
                    say("I", None, None, b"")
            types = (b.schema.field("conv").type, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return apply


def repaired(turns: DataFrame, audited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, roles=ROLES) -> DataFrame:
    """``conv_col, place, turn, role, text, edit``: the turns that :func:`audits` lets stay, and those that it inserts.

    ``place`` counts from 0 in each conversation; ``edit`` is Keep, Rerole or
    Insert by its initial; an inserted turn has no number and an empty text.
    A conversation passes through a task as a stream, in order, and is never held whole.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col, F.lit(True) if present is None else present).where("there")
    none = F.lit(None).cast("string")
    said = rows.select("conv", F.lit(1).alias("kind"), *ORDER, F.col("text").cast("binary").alias("text"), none.alias("audit"), none.alias("given"))
    first = audited.select(F.col(f"`{conv_col}`").alias("conv"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.cast("binary").alias("said"), none.cast("binary").alias("text"), "audit", "given")
    order = ["conv", "kind", *ORDER]
    kind = rows.schema["conv"].dataType.simpleString()
    made = said.union(first).repartition("conv").sortWithinPartitions(*order).mapInArrow(_applied(roles), f"conv {kind}, place long, turn long, role string, text binary, edit string")
    return made.withColumn("text", F.col("text").cast("string")).withColumnRenamed("conv", conv_col)


def digests(repaired_turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, repaired_sha256``: of ``role:text`` of the turns of :func:`repaired`, joined by newlines, in their order there."""

    def digest(batches):
        now, sha, some = None, None, False
        for b in batches:
            ids, out = [], []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not some or conv != now:
                    if some:
                        ids.append(now), out.append(sha.hexdigest())
                    now, sha, some = conv, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(role.encode("utf-8", "replace") + b":" + text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.string())], ["conv", "repaired_sha256"])
            kind = b.schema.field(0).type
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([sha.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    kind = repaired_turns.schema[conv_col].dataType.simpleString()
    bare = repaired_turns.select(conv_col, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")).cast("binary"))
    return bare.mapInArrow(digest, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: ``conversations`` with hashed faults; a dropped turn isn't present.

    By ``crc32("conv_id:turn") % 20``: 0 drops the turn, 1 empties its text, 2
    removes ``[.!?]``, 3 repeats it, 4 gives it to the user. Nulls are one space first.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault"))
    out = out.withColumn("text", F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))).withColumn("present", F.col("_fault") != 0)
    return out.withColumn("_i", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", "present")

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """All edit sequences of few turns: the least (cost, audit) that gives ``(s?(ua)+)?``."""
    best = None
    n = len(turns)
    for letters in itertools.product("KRD", repeat=n):
        for inserts in itertools.product(range(4), repeat=n + 1):
            cost, audit, gaps = 0, "", []
            for i in range(n + 1):
                audit += "I" * inserts[i]
                cost += 2 * inserts[i]
                gaps += [None] * inserts[i]
                if i < n:
                    initial, kind = turns[i]
                    audit += letters[i]
                    if letters[i] == "D":
                        cost += 3
                    else:
                        if kind in (repair.BLANK, repair.SEEN):
                            cost = 10**9
                        cost += (2 if letters[i] == "R" else 0) + (kind == repair.CUT)
                        gaps.append(initial if letters[i] == "K" else None)
            if best is not None and (cost, audit) >= best:
                continue
            m = len(gaps)
            want = "ua" * (m // 2) if m % 2 == 0 else "s" + "ua" * (m // 2)
            if m == 1 or any(g is not None and g != w for g, w in zip(gaps, want, strict=True)) or (m % 2 and gaps[0] is None):
                continue
            best = (cost, audit)
    return best


def chain(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """A plain table over the three states of ``(s?(ua)+)?`` and whether a pair is whole; for sequences of any length."""
    # 0 nothing yet, 1 after s, 2 after a whole pair, 3 within a pair
    step = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (3, "a"): 2, (2, "u"): 3}

    def closed(heads):
        for _ in range(6):
            for state, (cost, audit) in list(heads.items()):
                for x in "ua":
                    to = step.get((state, x))
                    if to is not None and (cost + 2, audit + "I") < heads.get(to, (10**9, "")):
                        heads[to] = (cost + 2, audit + "I")
        return heads

    heads = {0: (0, "")}
    for initial, kind in turns:
        new: dict = {}
        for state, (cost, audit) in closed(heads).items():
            options = [(state, cost + 3, audit + "D")]
            if kind in (repair.FINE, repair.CUT):
                more = cost + (kind == repair.CUT)
                options += [(step.get((state, initial)), more, audit + "K"), *((step.get((state, x)), more + 2, audit + "R") for x in "ua")]
            for to, c, a in options:
                if to is not None and (c, a) < new.get(to, (10**9, "")):
                    new[to] = (c, a)
        heads = new
    return min(v for k, v in closed(heads).items() if k in (0, 2))


def by_hand(rows: list[tuple]) -> dict:
    """The contract of the registered query in plain Python."""
    made: dict = {}
    for conv, turn, role, text in rows:
        made.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        made[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, turns in made.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        seen, kinds = set(), []
        for _, role, text in turns:
            bare = BLANK.findall(text)
            kinds.append(repair.BLANK if not bare else repair.SEEN if (role, text) in seen else repair.CUT if bare[-1] not in ".!?" else repair.FINE)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = chain(list(zip(initials, kinds, strict=True)))
        m = len(audit) - audit.count("D")
        want = iter("ua" * (m // 2) if m % 2 == 0 else "s" + "ua" * (m // 2))
        said, left = [], iter(turns)
        for letter in audit:
            if letter == "I":
                said.append({"u": "user", "a": "assistant"}[next(want)] + ":")
                continue
            _, role, text = next(left)
            if letter != "D":
                x = next(want)
                said.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[x]}:{text}")
        numbers = [t for t, _, _ in turns if t is not None]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, kinds.count(repair.BLANK), kinds.count(repair.SEEN), kinds.count(repair.CUT),
            sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_table_agrees_with_all_edit_sequences():
    rng = random.Random(1)
    for _ in range(60):
        turns = [(rng.choice("suat"), rng.choice((repair.FINE, repair.FINE, repair.CUT, repair.BLANK))) for _ in range(rng.randrange(5))]
        assert chain(turns) == cheapest(turns), turns


def test_parser_agrees_with_the_table_whole_and_in_pieces():
    rng, whole = random.Random(2), repair.Repair()
    for n in (*range(9), *[30] * 40, 300):
        turns = [(rng.choice(("s", "u", "u", "a", "a", "t", "", " ")), rng.choice((repair.FINE,) * 4 + (repair.CUT, repair.SEEN, repair.BLANK))) for _ in range(n)]
        assert whole.end(whole.run(0, turns))[:2] == chain(turns)
        heads, starts = {0: (0, "", "")}, whole.stacks.all()
        for i in range(0, n, 7):
            heads = whole.join(heads, {s: whole.run(s, turns[i : i + 7]) for s in starts})
        assert whole.end(heads) == whole.end(whole.run(0, turns))


def test_other_grammars():
    tools = repair.Repair((("C", "X"), ("X", ""), ("X", "Xua"), ("X", "Xuta")), (("u", "user"), ("a", "assistant"), ("t", "tool")))
    assert tools.end(tools.run(0, [("u", 0), ("t", 0), ("a", 0)])) == (0, "KKK", "")
    assert tools.end(tools.run(0, [("u", 0), ("t", 0)])) == (2, "KKI", "a")
    ambiguous = repair.Repair((("C", ""), ("C", "X"), ("X", "XX"), ("X", "ua")))
    with pytest.raises(ValueError):
        ambiguous.stacks.all()
    with pytest.raises(ValueError):
        repair.Repair((("C", "ua"), ("C", "uCa"))).stacks.all()


def rows() -> list[tuple]:
    rng = random.Random(3)
    roles = ("system", "user", "assistant", "user", "assistant", "tool", None, "", "Sam")
    texts = ("Yes.", "No", "Why?", None, "", " \t\n", "Well!", "end. \x0b", "ünï", "a", "b.", "c.", "d.", "e.")
    out = [(c, t, rng.choice(roles[:5] if c % 2 else roles), rng.choice(texts) if t % 3 else f"{c} and {t}.") for c in range(150) for t in range(rng.randrange(9))]
    out += [(200, None, "user", "one."), (200, None, "assistant", "two."), (200, 7, "user", "x"), (200, -4, "user", "x"), (None, 1, "user", "y."), (None, 2, "assistant", "z."), (None, None, None, None)]
    out += [(300, t, "user" if t % 2 else "assistant", f"{t} {'long ' * 2000}.") for t in range(40)] + [(301, 0, "user", "same."), (301, 0, "user", "same.")]
    return out + [(400, t, rng.choice(roles), f"{rng.randrange(3000)}.") for t in range(6000)]


def test_query_agrees_with_brute_force(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, SCHEMA).withColumn("audit", F.lit("taken")).withColumn("conv", F.lit(0)).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair(spark, str(tmp_path)).collect()}
    assert found == by_hand(given)


def test_repaired_turns_fit_the_grammar_and_keep_texts(spark):
    turns = repair.damaged(spark.createDataFrame(rows(), SCHEMA))
    found = repair.audits(turns, present=F.col("present"))
    for r in repair.repaired(turns, found, present=F.col("present")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "edit", "text"))).alias("t")).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["t"]))
        assert [t["place"] for t in r["t"]] == list(range(len(r["t"])))
        assert all((t["text"] == "") == (t["edit"] == "I") for t in r["t"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_repair(spark, str(tmp_path)).collect() == []

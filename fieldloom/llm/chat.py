"""Chat formatting with column expressions only.

A template names, for each role, the text before and after a turn, whether its
text is trained on, and which roles may follow. A finite-state machine over the
roles (a lookup of state and role in a map, folded over the turns) checks their
order. The output is the formatted text in segments with a loss flag each.
Control strings of the template inside texts are escaped, and :func:`parse_formatted`
reads everything back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    # state and role that comes -> next state; a pair that is missing is an error
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    final: tuple[str, ...] = ("assistant",)


def _escapes(template: Template) -> tuple[str, list[tuple[str, str]]]:
    """The escape character, and what stands for each string that a text may not hold.

    A text without the first two characters of the start and end strings can't
    hold them; one character is used where the second could come from what
    follows the text. A role may not hold the first character of what follows
    it. The escape character and its codes occur in none of these.
    """
    start, after, end = template.start, template.after_role, template.end
    if not start or not after or not end:
        raise ValueError("a template needs strings before a turn, after the role and after the turn")
    if (end + start).find(start) != len(end) or after[0] in start or start[0] in after:
        raise ValueError("the strings of the template can't be told apart")
    banned = []
    for mark in (start, end):
        short = len(mark) == 1 or mark[1] == end[0] or mark[0] == mark[1]
        banned.append(mark[:1] if short else mark[:2])
    banned = [*dict.fromkeys(p for p in banned if len(p) == 1 or p[0] not in banned), after[0]]
    used = {c for p in (*banned, start, after, end) for c in p}
    free = [c for c in "&\\^~%$0123456789abcdefghijk" if c not in used]
    sign, codes = free[0], [c for c in free[1:] if c.isalnum()]
    return sign, [(sign, sign + codes[0]), *((p, sign + c) for p, c in zip(banned, codes[1:], strict=False))]


def escape(text: Column, template: Template = Template(), role: bool = False) -> Column:
    """``text`` without control strings of the template; reversible by :func:`unescape`."""
    pairs = _escapes(template)[1]
    for plain, coded in pairs if role else pairs[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, template: Template = Template()) -> Column:
    for plain, coded in reversed(_escapes(template)[1]):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col, segments, formatted, n_turns, valid, first_error``, one row per conversation.

    Turns go by number (nulls first), then role, then text; repeated rows are
    turns of their own, and null conversation ids make one conversation. Other
    columns are left out. A null
    text counts as empty, a null role as the role of no name. ``segments`` is
    an array of (text, loss) whose texts make up ``formatted``; ``first_error``
    is the place of the first turn that may not follow (from 0), the number of
    turns if the conversation ends too early, and null if it is valid. A
    conversation of wrong order is formatted like any other.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(one)).alias("t"))
    after = F.create_map(*(F.lit(x) for (state, role), to in sorted(template.moves.items()) for x in (f"{state}\x00{role}", to)))

    def step(acc: Column, turn: Column) -> Column:
        to = after[F.concat_ws("\x00", acc["state"], turn["role"])]
        ok = acc["error"].isNull() & to.isNotNull()
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(ok, F.lit(None).cast("int")).otherwise(F.coalesce(acc["error"], acc["at"])).alias("error"),
        )

    begin = F.struct(F.lit("begin").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))
    ended = F.aggregate("t", begin, step, lambda a: F.coalesce(a["error"], F.when(~a["state"].isin(*template.final), a["at"])))

    def segments(turn: Column) -> Column:
        loss = turn["role"].isin(*template.trained) if template.trained else F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(template.start), escape(turn["role"], template, role=True), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(turn["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    out = talks.select(conv_col, F.flatten(F.transform("t", segments)).alias("segments"), F.size("t").cast("long").alias("n_turns"), ended.alias("first_error"))
    return out.select(conv_col, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns", F.col("first_error").isNull().alias("valid"), "first_error")


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.slice(F.split(formatted, r"\Q" + template.start + r"\E"), 2, 1 << 30)

    def turn(block: Column) -> Column:
        cut = F.locate(template.after_role, block)
        role = F.substring(block, F.lit(1), cut - 1)
        text = F.substring(block, cut + len(template.after_role), F.char_length(block) - cut - (len(template.after_role) - 1) - len(template.end))
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.transform(blocks, turn)


def loss_mask(segments: Column) -> Column:
    """For each turn whether its text is trained on."""
    return F.transform(F.filter(segments, lambda s, i: i % 3 == 1), lambda s: s["loss"])


def loss_texts(turns: Column, mask: Column) -> Column:
    """The texts under the loss mask, in order, of the turns that :func:`parse_formatted` reads back."""
    return F.transform(F.filter(F.arrays_zip(turns.alias("turn"), mask.alias("loss")), lambda x: x["loss"]), lambda x: x["turn"]["text"])

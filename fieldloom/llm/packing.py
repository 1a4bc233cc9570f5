"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's tokens are cut into full sequences and a rest. The rests of about
``group_tokens`` tokens are packed together, in descending length: each goes to
the sequence of the lowest estimated cost (linear in tokens plus quadratic in
each piece, as attention within a piece is) that has room for it. The number of
sequences is the least that can hold the group, so a rest that no sequence can
hold is cut over the emptiest ones at the end and a group wastes less than one sequence.

Each task packs its own rows as they come, with one group in memory; nothing is
shuffled. Sequence numbers join the number of the partition and a count.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.tables import long_id, text_or_empty

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 1 << 21
END = 1
CACHE = 100_000
LONG = 50_000

# White space as the vocabulary's pattern sees it, and letters and numbers up to U+02C1 (fixed values)
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'(?:[sdmt]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WS}{_LETTER}{_NUMBER}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BEYOND = re.compile("[^\\x00-\u02c1]")


class ByteBpe:
    """Token ids of texts as little-endian 32-bit integers.

    The ids are those of the byte-level BPE vocabulary at ``path`` (a
    ``tokenizers`` file whose ranks stand beside it as ``.tiktoken``), as
    ``tokenizers`` gives them with ``add_special_tokens=False``: strings of added
    tokens become their ids. Texts in Latin script are cut into pretokens here,
    and pretokens seen before are looked up.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        from tokenizers import Tokenizer

        with Path(path).with_suffix(".tiktoken").open("rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes:
            # tiktoken's pattern gives up on a long run of blanks
            ids = self.encoding.encode_ordinary(text) if len(text) < LONG else whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = encode(piece)
                if len(piece) < LONG:
                    self[piece] = ids
                return ids

        self.known, self.encode_any = Known(), encode

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(t in text for t in self.added):
            return self.encode_plain(text)
        parts = [p for p in self.cut.split(text) if p]
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self.encode_plain(p) for p in parts)

    def encode_plain(self, text: str) -> bytes:
        """``text`` without the strings of added tokens."""
        if _BEYOND.search(text):
            return self.encode_any(text)
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, _LATIN.findall(text)))


def cost(length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[int, list[list[tuple[int, int]]]]:
    """Sequences used, and the pieces of each item in order as (sequence, length).

    Items are placed in descending length, ties in the given order, each in the
    sequence of the lowest cost (ties: the first) of all that have room. An item
    that none can hold is cut when all others are placed. ``best`` is a segment
    tree over remaining room, whose leaves are heaps by cost.
    """
    n = -(-sum(lengths) // capacity)
    room = [capacity] * n
    none = (math.inf, -1)
    leaves: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    leaves[capacity] = [(0.0, i) for i in range(n)]
    best = [none] * (2 * capacity + 2)

    def renew(r: int) -> None:
        at = r + capacity + 1
        best[at] = leaves[r][0] if leaves[r] else none
        while at > 1:
            at >>= 1
            best[at] = min(best[2 * at], best[2 * at + 1])

    def cheapest(size: int) -> tuple[float, int]:
        found, low, high = none, size + capacity + 1, 2 * capacity + 2
        while low < high:
            if low & 1:
                found = min(found, best[low])
                low += 1
            if high & 1:
                high -= 1
                found = min(found, best[high])
            low >>= 1
            high >>= 1
        return found

    renew(capacity)
    out: list[list[tuple[int, int]]] = [[] for _ in lengths]
    spill = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        c, i = cheapest(size)
        if i < 0:
            spill.append(item)
            continue
        heapq.heappop(leaves[room[i]])
        renew(room[i])
        room[i] -= size
        out[item].append((i, size))
        heapq.heappush(leaves[room[i]], (c + cost(size, linear, quadratic), i))
        renew(room[i])
    # room only shrinks, so what found none finds none now: cut over the emptiest, the end placed where it fits closest
    by_room = sorted((r, i) for i, r in enumerate(room) if r)
    for item in spill:
        left = lengths[item]
        at = bisect.bisect_left(by_room, (left, -1))
        while left:
            r, i = by_room.pop(at) if at < len(by_room) else by_room.pop()
            take = min(left, r)
            out[item].append((i, take))
            left -= take
            if r > take:
                bisect.insort(by_room, (r - take, i))
            at = bisect.bisect_left(by_room, (left, -1))
    return n, out


def _pack_group(docs: list[tuple], capacity: int, linear: float, quadratic: float) -> tuple[int, list[tuple]]:
    """``docs``: (id, bytes of ids). Returns the sequences used and the pieces (id, start, length, bytes, tokens, sequence, offset)."""
    used, pieces, rests, whose = 0, [], [], []
    for k, (_, ids) in enumerate(docs):
        n = len(ids) // 4
        for start in range(0, n - n % capacity, capacity):
            pieces.append((k, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rests.append(n % capacity)
            whose.append((k, n - n % capacity))
    n, places = assign(rests, capacity, linear, quadratic)
    filled = [0] * n
    for (k, start), placed in zip(whose, places, strict=True):
        for sequence, length in placed:
            pieces.append((k, start, length, used + sequence, filled[sequence]))
            filled[sequence] += length
            start += length
    return used + n, [(docs[k][0], start, length, docs[k][1][4 * start : 4 * (start + length)], len(docs[k][1]) // 4, s, offset) for k, start, length, s, offset in pieces]


SCHEMA = pa.schema([("_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
    end: int | None = END,
) -> DataFrame:
    """``id_col, start, length, ids, doc_tokens, sequence_id, offset``: one row per piece.

    ``ids`` is the piece's tokens as little-endian 32-bit integers; ``end`` is
    appended to each document. Null texts count as empty and yield the end
    token alone. Repeated rows are packed each on their own; null ids stay
    null. An empty table gives no rows.
    """

    def run(batches):
        bpe = ByteBpe(tokenizer_path)
        tail = b"" if end is None else end.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 32
        group: list[tuple] = []
        held = 0

        def flush():
            nonlocal first, group, held
            used, pieces = _pack_group(group, capacity, linear, quadratic)
            for i in range(0, len(pieces), 1000):
                cols = list(zip(*pieces[i : i + 1000], strict=True))
                cols[5] = [first + s for s in cols[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)
            first, group, held = first + used, [], 0

        for b in (c.slice(i, 200) for c in batches for i in range(0, c.num_rows, 200)):  # few texts as Python strings at once
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text) + tail
                group.append((id_, ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from flush()
        if group:
            yield from flush()

    rows = docs.select(long_id(docs, id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = "_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)

"""Sequence packing: shortest-pack-first over the length histogram.

1. Tasks encode the documents; a document gives whole pieces of ``size`` ids and one rest.
2. Only the histogram of lengths (at most ``size`` rows) reaches the driver. Lengths are
   placed longest first, each into the packs with most room; what is kept are patterns of
   lengths with counts, so the work there does not depend on the number of documents. The
   emptiest packs are then dissolved and cut into the room left in the others.
3. Each rest gets its rank among the rests of its length by prefix sums over (length, input
   partition), and a pattern slot by binary search in the slot table, whose size is bounded
   by the pattern count.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, record_batch
from .tokens import MOST_MEMO, encoder

SLOT_FIELDS = ("length", "rank", "count", "sub_start", "sub_length", "sequence", "offset")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass
class Plan:
    """slots: one row per (length, range of ranks, part of the rest); sequences: how many."""

    slots: dict[str, np.ndarray]
    sequences: int
    padding: int


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, int, tuple]]:
    """Patterns as (room, count, items); items is a linked list of (length, times)."""
    by_room: dict[int, list] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:
                times = size // length
                for count, each in ((left // times, times), (1, left % times)):
                    if count and each:
                        by_room.setdefault(size - each * length, []).append((count, ((length, each), None)))
                break
            count, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            used = min(count, left)
            if used < count:
                by_room.setdefault(room, []).append((count - used, items))
            by_room.setdefault(room - length, []).append((used, ((length, 1), items)))
            left -= used
    return [(room, count, items) for room, group in by_room.items() for count, items in group]


def same_ranges(rows: list[tuple]) -> list[tuple]:
    """Split rows where ranges of ranks of one length overlap in part, so that those which
    share a rank share their whole range."""
    cuts: dict[int, set] = {}
    for length, rank, count, *_ in rows:
        cuts.setdefault(length, set()).update((rank, rank + count))
    ordered = {length: sorted(c) for length, c in cuts.items()}
    out = []
    for length, rank, count, sub, part, sequence, at in rows:
        own = ordered[length]
        a, z = bisect_left(own, rank), bisect_left(own, rank + count)
        out += [(length, x, y - x, sub, part, sequence + x - rank, at) for x, y in zip(own[a:z], own[a + 1 : z + 1])]
    return out


def plan_packs(histogram: dict[int, int], size: int) -> Plan:
    """Slots for every rest, after the emptiest packs were cut up into the others' room."""
    patterns = sorted(shortest_pack_first(histogram, size), key=lambda p: p[0])
    room, content = sum(r * c for r, c, _ in patterns), 0
    loose: list[list[int]] = []  # [length, count]
    while patterns:
        r, c, items = patterns[-1]
        # dissolve k packs while what they hold fits into the room of those that stay
        k = min(c, (room - content) // size)
        if k <= 0:
            break
        room, content = room - k * r, content + k * (size - r)
        node = items
        while node:
            (length, times), node = node
            loose.append([length, times * k])
        patterns.pop()
        if k < c:
            patterns.append((r, c - k, items))
            break
    cursor: dict[int, int] = {}
    rows: list[tuple] = []
    base, gaps = 0, []
    for r, count, items in patterns:
        at, node = 0, items
        while node:
            (length, times), node = node
            for _ in range(times):
                rank = cursor.get(length, 0)
                rows.append((length, rank, count, 0, length, base, at))
                cursor[length], at = rank + count, at + length
        if r:
            gaps.append([base, count, at])
        base += count
    stack = []
    for length, count in sorted(loose, reverse=True):
        rank = cursor.get(length, 0)
        stack.append([length, rank, count, 0])
        cursor[length] = rank + count
    gaps.reverse()
    gaps.sort(key=lambda g: size - g[2])  # largest room last, filled first
    while stack:
        length, rank, count, done = stack.pop()
        seq, packs, at = gaps.pop()
        n, part = min(count, packs), min(length - done, size - at)
        rows.append((length, rank, n, done, part, seq, at))
        if n < count:
            stack.append([length, rank + n, count - n, done])
        if done + part < length:
            stack.append([length, rank, n, done + part])
        if n < packs:
            gaps.append([seq + n, packs - n, at])
        if at + part < size:
            gaps.append([seq, n, at + part])
    padding = base * size - sum(length * n for length, n in histogram.items())
    table = np.array(sorted(same_ranges(rows)), np.int64).reshape(-1, len(SLOT_FIELDS))
    return Plan({f: table[:, i] for i, f in enumerate(SLOT_FIELDS)}, base, padding)


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", max_memo: int = MOST_MEMO) -> DataFrame:
    """Pack every document into sequences of at most ``size`` ids; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit). A null or empty
    text is just ``end_id``; rows that repeat an id, or have none, are documents of their
    own; an empty table gives no rows; other columns of ``df`` are ignored. ``max_memo`` bounds
    the pieces that a worker remembers, also after this.
    """
    spark = df.sparkSession
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("rest", pa.int64()), ("local", pa.int64()), ("whole_local", pa.int64()), ("ids", pa.binary())])

    def tokenize(batches):
        enc = encoder(tokenizer, max_memo)
        wide = np.dtype("<u4")
        narrow = enc.dtype if end_id is None or end_id < 1 << 8 * enc.dtype.itemsize else wide
        tail = b"" if end_id is None else int(end_id).to_bytes(narrow.itemsize, "little")
        part, seen, whole = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                own = (own if narrow == enc.dtype else np.frombuffer(own, enc.dtype).astype(narrow).tobytes()) + tail
                n = len(own) // narrow.itemsize
                if not n:
                    continue
                rest = n % size
                local = seen.get(rest, 0)
                seen[rest] = local + 1
                rows.append((part, doc, n, rest, local, whole, own))
                whole += n // size
            if rows:
                yield record_batch(schema, list(zip(*rows)))

    docs = materialise(
        id_text(df, id_col, text_col).mapInArrow(tokenize, "part long, doc_id long, tokens long, rest long, local long, whole_local long, ids binary"),
        "packing-ids",
    )
    counts = docs.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("tokens") / size)).cast("long").alias("whole"))
    counts = materialise(counts, "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packs(histogram, size)
    before = lambda *keys: Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before("rest")), F.lit(0)).alias("rank_base"))
    wholes = counts.groupBy("part").agg(F.sum("whole").alias("whole"))
    wholes = wholes.select("part", F.coalesce(F.sum("whole").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("whole_base"))
    ranked = docs.join(ranks.join(wholes, "part"), ["part", "rest"])
    slots, first = spark.sparkContext.broadcast(plan.slots), plan.sequences
    out_schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (x.split()[0] for x in PIECES.split(", "))])

    def place(batches):
        t = slots.value
        # rows are sorted by (length, first rank); ranks of a length are below 2**40
        keys = t["length"] << 40 | t["rank"]
        for batch in batches:
            rows = []
            for doc, tokens, rest, rank, whole, ids in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "tokens", "rest", "rank", "whole", "ids"))):
                every = np.frombuffer(ids, f"<u{len(ids) // tokens}").astype("<u4")
                spans = [(k * size, size, first + whole + k, 0) for k in range(tokens // size)]
                if rest:
                    begin = tokens - rest
                    a = int(np.searchsorted(keys, rest << 40 | rank, side="right"))
                    key = keys[a - 1]
                    while a and keys[a - 1] == key:
                        a -= 1
                        spans.append((begin + int(t["sub_start"][a]), int(t["sub_length"][a]), int(t["sequence"][a] + rank - t["rank"][a]), int(t["offset"][a])))
                for start, length, sequence, offset in spans:
                    own = every[start : start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(own), tokens, sequence, offset, own))
            if rows:
                yield record_batch(out_schema, list(zip(*rows)))

    narrow = ranked.select("doc_id", "tokens", "rest", (F.col("rank_base") + F.col("local")).alias("rank"), (F.col("whole_base") + F.col("whole_local")).alias("whole"), "ids")
    return narrow.mapInArrow(place, PIECES)

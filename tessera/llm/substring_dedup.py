"""Removal of repeated substrings by suffix arrays, shard by shard, then across shards.

1. Tasks cut their documents into shards of some megabytes; a longer document is a shard of its
   own, of which only anchors are needed, piece by piece. Every other shard's suffix array is
   refined by doubling (only suffixes whose group is not yet single are sorted again, as
   Larsson and Sadakane do); common prefixes of neighbours follow Kasai's rule, by which a
   prefix shrinks by at most one from a position to the next, so only the head of a chain is
   compared. Strings of ``length`` bytes that also start in an earlier document of the shard
   are settled here and never leave it.
2. Hashes only route what is left, so that shards need not exchange all of it. Every other
   window of ``length`` bytes picks the smallest k-gram hash in it as its anchor: equal windows
   have equal anchors, wherever they are. Shards exchange the set of their anchors, packed;
   anchors of one shard alone are dropped. Documents that look like whole copies are grouped
   by Spark on their very bytes, each told once by a shard, and take no further part.
3. For shared anchors the shards send the bytes around them. Of stretches with the same bytes a
   task keeps the one of the smallest document, all others are answered as a whole. It sorts what
   it keeps by suffix arrays, block by block, and merge the sorted runs by binary search with comparisons of the bytes;
   each shard learns which of its windows start in a smaller document elsewhere. But for whole
   copies and hot anchors, all that crosses shards is decided here.
4. An anchor that very many shards share has its windows, each with its bytes, aggregated by
   Spark, which combines them before the shuffle; no task gets all of it.
5. Shards mark covered bytes and report on each document.

What is equal is decided by bytes alone. The shards are a table bucketed by shard number in the
warehouse (which executors share), one row a document, so that cogrouping it with answers moves
the answers and not the texts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, record_batch, split_join

GRAM = 24
NO_ID = 2**63 - 1  # a null id comes after every other
SHARD_BYTES = 2 << 20  # a suffix array takes some 60 times that while it is refined
BLOCK_BYTES = 1 << 20  # of what is sorted at once where shards meet
HOT_SHARDS = 1 << 16  # an anchor of more shards is dealt by its windows
MOST_BUCKETS = 100_000


def eight(data: np.ndarray, n: int) -> np.ndarray:
    """Big-endian 8-byte integers that start at each of the first n positions (zero-padded)."""
    k = np.zeros(n + 8, np.uint64)
    k[: len(data)] = data
    for step in (1, 2, 4):
        k[:-step] = (k[:-step] << np.uint64(8 * step)) | k[step:]
    return k[:n]


def suffix_array(k8: np.ndarray, depth: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes or more, and which of them differ from
    the one before within ``known`` bytes (8 times a power of two)."""
    n = len(k8)
    order = np.argsort(k8, kind="quicksort").astype(np.int32)
    head = np.ones(n + 1, bool)
    ordered = k8[order]
    head[1:n] = ordered[1:] != ordered[:-1]
    del ordered
    rank = np.zeros(n + 1, np.uint32)  # 1 + place of the group's first; 0 beyond the end
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n, dtype=np.int32), np.int32(0))) + 1
    h, heads = 8, head
    while h < depth:
        if h == known:
            heads = head.copy()
        at = np.flatnonzero(~(head[:n] & head[1:])).astype(np.int32)  # places in groups of two and more
        if not len(at):
            break
        suffix = order[at]
        key = rank[suffix].astype(np.uint64)
        key <<= np.uint64(32)
        key |= rank[np.minimum(suffix + h, n)]
        by = np.argsort(key, kind="quicksort")
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        h *= 2
    return order, (heads if h > known else head)[:n]


def common_prefixes(k8: np.ndarray, order: np.ndarray, head: np.ndarray, depth: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths): common prefix with the suffix before, at the places whose ``depth``
    bytes equal its; lengths below ``enough`` and above may be cut, the comparison holds."""
    n = len(k8)
    places = np.flatnonzero(~head)
    here, before = order[places].astype(np.int64), order[places - 1].astype(np.int64)
    by_text = np.argsort(here, kind="stable")
    i, phi = here[by_text], before[by_text]
    chain = np.ones(len(i), bool)  # a chain's first: its left neighbour has another partner
    chain[1:] = (i[1:] != i[:-1] + 1) | (phi[1:] != phi[:-1] + 1)
    heads = np.flatnonzero(chain)
    reach = np.diff(np.append(heads, len(i))) + enough + 8
    known = np.full(len(heads), depth, np.int64)
    active = np.arange(len(heads))
    while len(active):
        a, b = i[heads[active]] + known[active], phi[heads[active]] + known[active]
        inside = np.maximum(a, b) < n
        differ = np.where(inside, k8[np.minimum(a, n - 1)] ^ k8[np.minimum(b, n - 1)], np.uint64(1) << np.uint64(63))
        # equal leading bytes of an 8-byte word: shift until nothing differs
        equal = sum((differ >> np.uint64(8 * (7 - s)) == 0).astype(np.int64) for s in range(8))
        known[active] += equal
        active = active[(equal == 8) & (known[active] < reach[active])]
    number = np.cumsum(chain) - 1
    found = np.empty(len(i), np.int64)
    found[by_text] = np.maximum(known[number] - (i - i[heads[number]]), 0)
    return places, found


def windows_of(ends: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index of each byte, and whether a whole window starts there."""
    ends = ends.astype(np.int32)
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=np.int32(0)))
    return doc, np.arange(length, n + length, dtype=np.int32) <= ends[doc]


class Windows:
    """The distinct strings of ``length`` bytes in ``k8[start:end]``, sorted, each with the
    smallest id of a document that it starts in; ``number`` tells which one starts where (-1:
    none, as the document ends before)."""

    def __init__(self, k8: np.ndarray, start: int, doc: np.ndarray, whole: np.ndarray, ids: np.ndarray, length: int):
        own = k8[start : start + len(doc)]
        depth = 8
        while depth * 2 <= length:
            depth *= 2
        order, head = suffix_array(own, length, depth)
        places, shared = common_prefixes(own, order, head, depth, length)
        new = np.ones(len(own), bool)
        new[places[shared >= length]] = False
        group = (np.cumsum(new, dtype=np.int32) - 1)[whole[order]]
        suffix = order[whole[order]]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        self.at = suffix[heads].astype(np.int64) + start
        self.least = np.minimum.reduceat(ids[doc[suffix]], heads) if len(heads) else np.zeros(0, np.int64)
        self.number = np.full(len(own), -1, np.int32)
        self.number[suffix] = np.cumsum(np.diff(group, prepend=-1) != 0, dtype=np.int32) - 1


def compare(k8: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the ``length`` bytes at a are less than, equal to, or more than those at b."""
    sign, open_ = np.zeros(len(a), np.int8), np.arange(len(a))
    for s in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x, y = k8[a[open_] + s], k8[b[open_] + s]
        sign[open_] = (x > y).astype(np.int8) - (x < y)
        open_ = open_[x == y]
    return sign


def merged(k8: np.ndarray, a: tuple, b: tuple, length: int) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Two sorted runs (places, least ids) into one; also where the entries of each now are.

    Each string of b finds its place in a by binary search: on the first 8 bytes, then on all."""
    (at_a, least_a), (at_b, least_b) = a, b
    lo = np.searchsorted(k8[at_a], k8[at_b], "left")
    hi = np.searchsorted(k8[at_a], k8[at_b], "right")
    active = np.flatnonzero(lo < hi)
    while len(active):
        mid = (lo[active] + hi[active]) >> 1
        less = compare(k8, at_a[mid], at_b[active], length) < 0
        lo[active[less]], hi[active[~less]] = mid[less] + 1, mid[~less]
        active = active[lo[active] < hi[active]]
    equal = lo < len(at_a)
    equal[equal] = compare(k8, at_a[lo[equal]], at_b[equal], length) == 0
    fresh = np.flatnonzero(~equal)
    now_a = np.arange(len(at_a)) + np.searchsorted(lo[fresh], np.arange(len(at_a)), "right")
    now_b = np.empty(len(at_b), np.int64)
    now_b[fresh] = lo[fresh] + np.arange(len(fresh))
    now_b[equal] = now_a[lo[equal]]
    at, least = np.empty(len(at_a) + len(fresh), np.int64), np.full(len(at_a) + len(fresh), NO_ID)
    at[now_a], at[now_b[fresh]] = at_a, at_b[fresh]
    least[now_a] = least_a
    least[now_b] = np.minimum(least[now_b], least_b)
    return (at, least), now_a, now_b


def least_ids(k8: np.ndarray, blocks: list[Windows], length: int) -> list[np.ndarray]:
    """For each block the smallest id, over all blocks, of each of its strings: runs are merged
    two by two until one is left."""
    runs = [((w.at, w.least), {i: np.arange(len(w.at))}) for i, w in enumerate(blocks)]
    while len(runs) > 1:
        nxt = []
        for (a, of_a), (b, of_b) in zip(runs[::2], runs[1::2]):
            run, now_a, now_b = merged(k8, a, b, length)
            nxt.append((run, {i: now[x] for of, now in ((of_a, now_a), (of_b, now_b)) for i, x in of.items()}))
        runs = nxt + (runs[-1:] if len(runs) % 2 else [])
    (_, least), of = runs[0]
    return [least[of[i]] for i in range(len(blocks))]


def local_repeats(k8: np.ndarray, doc: np.ndarray, whole: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Window starts whose bytes also start in a document of the shard with a smaller id."""
    n = len(k8)
    bad = np.zeros(n, bool)
    depth = 8
    while depth * 2 <= length:
        depth *= 2
    order, head = suffix_array(k8, length, depth)
    places, shared = common_prefixes(k8, order, head, depth, length)
    joined = places[shared >= length]
    if not len(joined):
        return bad
    linked, member = np.zeros(n, bool), np.zeros(n, bool)
    linked[joined] = True
    member[joined] = member[joined - 1] = True
    at = np.flatnonzero(member)  # places in groups of equal windows; single ones need no look
    first = ~linked[at]
    suffix = order[at]
    owner = np.where(whole[suffix], ids[doc[suffix]], NO_ID)
    least = np.minimum.reduceat(owner, np.flatnonzero(first))[np.cumsum(first) - 1]
    bad[suffix[whole[suffix] & (least < owner)]] = True
    return bad


def anchors(k8: np.ndarray, ask: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``ask`` that share an anchor: (anchor, first window, last window)."""
    n = len(k8)
    half = np.uint64(32)  # the same everywhere, so that equal windows choose alike
    low = gram_hash(k8, np.arange(n), bits)
    low = ((low >> half) << half) | np.arange(n, dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    full = np.uint64(2**64 - 1)
    while have * 2 <= span:
        low[:-have] = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = span - have
    if rest:
        low = np.minimum(low, np.concatenate([low[rest:], np.full(min(rest, n), full)]))
    starts = np.flatnonzero(ask)
    if not len(starts):
        return starts, starts, starts
    at = (low[starts] & ((np.uint64(1) << half) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1
    return at[heads], starts[heads], starts[tails]


def anchors_by_pieces(data: np.ndarray, length: int, bits: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of all windows of one long document, some ``step`` of them at a time; pieces
    overlap by a window, so each window sees what it saw in the whole."""
    found = []
    for at in range(0, len(data) - length + 1, step):
        piece = data[at : at + step + length - 1]
        ask = np.zeros(len(piece), bool)
        ask[: len(piece) - length + 1] = True
        found.append([x + at for x in anchors(eight(piece, len(piece)), ask, length, bits)])
    return tuple(map(np.concatenate, zip(*found)))


def gram_hash_at(data: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """``gram_hash`` at some places of a text, of which only their bytes are read."""
    words = data[at[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64)
    h = words[:, 0]
    for i in range(1, GRAM // 8):
        h = mixed(h, words[:, i])
    return h & np.uint64((2**bits - 1) << (64 - bits))


def gram_hash(k8: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place, of which the upper ``bits`` are used."""
    h, last = k8[at], len(k8) - 1
    for step in range(8, GRAM, 8):
        h = mixed(h, k8[np.minimum(at + step, last)])
    return h & np.uint64((2**bits - 1) << (64 - bits))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def pack_runs(p: np.ndarray, a: np.ndarray, z: np.ndarray) -> bytes:
    return p.astype("<u4").tobytes() + np.concatenate([p - a, z - a]).astype("<u2").tobytes()


def unpack_runs(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf) // 8
    p = np.frombuffer(buf, "<u4", n).astype(np.int64)
    back, more = np.frombuffer(buf, "<u2", 2 * n, 4 * n).astype(np.int64).reshape(2, -1)
    return p, p - back, p - back + more


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


ROW = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("data", pa.binary()), ("bad", pa.binary()), ("runs", pa.binary()), ("digest", pa.binary()), ("settled", pa.bool_())])
ROW_DDL = "shard long, place long, id long, data binary, bad binary, runs binary, digest binary, settled boolean"


def shard_rows(number: int, ids: list, texts: list[bytes], length: int, bits: int, step: int):
    """The rows of a shard, in batches: a document with its windows that are settled here (starts
    and ends of runs) and the anchors of the others (``pack_runs``), in places of its own."""
    own = np.array([NO_ID if i is None else i for i in ids], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    n = len(data)
    bad, p = np.zeros(n, bool), np.zeros(0, np.int64)
    a = z = p
    if len(texts) == 1 and n > step:  # nothing is settled within one document, however long
        p, a, z = anchors_by_pieces(data, length, bits, step)
    elif n:
        k8 = eight(data, n)
        doc, whole = windows_of(ends, length, n)
        bad = local_repeats(k8, doc, whole, own, length)
        p, a, z = anchors(k8, whole & ~bad, length, bits)
    cut = np.searchsorted(a, np.append(0, ends))
    rows, size = [], 0
    for k, text in enumerate(texts):
        start = int(ends[k]) - len(text)
        b, e = spans(bad[start : start + len(text)])
        mine = slice(cut[k], cut[k + 1])
        settled = len(text) < length or (len(b) == 1 and e[0] - b[0] == len(text) - length + 1)
        digest = xxhash.xxh3_128_digest(text)[: max(1, bits // 4)]
        rows.append((number, k, int(own[k]), text, np.concatenate([b, e]).astype("<u4").tobytes(), pack_runs(p[mine] - start, a[mine] - start, z[mine] - start), digest, settled))
        size += len(text)
        if size > 1 << 20:
            yield record_batch(ROW, list(zip(*rows)))
            rows, size = [], 0
    if rows:
        yield record_batch(ROW, list(zip(*rows)))


def make_shards(docs: DataFrame, length: int, shard_bytes: int, buckets: int, bits: int) -> str:
    """Write the shard table; returns its name."""

    def run(batches):
        task = TaskContext.get().partitionId()
        ids, texts, size, made = [], [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                if texts and size + len(raw) > shard_bytes:
                    yield from shard_rows(task << 32 | made, ids, texts, length, bits, max(length, shard_bytes))
                    ids, texts, size, made = [], [], 0, made + 1
                ids.append(doc)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield from shard_rows(task << 32 | made, ids, texts, length, bits, max(length, shard_bytes))

    name = f"tessera_shards_{uuid.uuid4().hex}"
    docs.mapInArrow(run, ROW_DDL).write.bucketBy(buckets, "shard").sortBy("shard").saveAsTable(name, format="parquet")
    return name


def by_shard(shards: DataFrame, columns: list[str], notes: DataFrame, work, schema: pa.Schema, ddl: str) -> DataFrame:
    """``work(columns of the shard's documents in order, columns of its notes)`` for each shard:
    lists of rows. A shard is of bounded size, and so is what it is told."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left):
            left = left.sort_by("place")
            rows = work({c: left.column(c).to_pylist() for c in left.column_names}, {c: right.column(c).to_pylist() for c in right.column_names})
        return pa.Table.from_batches([record_batch(schema, list(zip(*rows)) or [[]] * len(schema))])

    return shards.select("shard", "place", *columns).groupBy("shard").cogroup(notes.groupBy("shard")).applyInArrow(run, ddl)


def whole_copies(shards: DataFrame, length: int) -> DataFrame:
    """shard, place of the documents that equal one with a smaller id in another shard. Digests
    propose; Spark groups what they propose by the bytes, and where one digest has several
    texts none of them counts as a copy (their windows are compared like any others)."""
    told = shards.where(~F.col("settled")).select("digest", "shard", "place", "id")
    several = materialise(told.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digests")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    maybe = materialise(split_join(told, several.select("digest"), "digest", several, total), "maybe-copies")
    text = pa.schema([("digest", pa.binary()), ("data", pa.binary()), ("id", pa.int64())])

    def texts(docs, notes):
        wanted = set(notes["place"])
        return [(d, t, i) for p, d, t, i in zip(docs["place"], docs["digest"], docs["data"], docs["id"]) if p in wanted]

    read = by_shard(shards, ["digest", "data", "id"], maybe.select("shard", "place"), texts, text, "digest binary, data binary, id long")
    kinds = read.groupBy("digest", "data").agg(F.min("id").alias("least"))
    first = materialise(kinds.groupBy("digest").agg(F.min("least").alias("least"), F.count("*").alias("kinds")).where("kinds = 1").select("digest", "least"), "first-copies")
    return materialise(split_join(maybe, first, "digest", several, total).where("id > least").select("shard", "place"), "whole-copies")


def dealt_rows(shard: int, key: np.ndarray, parts: int, pack) -> list:
    """(bucket, shard, payload) rows: ``key`` dealt into ``parts`` buckets by its high bits."""
    bucket = ((key >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], bucket[order], [-1]])))
    return [(int(bucket[order[a]]), shard, pack(order[a:z])) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]


def by_bucket(batches):
    """(shard, payload) rows of one bucket after another; the input is sorted by bucket."""
    rows, now = [], None
    for batch in batches:
        for bucket, shard, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and rows:
                yield rows
                rows = []
            now = bucket
            rows.append((shard, payload))
    if rows:
        yield rows


DEALT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])
SHARED = pa.schema([("shard", pa.int64()), ("payload", pa.binary()), ("hot", pa.bool_())])
BACK = pa.schema([("shard", pa.int64()), ("payload", pa.binary())])


class OpenRuns:
    """The anchored runs of a shard's documents but for those that are whole copies: in one
    text ``raw`` of their bytes; ``place`` and ``id`` of the document, ``start`` in it."""

    def __init__(self, docs: dict, copies: set, bits: int):
        self.raw, parts, at = b"", [], 0
        texts = []
        for place, i, text, runs in zip(docs["place"], docs.get("id", docs["place"]), docs["data"], docs["runs"]):
            if runs and place not in copies:
                p, a, z = unpack_runs(runs)
                parts.append((p + at, a + at, z + at, np.full(len(p), place), np.full(len(p), i), np.full(len(p), at)))
                texts.append(text)
                at += len(text)
        self.raw = b"".join(texts)
        empty = np.zeros(0, np.int64)
        self.p, self.a, self.z, self.place, self.id, self.base = map(np.concatenate, zip(*parts)) if parts else [empty] * 6
        data = np.frombuffer(self.raw, np.uint8)
        self.hash = gram_hash_at(data, self.p, bits) if parts else np.zeros(0, np.uint64)


def shared_anchors(shards: DataFrame, copies: DataFrame, parts: int, bits: int, hot_shards: int) -> DataFrame:
    """shard, payload, hot: those of its anchor hashes that another shard has too."""

    def tell(docs, notes):
        own = OpenRuns(docs, set(notes["place"]), bits)
        h = np.unique(own.hash)
        return dealt_rows(docs["shard"][0], h, parts, lambda at: h[at].tobytes()) if len(h) else []

    def meet(batches):
        for rows in by_bucket(batches):
            h = np.frombuffer(b"".join(p for _, p in rows), "<u8")
            names, number, count = np.unique(h, return_inverse=True, return_counts=True)
            cut = np.cumsum([0, *(len(p) // 8 for _, p in rows)])
            for k, (shard, _) in enumerate(rows):
                own = number[cut[k] : cut[k + 1]]
                for hot in (False, True):
                    mine = own[(count[own] > hot_shards) if hot else (count[own] > 1) & (count[own] <= hot_shards)]
                    if len(mine):
                        yield record_batch(SHARED, [[shard], [names[mine].tobytes()], [hot]])

    said = by_shard(shards, ["data", "runs"], copies, tell, DEALT, "bucket long, shard long, payload binary")
    return said.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "shard long, payload binary, hot boolean")


#: What a stretch of windows with one anchor carries, before its bytes.
STRETCH = np.dtype([("id", "<i8"), ("place", "<u4"), ("start", "<u4"), ("windows", "<u2")])
#: An answer: windows of a document that start in a smaller one elsewhere.
ANSWER = np.dtype([("place", "<u4"), ("start", "<u4"), ("windows", "<u4")])


def asked_runs(docs: dict, notes: dict, bits: int) -> tuple[OpenRuns, np.ndarray]:
    """A shard's runs, and which of them have an anchor that its notes name."""
    own = OpenRuns(docs, {p for p in notes["place"] if p is not None}, bits)
    known = np.unique(np.frombuffer(b"".join(p for p in notes["payload"] if p is not None), "<u8"))
    return own, np.flatnonzero(np.isin(own.hash, known))


def notes_of(copies: DataFrame, told: DataFrame) -> DataFrame:
    return copies.select("shard", "place", F.lit(None).cast("binary").alias("payload")).unionAll(told.select("shard", F.lit(None).cast("long"), "payload"))


def unpacked(payload: bytes, length: int) -> tuple[np.ndarray, list[bytes]]:
    """The stretches of one payload and their bytes."""
    buf = zlib.decompress(payload)
    n, at = int.from_bytes(buf[:8], "little"), 8
    rec = np.zeros(n, STRETCH)
    for f in STRETCH.names:
        rec[f] = np.frombuffer(buf, STRETCH[f], n, at)
        at += n * STRETCH[f].itemsize
    ends = (np.cumsum(rec["windows"].astype(np.int64) + length - 1) + at).tolist()
    return rec, [buf[a:z] for a, z in zip([at, *ends[:-1]], ends)]


def met_stretches(rows: list, length: int):
    """(shard, answers) for the (shard, stretches) of one bucket. Of stretches of equal bytes only
    one of the smallest id is compared, which has all windows of the others; those of larger ids
    are covered whole, those of its id as it is. Blocks of what is left are sorted by suffix
    arrays, and their runs merged by binary search."""
    recs, texts = zip(*(unpacked(p, length) for _, p in rows))
    who = np.repeat(np.arange(len(rows)), [len(r) for r in recs])
    every = np.concatenate(recs)
    numbers: dict[bytes, int] = {}
    kind = np.array([numbers.setdefault(t, len(numbers)) for own in texts for t in own], np.int64)
    del texts
    data = np.frombuffer(b"".join(numbers), np.uint8)
    least = np.full(len(numbers), NO_ID)
    np.minimum.at(least, kind, every["id"])
    rec = np.zeros(len(numbers), STRETCH)
    rec["windows"][kind], rec["id"] = every["windows"], least
    del numbers
    size = rec["windows"].astype(np.int64) + length - 1
    end = np.cumsum(size)
    k8 = eight(data, len(data))
    doc, whole = windows_of(end, length, len(data))
    blocks, starts, at = [], [], 0
    while at < len(rec):
        base = int(end[at] - size[at])
        upto = max(at + 1, int(np.searchsorted(end, base + BLOCK_BYTES, "right")))
        stop = int(end[upto - 1])
        starts.append(base)
        blocks.append(Windows(k8, base, doc[base:stop], whole[base:stop], rec["id"], length))
        at = upto
    covered = np.zeros(len(data) + 1, np.int8)
    for base, w, ids in zip(starts, blocks, least_ids(k8, blocks, length)):
        own = np.flatnonzero(w.number >= 0)
        covered[base + own] = ids[w.number[own]] < rec["id"][doc[base + own]]
    # runs of covered starts within a stretch; a stretch's last bytes start no window
    first, last = spans(covered[:-1] != 0)
    cut = np.searchsorted(doc[first], np.arange(len(rec) + 1))
    whole_stretch = every["id"] > least[kind]
    n = np.where(whole_stretch, 1, np.diff(cut)[kind])
    stretch = np.repeat(np.arange(len(every)), n)
    answer = np.zeros(len(stretch), ANSWER)
    answer["place"], answer["start"], answer["windows"] = every["place"][stretch], every["start"][stretch], every["windows"][stretch]
    part = np.flatnonzero(~whole_stretch[stretch])
    run = (cut[:-1][kind[stretch]] + np.arange(len(stretch)) - (np.cumsum(n) - n)[stretch])[part]
    answer["start"][part] += (first[run] - (end - size)[doc[first[run]]]).astype(np.uint32)
    answer["windows"][part] = last[run] - first[run]
    edges = np.searchsorted(who[stretch], np.arange(len(rows) + 1))
    for k, (shard, _) in enumerate(rows):
        if edges[k] < edges[k + 1]:
            yield shard, answer[edges[k] : edges[k + 1]].tobytes()


def answers(shards: DataFrame, copies: DataFrame, shared: DataFrame, parts: int, length: int, bits: int) -> DataFrame:
    """shard, payload: ``ANSWER`` rows, for anchors that are not hot."""

    def tell(docs, notes):
        own, mine = asked_runs(docs, notes, bits)
        if not len(mine):
            return []
        rec = np.zeros(len(mine), STRETCH)
        rec["id"], rec["place"] = own.id[mine], own.place[mine]
        rec["start"], rec["windows"] = (own.a - own.base)[mine], (own.z - own.a + 1)[mine]
        begin = own.a[mine]
        stop = begin + rec["windows"].astype(np.int64) + length - 1

        def pack(sel):
            part = rec[sel]
            text = b"".join([own.raw[x:y] for x, y in zip(begin[sel].tolist(), stop[sel].tolist())])
            # field by field, ids and places compress well
            return zlib.compress(len(part).to_bytes(8, "little") + b"".join([part[f].tobytes() for f in STRETCH.names]) + text, 1)

        return dealt_rows(docs["shard"][0], own.hash[mine], parts, pack)

    def meet(batches):
        for rows in by_bucket(batches):
            for shard, payload in met_stretches(rows, length):
                yield record_batch(BACK, [[shard], [payload]])

    said = by_shard(shards, ["id", "data", "runs"], notes_of(copies, shared.where("not hot")), tell, DEALT, "bucket long, shard long, payload binary")
    return said.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "shard long, payload binary")


def hot_answers(shards: DataFrame, copies: DataFrame, shared: DataFrame, length: int, bits: int) -> DataFrame:
    """shard, payload: ``ANSWER`` rows, for the windows of hot anchors, which Spark aggregates."""
    window = pa.schema([("window", pa.binary()), ("id", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])

    def tell(docs, notes):
        own, mine = asked_runs(docs, notes, bits)
        rows = []
        for r in mine.tolist():
            for at in range(int(own.a[r]), int(own.z[r]) + 1):
                answer = np.array([(own.place[r], at - own.base[r], 1)], ANSWER).tobytes()
                rows.append((own.raw[at : at + length], int(own.id[r]), docs["shard"][0], answer))
        return rows

    said = by_shard(shards, ["id", "data", "runs"], notes_of(copies, shared.where("hot")), tell, window, "window binary, id long, shard long, payload binary")
    said = materialise(said, "hot-windows")
    least = materialise(said.groupBy("window").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "hot-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return split_join(said, least.drop("n"), "window", least, total).where("least < id").select("shard", "payload")


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def report(shards: DataFrame, copies: DataFrame, found: DataFrame, length: int, with_values: bool) -> DataFrame:
    def run(docs, notes):
        gone = {p for p in notes["place"] if p is not None}
        more = np.frombuffer(b"".join(p for p in notes["payload"] if p is not None), ANSWER)
        more = more[np.argsort(more["place"], kind="stable")]
        cut = np.searchsorted(more["place"], np.append(docs["place"], 2**32 - 1))
        rows = []
        for k, (place, doc, data, bad) in enumerate(zip(docs["place"], docs["id"], docs["data"], docs["bad"])):
            n = len(data)
            cover = np.zeros(n + 1, np.int32)
            b, e = np.frombuffer(bad, "<u4").astype(np.int64).reshape(2, -1)
            own = more[cut[k] : cut[k + 1]]
            s, w = own["start"].astype(np.int64), own["windows"].astype(np.int64)
            # windows [b, e) cover the bytes [b, e + length - 1)
            np.add.at(cover, np.concatenate([b, s]), 1)
            np.add.at(cover, np.concatenate([e, s + w]) + length - 1, -1)
            removed = np.ones(n, bool) if place in gone else np.cumsum(cover[:n], dtype=np.int32) > 0
            kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
            s, z = spans(removed)
            rows.append((None if doc == NO_ID else doc, n, n - len(kept), len(s), hashlib.sha256(kept).hexdigest(), np.stack([s, z], 1).ravel().tolist() if with_values else None, kept if with_values else None))
        return rows

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"
    return by_shard(shards, ["id", "data", "bad"], notes_of(copies, found), run, REPORT, ddl)


def remove_repeats(
    df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, with_values: bool = False, hot_shards: int = HOT_SHARDS, hash_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes over it also starts in a document with a
    smaller id. A null or empty text has no bytes; a null id counts as larger than any other,
    and rows that share an id (or have none) do not remove from each other; an empty table
    gives no rows; other columns are ignored. ``with_values`` adds spans (start, end, ... of
    the removed runs) and kept (the remaining bytes). ``length`` is at least 32. ``hash_bits``
    changes how much is compared, never the result.
    """
    if length < GRAM + 8:
        raise ValueError("strings shorter than 32 bytes are not supported")
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-total // (8 << 20)))
    table = make_shards(docs, length, shard_bytes, int(min(MOST_BUCKETS, max(4, -(-total // (16 << 20))))), hash_bits)
    try:
        shards = spark.table(table)
        copies = whole_copies(shards, length)
        shared = materialise(shared_anchors(shards, copies, parts, hash_bits, hot_shards), "shared-anchors")
        found = answers(shards, copies, shared, parts, length, hash_bits)
        if not shared.where("hot").isEmpty():
            found = found.unionAll(hot_answers(shards, copies, shared, length, hash_bits))
        found = materialise(found, "answers")
        out = materialise(report(shards, copies, found, length, with_values), "repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return out if with_values else out.drop("spans", "kept")


#: Every string of 50 bytes (as 100 hex digits, cut from blocks of 1,000 bytes with their overlap)
#: with the smallest document that it starts in; runs of covered bytes; what lies between them.
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, block, substring(h, 2 * block + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS block FROM d)),
w AS (SELECT doc_id, block + i AS pos, substring(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, block, h, unnest(range(0, least(1000, len(h) // 2 - 49))) AS i FROM b)),
m AS (SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY win) AS bad FROM w),
g AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM m WHERE bad),
s AS (SELECT doc_id, pos, sum(CASE WHEN prior IS NULL OR pos > prior + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM g),
r AS (SELECT doc_id, nth, min(pos) AS a, max(pos) + 50 AS z FROM s GROUP BY ALL),
k AS (SELECT doc_id, a AS upto, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d)),
t AS (SELECT doc_id, coalesce(string_agg(substring(h, 2 * since + 1, 2 * (upto - since)), '' ORDER BY since), '') AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(len(h) // 2 - len(kept) // 2 AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id) USING (doc_id)
"""

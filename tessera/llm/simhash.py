"""SimHash near-duplicates, candidates by pigeonring chains, links by whole components.

Fingerprints are cut into m segments on a ring. If two differ in at most t bits, some segment
starts a chain in which the first l segments together differ in at most floor(l * t / m) bits,
for every l. Each distinct fingerprint is dealt m times, by (segment, its value); a task finds
the partners whose next segment keeps the chain's second budget by binary search, tests the
longer chains, then the full Hamming distance. A task reports a spanning star of what it
linked, never all pairs, and components are joined by alternating stars in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, record_batch, split_join

PAIR_BLOCK = 2_000_000
KEY_ROWS = 500_000  # that a task holds, beside the rest of one key


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of word shingles; 0 for a text without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: n - 1]).tolist()]
    return majority(np.array([digest(joined[a:z], 42) for a, z in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded scratch space for very long texts
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(m: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of each of m segments, as even as can be."""
    widths = [bits // m + (i < bits % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        a, b = a[keep := label[a] != label[b]], b[keep]
    return label


def chain_links(keys: np.ndarray, fps: np.ndarray, m: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows that share a key (segment number and value)."""
    segs = segments(m)
    budget = [distance * (k + 1) // m for k in range(m)]
    number = (keys >> np.int64(32)).astype(np.int64)
    shift, width = (np.array([segs[(i + 1) % m][j] for i in range(m)])[number] for j in (0, 1))
    following = (fps >> shift.astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
    most = max(w for _, w in segs)
    # rows of one key lie together, and within it by the next segment's value
    order = np.lexsort((following, keys))
    keys, fps, number, following, width = keys[order], fps[order], number[order], following[order], width[order]
    group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)]))
    spot = (group << most) | following.astype(np.int64)
    masks = []  # bits of the first l segments of a chain that starts at segment i
    for length in range(3, m):
        masks.append(np.array([sum(((1 << segs[(i + k) % m][1]) - 1) << segs[(i + k) % m][0] for k in range(length)) for i in range(m)], np.uint64))
    nodes, node = np.unique(fps, return_inverse=True)
    kept_a, kept_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(len(fps))
    flips = [0] + [1 << b for b in range(most)] if budget[1] >= 1 else [0]
    for flip in flips:
        if flip:
            target = spot ^ flip
            rows = here[(target > spot) & (flip < (1 << width))]
            lo, hi = np.searchsorted(spot, target[rows], "left"), np.searchsorted(spot, target[rows], "right")
        else:
            rows, lo, hi = here, here + 1, np.searchsorted(spot, spot, "right")
        size = hi - lo
        rows, lo, size = rows[size > 0], lo[size > 0], size[size > 0]
        upto = np.cumsum(size)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_BLOCK, "right")))
            n = size[at:end]
            a = np.repeat(rows[at:end], n)
            b = np.repeat(lo[at:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = end
            differ = fps[a] ^ fps[b]
            near = np.bitwise_count(differ) <= distance
            for length, mask in zip(range(3, m), masks):
                near &= np.bitwise_count(differ & mask[number[a]]) <= budget[length - 1]
            kept_a, kept_b = np.concatenate([kept_a, node[a[near]]]), np.concatenate([kept_b, node[b[near]]])
            if len(kept_a) > PAIR_BLOCK:  # only a spanning star goes on
                label = components(len(nodes), kept_a, kept_b)
                kept_a = np.flatnonzero(label != np.arange(len(nodes)))
                kept_b = label[kept_a]
    label = components(len(nodes), kept_a, kept_b)
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def near_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (u, v) that connect all fingerprints at Hamming distance <= ``distance``."""
    m = distance + 1
    parts = [F.struct((F.lit(i << 32).cast("long") + F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1)).alias("key"), F.col("fp")) for i, (s, w) in enumerate(segments(m))]
    dealt = distinct.select(F.explode(F.array(*parts)).alias("p")).select("p.key", "p.fp").repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(batches):
        for keys, fps in whole_keys(batches):
            u, v = chain_links(keys, fps.view(np.uint64), m, distance)
            for at in range(0, len(u), 100_000):
                yield record_batch(schema, [u[at : at + 100_000].view(np.int64), v[at : at + 100_000].view(np.int64)])

    return dealt.mapInArrow(link, "u long, v long").distinct()


def whole_keys(batches):
    """(keys, fps) of sorted rows, some whole keys at a time: ``KEY_ROWS`` rows and the rest of
    the last key, whatever the size of the partition."""
    held, rows = [], 0
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if rows >= KEY_ROWS and len(keys):
            last = held[-1][0][-1]
            cut = int(np.searchsorted(keys, last, "right"))  # the rest of the key that is held
            if cut < len(keys):
                held.append((keys[:cut], fps[:cut]))
                yield tuple(map(np.concatenate, zip(*held)))
                held, rows, keys, fps = [], 0, keys[cut:], fps[cut:]
        if len(keys):
            held.append((keys, fps))
            rows += len(keys)
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): v is the smallest node that u reaches; nodes that are smallest have no row.

    Alternating large and small stars; every round is written to the shared folder, and a hub's
    star is dealt in parts. It ends when each node has one link and none is a link's both ends;
    rounds grow with the logarithm of the longest path, and more than ``most_rounds`` of them
    raise an error.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    for _ in range(most_rounds):
        # rows, and nodes with two links or with a link either way
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(edges.select("v", F.lit(0)))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        rows, tangled = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR up = 1 AND least = 0"))).first()
        if not tangled:
            return edges
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = split_join(both, low.drop("n"), "u", low, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = split_join(large, least.drop("n"), "u", least, rows).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``distance`` differing
    bits, the row's own included. A null or empty text has fingerprint zero and links like
    any other; a null id gets a component_id too (null where no row of its component has an
    id); rows that repeat an id keep their own row; an empty table gives no rows; other
    columns are ignored.
    """
    docs = materialise(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-set")
    rows, kinds = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    roots = connected(near_links(distinct.select("fp"), distance))
    joined = distinct.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    names = materialise(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component-names")
    named = split_join(joined.select("fp", "root"), names.drop("n"), "root", names, kinds).select("fp", "component_id")
    return split_join(docs, named, "fp", distinct, rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, columns as they were.

    Rows without an id cannot be told apart and stay; of rows that share the surviving id all
    stay (exact copies are the business of exact deduplication). Null and empty texts are one
    component, and an empty table gives no rows.
    """
    found = near_duplicates(df, id_col, text_col, shingle, distance)
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_loser")).distinct()
    return df.join(losers, df[id_col] == losers["_loser"], "left_anti")

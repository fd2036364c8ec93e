"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a bound.

Candidates come by pigeonring chains, twice.

1. SimHash fingerprints at few differing bits, as in ``simhash``, connect close copies early.
2. No distance of 64 bits covers a bound of similarity, so what counts as a candidate is decided
   on the set itself, as a vector of one bit for each possible shingle. Two sets of sizes a and b
   that are similar enough differ in at most (a + b) * (1 - s) / (1 + s) bits. The hashes of a
   set, in order, are cut into m boxes on a ring, m one more than that bound. Then some box
   starts a chain whose first l boxes together differ in less than l shingles, for every l: its
   first box is equal. Each set is dealt by its boxes, each with a byte of parities for every box
   that follows in the chain (bits that differ there differ in the sets); an empty box, which many
   sets have, is dealt with the next one, whole and less any one of its shingles. A box stays with
   the sets that have a partner there by these chains. Similar sets are in the same class of sizes
   or in neighbours; the smaller one's class has the ring on which they meet, so a set is on that
   of its class and on that below. No link is lost.

Copies share most of their boxes, and would be told in each of them. So the first links are sought
in a few boxes of every set alone, those of its smallest keys, which similar sets mostly share.
After that only boxes whose sets are in different components are left; they are sorted by their
least component, so that the boxes of a group lie together and tell a pair once.

Sets of a box in different components are compared where they meet, by folded vectors (bits that
differ there differ in the sets) and sizes, and nothing else of them is moved. What passes is
compared exactly: first a spanning forest of it, so that a group of copies costs a few rounds and
not its square, then all that is left across components. Only texts of a set that has a partner
have their shingles read again.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import id_text, materialise, record_batch, split_join
from .simhash import connected
from .substring_dedup import DEALT, by_bucket, dealt_rows, mixed

DISTANCE = 4  # bits of SimHash fingerprints for the first links
PAIRS_A_MEMBER = 8  # so few pairs across components are compared without further rounds
ROWS_AT_ONCE = 50_000  # that a task holds of the rings, beside the rest of one box
WORDS_AT_ONCE = 1 << 21  # of folded vectors that are compared at once
MOST_BITS = 1 << 13
CHAIN = 5  # boxes after the first whose parities go along, a byte each
FIRST_BOXES = 8  # of a set, in which the first links are sought
DEALT_AT_ONCE = 300_000  # rows of boxes that a task packs together
BUCKET_SHINGLES = 1_000_000  # whose boxes, about half as many, are met at once
KEY_BITS = 40  # of a key that go along; the others choose the bucket


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one run."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.unique(np.array([digest(joined[a:z], 42) for a, z in zip(starts, (ends[width - 1 :] - 1).tolist())], "<u8"))


def identity(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


@functools.cache
def size_classes(similarity: float) -> np.ndarray:
    """Largest size of each class; similar sets are in one class or in neighbours."""
    most = [1]
    while most[-1] < 2**40:
        most.append(max(most[-1] + 1, int((most[-1] + 1) / similarity + 1e-9)))
    return np.array(most)


def most_differing(total, similarity: float):
    """Shingles in which two similar sets of ``total`` shingles together differ at most."""
    return np.floor(total * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)


def chains(parity: np.ndarray) -> np.ndarray:
    """For each box of a ring the parities of the ``CHAIN`` boxes after it (of all others, if
    fewer), a byte each, the next one highest."""
    found, here = np.zeros(len(parity), np.uint64), np.arange(len(parity))
    for k in range(1, min(CHAIN, len(parity) - 1) + 1):
        found |= parity[(here + k) % len(parity)].astype(np.uint64) << np.uint64(8 * (CHAIN - k))
    return found


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether boxes that are equal can start a chain, by their ``chains``."""
    differ, fits = a ^ b, np.ones(len(a), bool)
    for k in range(1, CHAIN + 1):
        fits &= np.bitwise_count(differ >> np.uint64(8 * (CHAIN - k))) <= k
    return fits


def ring_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    return ring_boxes(hashes, similarity)[0]


def ring_boxes(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set's boxes, on the ring of its class of sizes and on that below, and their chains."""
    classes = size_classes(similarity)
    own, found = int(np.searchsorted(classes, len(hashes))), []
    place, value = hashes >> np.uint64(32), mixed(hashes, hashes)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    parities = np.concatenate([np.zeros(1, np.uint8), np.bitwise_xor.accumulate(np.uint8(1) << (value & np.uint64(7)).astype(np.uint8))])
    for ring in range(max(0, own - 1), own + 1):
        boxes = int(most_differing(classes[ring] + int(classes[ring] / similarity + 1e-9), similarity)) + 1
        if boxes == 1:
            continue  # sets that differ are never similar
        edges = np.searchsorted((place * np.uint64(boxes)) >> np.uint64(32), np.arange(boxes + 1))
        first, last = edges[:-1], edges[1:]
        sums, chain = upto[last] - upto[first], chains(parities[last] ^ parities[first])
        salt = np.arange(boxes, dtype=np.uint64) + np.uint64(ring << 40)
        full = first < last
        found.append((mixed(mixed(sums[full], salt[full]), salt[full]), chain[full]))
        empty = np.flatnonzero(~full)
        if len(empty):
            # two boxes of a chain differ in one shingle at most
            following = (empty + 1) % boxes
            salt = salt[empty] + np.uint64(1 << 39)
            n = (last - first)[following]
            element = np.repeat(first[following], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            less = np.repeat(sums[following], n) - value[element]
            sums, salt = np.concatenate([sums[following], less]), np.concatenate([salt, np.repeat(salt, n)])
            found.append((mixed(mixed(sums, salt), salt), np.concatenate([chain[empty], np.repeat(chain[empty], n)])))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, chain = map(np.concatenate, zip(*found))
    keys, at = np.unique(keys, return_index=True)
    return keys, chain[at]


def folded(hashes: np.ndarray, similarity: float) -> bytes:
    """The set's vector, folded (bits of one place added modulo 2) to some two times the size of
    its class: two of these differ in no more bits than the sets do in shingles."""
    size = int(size_classes(similarity)[np.searchsorted(size_classes(similarity), len(hashes))])
    bits = min(MOST_BITS, max(256, 1 << (2 * size - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """doc_id, fp (of the set of shingles), n (its size), sim (its SimHash) and its folded vector,
    of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sim", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            fps, sims = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (identity, simhash.majority))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), pa.array(sims), pa.array([folded(s, similarity) for s in sets], pa.binary())], schema=schema)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long, n long, sim long, vector binary")


#: A box of a set as it is dealt: the set's number among those packed with it, the low bytes of the
#: key, the chain, and whether it is one of the set's ``FIRST_BOXES``.
BOX = np.dtype([("set", "<u2"), ("key", "u1", KEY_BITS // 8), ("chain", "u1", CHAIN), ("first", "?")])


def low_bytes(values: np.ndarray, n: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def from_bytes(low: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(low), 8), np.uint8)
    whole[:, : low.shape[1]] = low
    return whole.view("<u8").ravel()


def packed_boxes(sets: list[np.ndarray], similarity: float, parts: int) -> list:
    """(bucket, bucket, payload) rows of the boxes of some sets."""
    fps = np.array([identity(s) for s in sets], np.uint64)
    rings = [ring_boxes(s, similarity) for s in sets]
    keys, chain = (np.concatenate(x) for x in zip(*rings))
    rows = np.zeros(len(keys), BOX)
    rows["set"] = np.repeat(np.arange(len(sets)), [len(k) for k, _ in rings])
    rows["key"], rows["chain"] = low_bytes(keys, KEY_BITS // 8), low_bytes(chain, CHAIN)
    rows["first"] = np.concatenate([np.arange(len(k)) < FIRST_BOXES for k, _ in rings])  # keys are sorted

    def pack(at):
        own = rows[at]
        names, own["set"] = np.unique(own["set"], return_inverse=True)
        return len(names).to_bytes(8, "little") + fps[names].tobytes() + own.tobytes()

    return [(bucket, bucket, payload) for bucket, _, payload in dealt_rows(0, keys, parts, pack)]


def unpacked_boxes(payload: bytes) -> tuple[np.ndarray, ...]:
    """Keys, fps, chains and first of a payload's boxes."""
    n = int.from_bytes(payload[:8], "little")
    fps, rows = np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, BOX, -1, 8 + 8 * n)
    return from_bytes(rows["key"]), fps[rows["set"]], from_bytes(rows["chain"]), rows["first"]


def with_partner(keys: np.ndarray, chain: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Which rows have a partner of their key by a chain. Rows are sorted by key, then by the next
    box's byte, in which partners differ in one bit at most."""
    spot = (np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).astype(np.int64)])) << 8) | (chain >> np.uint64(8 * (CHAIN - 1))).astype(np.int64)
    alive, here = np.zeros(len(keys), bool), np.arange(len(keys))
    for flip in [0] + [1 << b for b in range(8)]:
        if flip:
            rows = here[(spot ^ flip) > spot]
            lo, hi = (np.searchsorted(spot, spot[rows] ^ flip, side) for side in ("left", "right"))
        else:
            rows, lo, hi = here, here + 1, np.searchsorted(spot, spot, "right")
        rows, lo, size = rows[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto, at = np.cumsum(size), 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS_AT_ONCE // 4, "right")))
            n = size[at:end]
            a = np.repeat(rows[at:end], n)
            b = np.repeat(lo[at:end], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = end
            fits = chained(chain[a], chain[b]) & (fps[a] != fps[b])
            alive[a[fits]] = alive[b[fits]] = True
    return alive


def ring_rows(df: DataFrame, id_col: str, text_col: str, width: int, similarity: float, total: int = 0, by_chain: bool = False) -> DataFrame:
    """key, fp, first of the boxes that several sets have; with ``by_chain`` only of the sets that
    have a partner there by a chain. ``total`` is the number of shingles of all sets."""
    parts = max(8, -(-total // BUCKET_SHINGLES))
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("first", pa.bool_())])

    def deal(batches):
        sets, size = [], 0
        for batch in batches:
            for text in batch.column(1):
                sets.append(shingles(text.as_py(), width))
                size += len(sets[-1])
                if size > DEALT_AT_ONCE or len(sets) == 1 << 16:
                    yield record_batch(DEALT, list(zip(*packed_boxes(sets, similarity, parts))) or [[]] * 3)
                    sets, size = [], 0
        if sets:
            yield record_batch(DEALT, list(zip(*packed_boxes(sets, similarity, parts))) or [[]] * 3)

    def meet(batches):
        for rows in by_bucket(batches):
            keys, fps, chain, first = map(np.concatenate, zip(*(unpacked_boxes(p) for _, p in rows)))
            order = np.lexsort((fps, keys << np.uint64(64 - KEY_BITS) | chain >> np.uint64(8 * CHAIN + KEY_BITS - 64)))
            keys, fps, chain, first = keys[order], fps[order], chain[order], first[order]
            fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1]) | (chain[1:] != chain[:-1])]))
            keys, fps, chain, first = keys[fresh], fps[fresh], chain[fresh], first[fresh]
            if by_chain:
                alive = with_partner(keys, chain, fps)
            else:
                alive = np.concatenate([[False], keys[1:] == keys[:-1]])
                alive[:-1] |= alive[1:]
            alive = np.flatnonzero(alive)
            names = keys.view(np.int64) | np.int64(rows[0][0] << KEY_BITS)
            for at in range(0, len(alive), 100_000):
                part = alive[at : at + 100_000]
                yield record_batch(schema, [names[part], fps[part], first[part]])

    dealt = id_text(df, id_col, text_col).mapInArrow(deal, "bucket long, shard long, payload binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, fp long, first boolean")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """fp and its shingles as bytes, of the rows of ``wanted`` (fp, least)."""
    rows = id_text(df, id_col, text_col)
    ids = wanted.where("least IS NOT NULL").select(F.col("least").alias("doc_id"))
    rows = rows.join(ids, "doc_id", "left_semi").unionAll(rows.where("doc_id IS NULL"))
    schema = pa.schema([("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            for text in batch.column(1):
                own = shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([identity(own)], np.uint64).view(np.int64)), pa.array([own.tobytes()], pa.binary())], schema=schema)

    found = rows.mapInArrow(run, "fp long, shingles binary")
    return found.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def similarities(pairs: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """u, v of the pairs whose sets have a similarity of at least ``bound``, and the similarity.
    A text of many pairs has these dealt in parts, on either side."""
    total = pairs.count()
    count = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    named = lambda c, s: sets.select(F.col("fp").alias(c), F.col("shingles").alias(s))
    both = split_join(split_join(pairs, named("v", "b"), "v", count("v"), total), named("u", "a"), "u", count("u"), total)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                found.append(common / (len(a) + len(b) - common))
            near = pa.array(np.array(found) >= bound)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=schema).filter(near)

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, similarity double")


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges make a spanning forest of n nodes: each tree takes its first edge to
    another one, until none has any."""
    label, kept, edge = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while len(edge := edge[label[a[edge]] != label[b[edge]]]):
        first = np.full(n, len(a))
        for ends in (a, b):
            np.minimum.at(first, label[ends[edge]], edge)
        kept.append(np.unique(first[first < len(a)]))
        label = simhash.components(n, label[a[kept[-1]]], label[b[kept[-1]]])[label]
    return np.concatenate(kept)


def alike(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key in different components that sizes and folded vectors do not rule
    out. Rows of a key lie together."""
    found = alike_sets(table, similarity)
    index, _ = next(found)
    return tuple(index[np.concatenate(x)] for x in zip((np.zeros(0, np.int64),) * 2, *found))


def alike_sets(table: pa.Table, similarity: float):
    """First the rows that stand for the sets (``fp``) of a table, and their components; then pairs
    of these as in ``alike``, some at a time. A pair that several keys have mostly comes once."""
    key = table.column("key").to_numpy()
    fp = table.column("fp").to_numpy() if "fp" in table.column_names else np.arange(len(key))
    fps, index, which = np.unique(fp, return_index=True, return_inverse=True)
    root, n = (table.column(c).to_numpy()[index] for c in ("root", "n"))
    yield index, root
    raw = table.column("vector").take(pa.array(index)).to_pylist()
    words = np.array([len(v) // 8 for v in raw])
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    ends = np.repeat(ends, np.diff(ends, prepend=0))
    upto, at, here, most = np.cumsum(ends - np.arange(len(key)) - 1), 0, np.arange(len(key)), WORDS_AT_ONCE // 4
    vectors, seen = {}, np.zeros(0, np.int64)
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        size = (ends - here - 1)[at:stop]
        a = np.repeat(here[at:stop], size)
        b = a + 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = stop
        a, b = which[a], which[b]
        apart = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * (similarity - 1e-9))
        pair = np.unique(np.maximum(a[apart], b[apart]) * len(fps) + np.minimum(a[apart], b[apart]))
        pair = pair[~np.isin(pair, seen)]
        seen = np.concatenate([seen, pair]) if len(seen) < most else pair
        a, b = np.divmod(pair, len(fps))
        bound, least = most_differing(n[a] + n[b], similarity), np.minimum(words[a], words[b])
        for w in np.unique(least).tolist():
            if w not in vectors:
                rows = np.flatnonzero((words == w) | (words == 2 * w))
                spot = np.zeros(len(fps), np.int64)
                spot[rows] = np.arange(len(rows))
                folds = np.zeros((len(rows), w), np.uint64)
                for times in (1, 2):
                    own = np.flatnonzero(words[rows] == times * w)
                    folds[own] = np.bitwise_xor.reduce(np.frombuffer(b"".join(raw[r] for r in rows[own].tolist()), "<u8").reshape(len(own), times, w), axis=1)
                vectors[w] = spot, folds
            spot, folds = vectors[w]
            pairs, step = np.flatnonzero(least == w), max(1, WORDS_AT_ONCE // w)
            for k in range(0, len(pairs), step):
                p = pairs[k : k + step]
                for part in (folds[:, : w // 2], folds):  # half the bits mostly tell
                    p = p[np.bitwise_count(part[spot[a[p]]] ^ part[spot[b[p]]]).sum(1, dtype=np.int64) <= bound[p]]
                yield a[p], b[p]


def whole_boxes(batches):
    """Rows of which those of a key lie together, some whole keys at a time."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        if rows >= ROWS_AT_ONCE and len(other := np.flatnonzero(keys != last)):
            cut = int(other[0])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += len(batch)
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def by_key(rows: DataFrame, *order: str) -> DataFrame:
    """By ranges, so that boxes of many sets are not dealt to the same task."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def still_apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, fp, root, place of the boxes whose sets are in several components; the place is the
    least of them, so that boxes of the same sets can lie together."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("root", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for table in whole_boxes(batches):
            key, fp, root = (table.column(c).to_numpy() for c in ("key", "fp", "root"))
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(heads, len(key)))
            least = np.minimum.reduceat(root, heads)
            apart = np.flatnonzero(np.repeat(least != np.maximum.reduceat(root, heads), n))
            least = np.repeat(least, n)
            for at in range(0, len(apart), 100_000):
                part = apart[at : at + 100_000]
                yield record_batch(schema, [key[part], fp[part], root[part], least[part]])

    named = rows.select("key", "fp").join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left")
    return by_key(named.select("key", "fp", F.coalesce("v", "fp").alias("root")), "key").mapInArrow(run, "key long, fp long, root long, place long")


def passing(rows: DataFrame, vectors: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(u, v, pairs) of the sets of a box that may be similar: all, or a spanning forest for what
    a task holds; the sum of pairs is that of all."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("pairs", pa.int64())])

    def run(batches):
        for table in whole_boxes(batches):
            found = alike_sets(table, similarity)
            index, root = next(found)
            fps = table.column("fp").to_numpy()[index]
            names, number = np.unique(root, return_inverse=True)
            kept, pairs = np.zeros((0, 2), np.int64), 0
            held, size = [kept], 0

            def joined():
                both = np.concatenate(held)
                return np.unique(both, axis=0) if every else both[spanning(len(names), number[both[:, 0]], number[both[:, 1]])]

            for a, b in found:
                pairs += len(a)
                size += len(a)
                held.append(np.stack([a, b], 1))
                if size > WORDS_AT_ONCE // 4:
                    held, size = [joined()], 0
            kept = fps[joined()]
            for at in range(0, len(kept), 100_000):
                part = kept[at : at + 100_000]
                told = np.zeros(len(part), np.int64)
                told[0] = 0 if at else pairs
                yield record_batch(schema, [part.max(1), part.min(1), told])

    order = ["place", "key"] if "place" in rows.columns else ["key"]
    return by_key(rows.join(vectors, "fp").select("key", "fp", "root", "n", "vector", *order[:-1]), *order).mapInArrow(run, "u long, v long, pairs long")


def close_prints(kinds: DataFrame) -> DataFrame:
    """(u, v): sets (fp) whose SimHash fingerprints (sim) are equal or linked by chains."""
    prints = materialise(kinds.groupBy("sim").agg(F.min("fp").alias("first"), F.count("*").alias("n")), "fingerprint-set")
    equal = split_join(kinds, prints.select("sim", "first"), "sim", prints, kinds.count()).select("fp", F.col("first").alias("other"))
    links = simhash.near_links(prints.select(F.col("sim").alias("fp")), DISTANCE)
    for end, name in (("u", "fp"), ("v", "other")):
        links = links.join(prints.select(F.col("sim").alias(end), F.col("first").alias(name)), end)
    both = equal.unionAll(links.select("fp", "other")).where("fp <> other")
    return both.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))


def near_links(df: DataFrame, sketched: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(u, v): v is the least of the sets that u is connected with, over all links of at least
    ``similarity``."""
    total = sketched.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = materialise(ring_rows(df, id_col, text_col, width, similarity, total, by_chain=True), "ring")
    # a set that may be similar to any other has a partner on a ring
    able = materialise(rows.select("fp").distinct(), "able")
    able_sets = sketched.join(able, "fp", "left_semi")
    vectors = materialise(able_sets.select("fp", "n", "vector").dropDuplicates(["fp"]), "vectors")
    kinds = materialise(able_sets.groupBy("fp", "sim").agg(F.min("doc_id").alias("least")), "candidates")
    sets = materialise(shingle_sets(df, id_col, text_col, width, kinds), "shingles")
    first = passing(rows.where("first").select("key", "fp", F.col("fp").alias("root")), vectors, similarity, False)
    pairs = materialise(first.select("u", "v").unionAll(close_prints(kinds)).distinct(), "pairs")
    roots = connected(similarities(pairs, sets, similarity).select("u", "v"))
    while True:
        rows = materialise(still_apart(rows, roots), "apart")
        forest = materialise(passing(rows, vectors, similarity, False), "forest")
        members, left = rows.count(), forest.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if not left:
            return roots
        every = left <= PAIRS_A_MEMBER * members
        pairs = passing(rows, vectors, similarity, True) if every else forest
        links = materialise(similarities(materialise(pairs.select("u", "v").distinct(), "pairs"), sets, similarity), "links")
        if not every and links.isEmpty():  # then no forest tells more than all pairs do
            every = True
            pairs = materialise(passing(rows, vectors, similarity, True).select("u", "v").distinct(), "pairs")
            links = similarities(pairs, sets, similarity)
        roots = connected(roots.unionAll(links.select("u", "v")))
        if every:
            return roots


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component, columns as they were.

    Components are over links of at least ``similarity``. Texts without words are equal. Rows
    without an id cannot be told apart and stay; of rows that share the surviving id all stay
    (exact copies are the business of exact deduplication). An empty table gives no rows.
    """
    sketched = materialise(sketches(df, id_col, text_col, width, similarity), "sketches")
    roots = near_links(df, sketched, id_col, text_col, width, similarity)
    named = sketched.select("doc_id", "fp").join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select("doc_id", F.coalesce("v", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("component_id <> last")
    names = materialise(names, "component-names")
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    losers = split_join(named, names.select("root", "component_id"), "root", names, total).where("doc_id <> component_id").select(F.col("doc_id").alias("_loser")).distinct()
    losers = materialise(losers, "losers")
    return df.join(losers, df[id_col] == losers["_loser"], "left_anti")

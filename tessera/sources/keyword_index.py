"""An inverted index on files: postings in blocks, kept in segments.

A segment is a Parquet folder of blocks, sorted by term and id over files that each hold a narrow
range, so that a filter on terms reads little. A block has at most ``BLOCK`` documents of one term:
ids, frequencies and places as gaps in a variable number of bytes, and its highest frequencies, of
which the first bounds what any of its documents can score. A change adds a segment of the documents that
it touches and a list of ids whose older postings are dead (tombstones). Segments of one size tier
are merged, without the dead, when there are ``FAN`` of them, so there are few and each posting is
rewritten a logarithm of times. What an index consists of is its ``state``, plain data that whoever
owns the index keeps (a store: in its manifest).
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keywords import postings
from ..session import materialise, scratch, ship_package

BLOCK = 128
FAN = 4
SMALLEST = 10_000  # postings of a segment of the lowest tier
MOST_FILTERED = 1000  # terms that are handed to the scan as a filter; more are joined
TOPS = 8  # of a block's highest frequencies that are kept beside it
BLOCKS = "term string, first long, last long, n int, tops array<int>, ids binary, tfs binary, places binary"
_BLOCKS = pa.schema([("term", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int32()), ("tops", pa.list_(pa.int32())), ("ids", pa.binary()), ("tfs", pa.binary()), ("places", pa.binary())])
POSTINGS = "id long, term string, tf long, positions array<int>"
IN_SETTING = "spark.sql.parquet.pushdown.inFilterThreshold"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in 7-bit bytes, low first, all but the last marked; and how many bytes each took."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    out, start = np.empty(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[has] + k] = byte | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def decode(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.uint64)
    start = np.flatnonzero(np.append(True, raw[:-1] < 128))
    at = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & np.uint8(127)).astype(np.uint64) << (7 * at).astype(np.uint64), start)


def gaps(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Differences within runs that begin at ``start``; the first of a run is 0."""
    out = np.diff(values, prepend=values[:1])
    out[start] = 0
    return out


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums within runs; the inverse of ``gaps`` for runs that begin at 0."""
    upto = np.cumsum(values)
    return upto - np.repeat(upto[start] - values[start], np.diff(np.append(start, len(values))))


def binaries(raw: np.ndarray, size: np.ndarray, start: np.ndarray) -> pa.BinaryArray:
    """The bytes of each run of numbers as one cell."""
    upto = np.append(0, np.cumsum(size))
    offsets = upto[np.append(start, len(size))].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def pack(batches):
    """Blocks of postings that come sorted by term and id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, tf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        words = batch.column(1).dictionary_encode()
        places, size = batch.column(3), np.diff(batch.column(3).offsets.to_numpy())
        flat = places.flatten().to_numpy().astype(np.int64)
        term = words.indices.to_numpy()
        head = np.flatnonzero(np.diff(term, prepend=-1))
        nth = np.arange(len(term)) - np.repeat(head, np.diff(np.append(head, len(term))))
        start = np.flatnonzero(nth % BLOCK == 0)
        end = np.append(start[1:], len(term))
        id_raw, id_size = encode(gaps(ids.view(np.uint64), start))
        tf_raw, tf_size = encode(tf)
        own = np.cumsum(size) - size
        steps = gaps(flat, own[size > 0]) if len(flat) else flat
        steps[own[size > 0]] = flat[own[size > 0]]
        at_raw, at_size = encode(steps)
        upto = np.append(own, len(flat))
        at_cells = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(at_size))[upto[np.append(start, len(term))]].astype(np.int32)), pa.py_buffer(at_raw)])
        block = np.repeat(np.arange(len(start)), end - start)
        order = np.lexsort((-tf, block))
        order = order[np.arange(len(order)) - np.repeat(start, end - start) < TOPS]
        tops = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(TOPS, end - start))).astype(np.int32)), pa.array(tf[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(term[start])), pa.array(ids[start]), pa.array(ids[end - 1]), pa.array((end - start).astype(np.int32)),
             tops, binaries(id_raw, id_size, start), binaries(tf_raw, tf_size, start), at_cells],
            schema=_BLOCKS,
        )


def unpack(batches):
    """id, term, tf, positions (empty if the places were not read) and seq of every posting."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
        n = batch.column(2).to_numpy()
        start = np.cumsum(n) - n
        ids = (np.repeat(batch.column(1).to_numpy().view(np.uint64), n) + sums(decode(raw(3)), start)).view(np.int64)
        tf = decode(raw(4)).astype(np.int64)
        block = np.repeat(np.arange(len(n)), n)
        if batch.num_columns > 6:
            steps = decode(raw(5)).astype(np.int64)
            ends = np.append(0, np.cumsum(tf))
            places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sums(steps, ends[:-1][tf > 0]).astype(np.int32)))
        else:
            places = pa.array([[]] * len(ids), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).take(pa.array(block)), pa.array(tf), places, batch.column(batch.num_columns - 1).take(pa.array(block))], names=["id", "term", "tf", "positions", "seq"])


class KeywordIndex:
    """The index under ``root``. ``state``: ``segments`` (path, seq, postings) and ``gone`` (path,
    upto: postings of these ids in segments before that number are dead; n)."""

    def __init__(self, spark: SparkSession, root: str, state: dict | None = None, places: bool = True):
        self.spark, self.root, self.places = spark, root, places
        self.state = state or {"segments": [], "gone": []}
        ship_package(spark)

    def without_places(self) -> KeywordIndex:
        """The same index, of which ids and frequencies alone are read."""
        return KeywordIndex(self.spark, self.root, self.state, places=False)

    # -- reading ---------------------------------------------------------------------------

    def blocks(self, segments: list[dict] | None = None) -> DataFrame:
        """The blocks of all segments, with the segment's number ``seq``."""
        segments = self.state["segments"] if segments is None else segments
        parts = [self.spark.read.schema(BLOCKS).parquet(s["path"]).withColumn("seq", F.lit(s["seq"]).cast("long")) for s in segments]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], BLOCKS + ", seq long")

    def gone(self) -> DataFrame | None:
        """id, upto of the dead."""
        parts = [self.spark.read.schema("id long").parquet(g["path"]).withColumn("upto", F.lit(g["upto"]).cast("long")) for g in self.state["gone"]]
        return reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.max("upto").alias("upto")) if parts else None

    def alive(self, blocks: DataFrame, places: bool | None = None) -> DataFrame:
        """The living postings of blocks: id, term, tf, positions."""
        columns = ["term", "first", "n", "ids", "tfs", *(["places"] if (self.places if places is None else places) else []), "seq"]
        rows = blocks.select(*columns).mapInArrow(unpack, POSTINGS + ", seq long")
        if (dead := self.gone()) is not None:
            rows = rows.join(dead, "id", "left").where("upto IS NULL OR seq >= upto")
        return rows.select("id", "term", "tf", "positions")

    def postings(self) -> DataFrame:
        return self.alive(self.blocks())

    def ids(self) -> DataFrame:
        """The ids of all documents that have a term."""
        return self.alive(self.blocks(), places=False).select("id").distinct()

    def blocks_of(self, terms: DataFrame) -> DataFrame:
        """Blocks of the named terms. A few terms are a filter of the scan, more are joined."""
        names = terms.select("term").distinct()
        few = [r[0] for r in names.limit(MOST_FILTERED + 1).collect()]
        if len(few) > MOST_FILTERED:
            return self.blocks().join(names, "term", "left_semi")
        if int(self.spark.conf.get(IN_SETTING)) < MOST_FILTERED:
            self.spark.conf.set(IN_SETTING, str(MOST_FILTERED))  # else a longer list is filtered as a range only
        return self.blocks().where(F.col("term").isin(few)) if few else self.blocks([])

    def postings_of(self, terms: DataFrame) -> DataFrame:
        return self.alive(self.blocks_of(terms))

    def leading_blocks(self, terms: DataFrame, k: int) -> DataFrame:
        """term, seq, first, last, n, most and needed of every block of the terms; no postings
        are read. A block is needed if its highest frequency reaches the term's kth, as far as
        that is known from the highest ones of all blocks."""
        dead = sum(g["n"] for g in self.state["gone"])  # so many of those documents may be dead
        rows = materialise(self.blocks_of(terms).select("term", "seq", "first", "last", "n", "tops"), "leading-blocks")
        nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("top")))
        kth = rows.select("term", F.explode("tops").alias("top")).withColumn("nth", nth).where(F.col("nth") == k + dead).select("term", F.col("top").alias("_kth"))
        most = F.col("tops")[0]
        return rows.join(kth, "term", "left").select("term", "seq", "first", "last", "n", most.alias("most"), (most >= F.coalesce("_kth", F.lit(0))).alias("needed"))

    def leading(self, terms: DataFrame, k: int) -> DataFrame:
        """Postings (without places) of the terms, from the blocks that can hold one of the ``k``
        highest frequencies, ties included; the others are neither decoded nor read."""
        least = materialise(self.leading_blocks(terms, k).where("needed").groupBy("term").agg(F.min("most").alias("least")), "least")
        return self.alive(self.blocks_of(terms).join(least, "term").where(F.col("tops")[0] >= F.col("least")), places=False)

    # -- changing ----------------------------------------------------------------------------

    def change(self, docs: DataFrame | None = None, gone: DataFrame | None = None, id_col: str = "id", text: Column | str = "text") -> dict:
        """Add ``docs`` as a segment, after the older postings of the ids in ``gone`` (id) died;
        then merge what has to be merged. Returns the new state, which is also this object's;
        files of the old one stay. Rows without an id are not indexed."""
        seq = 1 + max([s["seq"] for s in self.state["segments"]] + [g["upto"] for g in self.state["gone"]], default=0)
        state = {"segments": [*self.state["segments"]], "gone": [*self.state["gone"]]}
        if gone is not None and state["segments"]:
            path = self._path("gone")
            gone.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().write.parquet(path)
            if n := self.spark.read.schema("id long").parquet(path).count():
                state["gone"].append({"path": path, "upto": seq, "n": n})
        self.state = state
        if docs is not None:
            with scratch(self.spark):
                rows = postings(docs.where(F.col(id_col).isNotNull()), id_col, text)
                state["segments"] += self._segment(rows.withColumn("id", F.col("id").cast("long")), seq)
        while group := self._to_merge():
            with scratch(self.spark):
                merged = self._segment(self.alive(self.blocks(group), places=True), max(s["seq"] for s in group))
            paths = {s["path"] for s in group}
            state["segments"] = [s for s in state["segments"] if s["path"] not in paths] + merged
        oldest = min((s["seq"] for s in state["segments"]), default=seq)
        state["gone"] = [g for g in state["gone"] if g["upto"] > oldest]
        return state

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}-{uuid.uuid4().hex}"

    def _segment(self, rows: DataFrame, seq: int) -> list[dict]:
        """Write postings as a segment: sorted over ranges of (term, id), so that a frequent term
        spreads over as many files as it needs."""
        path = self._path("segment")
        rows = materialise(rows.select("id", "term", "tf", "positions"), "postings")  # read twice: for the ranges, and to be dealt
        ship_package(self.spark)
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").mapInArrow(pack, BLOCKS).write.parquet(path)
        n = self.spark.read.schema(BLOCKS).parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return [{"path": path, "seq": seq, "postings": n}] if n else []

    def _to_merge(self) -> list[dict]:
        tiers: dict[int, list[dict]] = {}
        for s in self.state["segments"]:
            tier, size = 0, SMALLEST
            while s["postings"] > size:
                tier, size = tier + 1, size * FAN
            tiers.setdefault(tier, []).append(s)
        return next((group for _, group in sorted(tiers.items()) if len(group) >= FAN), [])

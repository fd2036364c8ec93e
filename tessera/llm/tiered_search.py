"""Ranked lexical search over a tiered index.

Documents are dealt into shards of bounded text; a shard is one row of the index. Its postings
are cut into tiers by impact, each term's highest first, with the largest impact that is left
below a tier (the residual). A search adds up the first tier of every shard. What a document can
still gain is bounded by its terms' residuals, so a few documents can be completed by looking up
their postings, and where no other document of the shard can reach an item's kth score, the item
is exact there. Where that proof is lacking the item falls through to the next tiers, the last of
which holds everything.

Scores are integers: the sum over an item's terms of weight times impact, where
weight = floor(1000 ln((2N + 2) / (2 df + 1))) and impact = 10^9 tf div (1000 tf + 20 m) with
m = 50 + 50 n N div L.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, id_text, materialise

SHARD_BYTES = 8 << 20  # of text; what a task holds while it makes a shard is some twenty times that
PIECE = 1 << 20  # bytes of a text that are split into terms at once
#: Of a term's postings in a shard: in the first tier, and in the first two; never under ``LEAST``.
SHARES, LEAST = (1 / 8, 1 / 2), 32
TIERS = len(SHARES) + 1
FEW = 8  # one document in so many, at most, is looked up rather than falling to the next tier
BLOCK_BYTES = 1 << 20  # of the terms of the items that a job sends to its tasks
NO_ID = np.iinfo(np.int64).max  # rows without an id come last among equals

_SEPARATORS = bytes(i for i in range(0x80) if not chr(i).isalnum())
_SEPARATOR = re.compile(b"[" + re.escape(_SEPARATORS) + b"]")
_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def terms(text: bytes):
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = _SEPARATOR.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = end.start() if end else len(text)
        yield from text[at:end].translate(_BLANK).lower().split()
        at = end


class Shard:
    """Postings of the documents added so far."""

    def __init__(self):
        self.ids, self.lengths, self.words, self.tfs, self.vocabulary, self.bytes = [], [], [], [], {}, 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        number = self.vocabulary.setdefault
        held, tf, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        some: list[int] = []
        for word in terms(text):
            some.append(number(word, len(self.vocabulary)))
            if len(some) >= PIECE:  # bounded for very long texts
                held, tf = merged(held, tf, some)
                n, some = n + len(some), []
        held, tf = merged(held, tf, some)
        self.ids.append(doc_id)
        self.lengths.append(n + len(some))
        self.words.append(held.astype(np.int32))
        self.tfs.append(tf.astype(np.int32))
        self.bytes += len(text)

    def row(self) -> dict:
        vocabulary = sorted(self.vocabulary)
        place = np.empty(len(vocabulary), np.int64)
        place[[self.vocabulary[w] for w in vocabulary]] = np.arange(len(vocabulary))
        word = place[np.concatenate(self.words)] if vocabulary else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), [len(w) for w in self.words])
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(vocabulary) + 1)).astype(np.int32)
        lengths = np.array(self.lengths, np.int32)
        return {"ids": self.ids, "lengths": lengths.tobytes(), "terms": b" ".join(vocabulary), "starts": starts.tobytes(), "docs": doc[order].astype(np.int32).tobytes(), "tfs": np.concatenate(self.tfs)[order].tobytes() if vocabulary else b"", "n": int((lengths > 0).sum()), "total": int(lengths.sum(dtype=np.int64))}


def merged(words: np.ndarray, tf: np.ndarray, more: list[int]) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(np.array(more, np.int64), return_counts=True)
    if not len(words):
        return found, counts
    both, at = np.unique(np.concatenate([words, found]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([tf, counts])).astype(np.int64)


POSTINGS = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, tfs binary, n long, total long"
INDEX = "ids array<long>, terms binary, starts binary, docs binary, impacts binary, tiers binary, residuals binary"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a shard: its ids, lengths in terms, and each term's documents with frequencies."""
    schema = arrow_schema(POSTINGS)

    def run(batches):
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                shard.add(doc_id, text.as_py())
                if shard.bytes >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=schema)
                    shard = Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=schema)

    return id_text(df, id_col, text_col).mapInArrow(run, POSTINGS)


def tiered(rows: DataFrame, documents: int, total: int) -> DataFrame:
    """The index: ``postings`` with impacts, each term's cut into tiers, by document within one.

    ``tiers`` has, a term, where its tiers end; ``residuals`` the largest impact below each."""
    schema = arrow_schema(INDEX)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, starts, docs, tf = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("lengths", "starts", "docs", "tfs"))
                # Python's integers where 64 bits might not hold the product
                m = 50 + (50 * lengths * documents) // max(1, total) if 50 * documents * int(lengths.max(initial=0)) < 2**63 else np.array([50 + 50 * n * documents // max(1, total) for n in lengths.tolist()], np.int64)
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
                size = np.diff(starts)
                word = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((docs, -impact, word))
                place = np.arange(len(word)) - starts[word]
                ends = np.stack([np.minimum(size, np.maximum(LEAST, np.ceil(size * share).astype(np.int64))) for share in SHARES] + [size], axis=1).reshape(-1, TIERS)
                best = np.concatenate([impact[order], [0]])
                left = np.stack([np.where(ends[:, t] < size, best[np.minimum(starts[:-1] + ends[:, t], len(best) - 1)], 0) for t in range(TIERS)], axis=1)
                tier = (place[:, None] >= ends[word]).sum(1)
                order = order[np.lexsort((docs[order], tier, word))]
                yield pa.RecordBatch.from_pylist([{"ids": row["ids"], "terms": row["terms"], "starts": row["starts"], "docs": docs[order].astype(np.int32).tobytes(), "impacts": impact[order].astype(np.int32).tobytes(), "tiers": ends.astype(np.int32).tobytes(), "residuals": left.astype(np.int32).tobytes()}], schema=schema)

    return rows.mapInArrow(run, INDEX)


class Index:
    """An index of the documents: ``shards`` (one row each), N and L."""

    def __init__(self, shards: DataFrame, documents: int, total: int):
        self.shards, self.documents, self.total = shards, documents, total


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The tiered index of every row, written to the shared folder. A null or empty text has no
    terms and is not counted."""
    rows = materialise(postings(df, id_col, text_col, shard_bytes), "postings", **LARGE_ROWS)
    n, total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(materialise(tiered(rows, n, total), "tiers", **LARGE_ROWS), n, total)


class Reader:
    """One shard's row, ready to score items."""

    def __init__(self, batch: pa.RecordBatch, at: int, words: list[bytes], weights: dict[bytes, int]):
        cell = {c: batch.column(i)[at] for i, c in enumerate(batch.schema.names)}
        as_ints = lambda c: np.frombuffer(cell[c].as_buffer(), np.int32)
        own = cell["terms"].as_py().split()
        places = pa.compute.index_in(pa.array(words, pa.binary()), value_set=pa.array(own, pa.binary())) if own else pa.nulls(len(words), pa.int32())
        self.place = dict(zip(words, places.to_pylist()))
        self.starts, self.docs, self.impacts = as_ints("starts"), as_ints("docs"), as_ints("impacts")
        self.tiers, self.residuals = as_ints("tiers").reshape(-1, TIERS), as_ints("residuals").reshape(-1, TIERS)
        self.ids = cell["ids"].values.fill_null(NO_ID).to_numpy() if len(cell["ids"].values) else np.zeros(0, np.int64)
        self.weights = weights

    def lists(self, item: list[bytes]) -> list[tuple[int, int]]:
        return [(self.place[w], self.weights[w]) for w in item if self.place[w] is not None and self.weights[w]]

    def bounds(self, lists, tier: int) -> np.ndarray:
        """What each document scores at most, knowing the tiers up to ``tier``: seen impacts, and
        the residual of each term that was not seen."""
        rest = sum(w * int(self.residuals[p, tier]) for p, w in lists)
        most = np.full(len(self.ids), rest, np.int64)
        for p, w in lists:
            at = slice(self.starts[p], self.starts[p] + self.tiers[p, tier])
            most[self.docs[at]] += w * (self.impacts[at].astype(np.int64) - self.residuals[p, tier])
        return most

    def complete(self, lists, some: np.ndarray) -> np.ndarray:
        """Exact scores of the documents ``some`` (ascending), looked up in every tier."""
        exact = np.zeros(len(some), np.int64)
        for p, w in lists:
            ends = [0, *self.tiers[p].tolist()]
            for a, z in zip(ends, ends[1:]):
                at = slice(self.starts[p] + a, self.starts[p] + z)
                docs = self.docs[at]
                if len(docs):
                    spot = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
                    hit = docs[spot] == some
                    exact[hit] += w * self.impacts[at][spot[hit]].astype(np.int64)
        return exact

    def best(self, some: np.ndarray, exact: np.ndarray, k: int, least: int) -> list[tuple[int | None, int]]:
        some, exact = some[exact >= max(1, least)], exact[exact >= max(1, least)]
        order = np.lexsort((self.ids[some], -exact))[:k]
        return [(None if i == NO_ID else i, s) for i, s in zip(self.ids[some[order]].tolist(), exact[order].tolist())]


def highest(most: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ascending."""
    return np.arange(len(most)) if len(most) <= k else np.sort(np.argpartition(-most, k)[:k])


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, doc_id, score, tiers, rank: the k highest scores above 0 of each item, exactly.

    Equal scores are ranked by id, documents without an id last; documents that repeat an id are
    ranked each. ``tiers`` says how many tiers of the document's shard were added up until the
    item was proven there. Items without terms, or whose terms are nowhere, have no rows; items
    that share an id are asked as one. Items are asked in blocks of at most ``BLOCK_BYTES`` of
    terms, so what a task is sent is bounded whatever the number of items; an item beyond that
    is a block of its own.
    """
    asked = materialise(item_terms(items, id_col, text_col), "asked")
    total = asked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        sizes = asked.groupBy(block.alias("block")).agg(F.sum("bytes").alias("b"), F.countDistinct("item_id").alias("n"))
        if sizes.where(f"b > {2 * BLOCK_BYTES} AND n > 1").isEmpty():
            break
        blocks *= 2
    found = None
    for b in range(blocks):
        part = search_block(index, asked.where(block == b), k)
        found = part if found is None else found.unionAll(part)
    return found


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term (once an item) and its bytes."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("bytes", pa.int64())])

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                own = sorted(set(terms(text.as_py())))
                for at in range(0, len(own), 100_000):
                    some = own[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.int64()), pa.array(some, pa.binary()), pa.array([len(t) + 16 for t in some], pa.int64())], schema=schema)

    return id_text(items, id_col, text_col).mapInArrow(run, "item_id long, term binary, bytes long").distinct()


def search_block(index: Index, asked: DataFrame, k: int) -> DataFrame:
    by_item: dict[int | None, list[bytes]] = {}
    for item, word in asked.select("item_id", "term").orderBy("item_id", "term").collect():  # at most a block
        by_item.setdefault(item, []).append(bytes(word))
    words = sorted({w for own in by_item.values() for w in own})
    frequency = pa.schema([("term", pa.binary()), ("df", pa.int64())])

    def count(batches):
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1)):
                own, size = own.as_py().split(), np.diff(np.frombuffer(starts.as_buffer(), np.int32))
                if own:
                    at = pa.compute.index_in(pa.array(words, pa.binary()), value_set=pa.array(own, pa.binary()))
                    hit = at.is_valid()
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).filter(hit), pa.array(size[at.drop_null().to_numpy()].astype(np.int64))], schema=frequency)

    dfs = index.shards.select("terms", "starts").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = dict.fromkeys(words, 0)
    for word, df in dfs.collect():  # at most the block's terms
        weights[bytes(word)] = max(0, math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1))))
    ddl = "item_id long, doc_id long, score long, tiers int"
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("tiers", pa.int32())])

    def over_shards(answer):
        """``answer(reader, lists, item)`` of every shard and item."""

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    reader, rows = Reader(batch, at, words, weights), []
                    for item, own in by_item.items():
                        if lists := reader.lists(own):
                            rows += [(item, *r) for r in answer(reader, lists, item)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        return index.shards.mapInArrow(run, ddl)

    def likeliest(reader, lists, item):
        """The k documents of a shard that could score most by the first tier, with exact scores."""
        some = highest(reader.bounds(lists, 0), k)
        return [(*r, 1) for r in reader.best(some, reader.complete(lists, some), k, 1)]

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    begun = over_shards(likeliest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    kth = {r["item_id"]: r["score"] for r in begun.select("item_id", "score").collect()}  # one number an item: the kth score is no less

    def proven(reader, lists, item):
        """Tier after tier, until so few documents can reach the kth score that these are looked
        up: no other document of the shard has a place, so what is returned is exact."""
        least = kth.get(item, 1)
        for tier in range(TIERS):
            most = reader.bounds(lists, tier)
            some = np.flatnonzero(most >= least)
            if tier == TIERS - 1 or FEW * len(some) <= len(most):
                exact = most[some] if tier == TIERS - 1 else reader.complete(lists, some)
                return [(*r, tier + 1) for r in reader.best(some, exact, k, least)]

    return materialise(over_shards(proven).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")


#: The operator as SQL.
OP12_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term, big_n),
impacts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)) AS impact FROM postings, totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

"""Approximate vector search over navigable small-world graphs.

Vectors are dealt into graphs of bounded size; a task builds one graph at a time and the graphs
are rows of a table, so they are stored as files. Within a graph, vectors join in the order of a
hash: each links to the most diverse of its nearest among those before it, and these link back.
So the first ones have far links, by which a search crosses the graph. Upper layers hold every
``m``-th vector of the layer below and give the search its entry. A search keeps the ``ef`` best
vectors seen, follows the links of the best that was not followed yet, and stops when none is
left; it does so for all queries of a block together. The best of all graphs are merged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .vectors import best_of, query_blocks, unit_rows

GRAPH_ROWS = 16_384
M, EF_CONSTRUCTION, EF = 16, 64, 48
CELLS = 4 << 20  # similarities that a task holds at once
GRAPHS = "ids binary, vectors binary, width int, layers array<struct<members:binary,links:binary,degree:int>>"
_LAYER = pa.struct([("members", pa.binary()), ("links", pa.binary()), ("degree", pa.int32())])
_SCHEMA = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("layers", pa.list_(_LAYER))])


def diverse(v: np.ndarray, own: np.ndarray, near: np.ndarray, similar: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (nearest first; -1: none) at most ``m`` that are nearer to the row
    than to any candidate taken before; the nearest others fill what is left. -1 where none."""
    out = np.full((len(near), m), -1, np.int32)
    step = max(1, CELLS // max(1, near.shape[1] ** 2 + near.shape[1] * v.shape[1]))
    for at in range(0, len(near), step):
        some, sim = near[at : at + step], similar[at : at + step]
        there = some >= 0
        x = v[np.maximum(some, 0)]
        among = x @ x.transpose(0, 2, 1)
        taken = np.zeros(some.shape, bool)
        for c in range(some.shape[1]):
            close = ((among[:, c, :] >= sim[:, c, None]) & taken).any(1)
            taken[:, c] = there[:, c] & ~close & (taken.sum(1) < m)
        # taken ones first, then the nearest of the others
        order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
        picked = np.take_along_axis(some, order, 1)
        out[at : at + step, : picked.shape[1]] = picked
    return out


def nearest_before(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``n`` nearest rows before it, nearest first (-1: none), and how near."""
    near, similar = np.full((len(v), n), -1, np.int32), np.full((len(v), n), -np.inf, np.float32)
    step = max(1, CELLS // max(1, len(v)))
    for at in range(0, len(v), step):
        rows = np.arange(at, min(at + step, len(v)))
        sim = v[rows] @ v[: rows[-1] + 1].T
        sim[np.arange(sim.shape[1])[None, :] >= rows[:, None]] = -np.inf
        k = min(n, sim.shape[1])
        best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(sim, best, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        best, own = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
        near[rows, :k], similar[rows, :k] = np.where(np.isfinite(own), best, -1), own
    return near, similar


def layer(v: np.ndarray, m: int, most: int, candidates: int) -> np.ndarray:
    """Links of every row, ``most`` at most (-1: none): ``m`` to rows before it, and those back."""
    forward = diverse(v, np.arange(len(v)), *nearest_before(v, candidates), m)
    a, b = np.repeat(np.arange(len(v), dtype=np.int32), m), forward.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    sim = np.empty(len(a), np.float32)
    for at in range(0, len(a), 1 << 18):
        sim[at : at + (1 << 18)] = (v[a[at : at + (1 << 18)]] * v[b[at : at + (1 << 18)]]).sum(1)
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.searchsorted(a, np.arange(len(v)))
    place = np.arange(len(a)) - first[a]
    wide = int(min(place.max(initial=-1) + 1, 2 * candidates))  # of a hub's links the nearest
    near, similar = np.full((len(v), max(1, wide)), -1, np.int32), np.full((len(v), max(1, wide)), -np.inf, np.float32)
    keep = place < wide
    near[a[keep], place[keep]], similar[a[keep], place[keep]] = b[keep], sim[keep]
    links = np.full((len(v), most), -1, np.int32)
    links[:, : min(most, near.shape[1])] = near[:, :most]
    full = np.flatnonzero((near >= 0).sum(1) > most)
    links[full] = diverse(v, full, near[full], similar[full], most)
    return links


def build_graph(ids: np.ndarray, v: np.ndarray, m: int = M, ef_construction: int = EF_CONSTRUCTION) -> dict:
    """One graph as a row of the table; ``v`` are unit vectors, in the order in which they join."""
    layers, members = [], np.arange(len(v), dtype=np.int32)
    while True:
        most = 2 * m if not layers else m
        links = layer(v[members], m, most, ef_construction)
        layers.append({"members": members.tobytes(), "links": links.tobytes(), "degree": most})
        if len(members) <= 2 * m:
            break
        members = members[::m]  # any are as good as others: the order is a hash's
    return {"ids": ids.astype(np.int64).tobytes(), "vectors": v.astype(np.float32).tobytes(), "width": v.shape[1], "layers": layers}


def build_graphs(vectors: DataFrame, rows: int = GRAPH_ROWS, m: int = M, ef_construction: int = EF_CONSTRUCTION) -> DataFrame:
    """Graphs of ``vectors`` (id, embedding), of some ``rows`` vectors each; write them to reuse
    them. Rows without a vector have no place; equal ids each have their own."""
    ship_package(vectors.sparkSession)
    c = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    n = c.count()
    own = F.xxhash64("id", "v")  # by content: a task that runs again gets the same rows
    dealt = c.withColumn("h", own).repartition(max(1, -(-n // rows)), "h").sortWithinPartitions("h", "id")

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1)) for b in batches if b.num_rows]
        if not held:
            return
        ids = np.concatenate([i for i, _ in held])
        width = len(held[0][1][0])
        v = np.concatenate([unit_rows(x, width) for _, x in held]).astype(np.float32)
        for at in range(0, len(ids), 2 * rows):  # a partition can be uneven
            yield pa.RecordBatch.from_pylist([build_graph(ids[at : at + 2 * rows], v[at : at + 2 * rows], m, ef_construction)], schema=_SCHEMA)

    return dealt.select("id", "v").mapInArrow(run, GRAPHS)


class Graph:
    def __init__(self, ids: bytes, vectors: bytes, width: int, layers: list[dict]):
        self.ids = np.frombuffer(ids, np.int64)
        self.v = np.frombuffer(vectors, np.float32).reshape(len(self.ids), width)
        self.layers = [(np.frombuffer(x["members"], np.int32), np.frombuffer(x["links"], np.int32).reshape(-1, x["degree"])) for x in layers]

    def beam(self, q: np.ndarray, own: np.ndarray, links: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places (in ``own``) of the ``ef`` best vectors that each query's search sees, best
        first, their similarities, and how many were compared. -1 where there are fewer."""
        n = len(q)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(own)), bool)
        best = np.full((n, ef), -1, np.int32)
        sim = np.full((n, ef), -np.inf, np.float32)
        followed = np.zeros((n, ef), bool)
        k = min(ef, entry.shape[1])
        best[:, :k], sim[:, :k] = entry[:, :k], self.compare(q, own, entry[:, :k])
        seen[rows, np.maximum(entry[:, :k], 0)] = True
        compared = int((entry[:, :k] >= 0).sum())
        active = np.arange(n)
        while len(active):
            b, s, f = best[active], sim[active], followed[active]
            open_ = (b >= 0) & ~f
            able = open_.any(1)
            active, b, s, f, open_ = active[able], b[able], s[able], f[able], open_[able]
            if not len(active):
                break
            at = np.where(open_, s, -np.inf).argmax(1)
            f[np.arange(len(active)), at] = True
            near = links[b[np.arange(len(active)), at]]
            new = near >= 0
            new &= ~seen[active[:, None], np.maximum(near, 0)]
            seen[np.repeat(active, new.sum(1)), near[new]] = True
            near = np.where(new, near, -1)
            compared += int(new.sum())
            b, s, f = np.concatenate([b, near], 1), np.concatenate([s, self.compare(q[active], own, near)], 1), np.concatenate([f, np.zeros(near.shape, bool)], 1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :ef]
            best[active], sim[active], followed[active] = (np.take_along_axis(x, order, 1) for x in (b, s, f))
        return best, sim, compared

    def compare(self, q: np.ndarray, own: np.ndarray, places: np.ndarray) -> np.ndarray:
        found = np.einsum("nd,nkd->nk", q, self.v[own[np.maximum(places, 0)]])
        found[places < 0] = -np.inf
        return found

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the ``ef`` best, their similarities, vectors compared."""
        members, links = self.layers[-1]
        entry, compared = np.zeros((len(q), 1), np.int32), 0
        for depth in range(len(self.layers) - 1, 0, -1):
            members, links = self.layers[depth]
            best, _, n = self.beam(q, members, links, entry, 4)
            compared += n
            below = self.layers[depth - 1][0]
            entry = np.where(best >= 0, np.searchsorted(below, members[np.maximum(best, 0)]), -1).astype(np.int32)
        members, links = self.layers[0]
        best, sim, n = self.beam(q, members, links, entry, ef)
        return best, sim, compared + n


FOUND = "query_id long, id long, similarity double, compared long"


def graph_top_k(graphs: DataFrame, queries: DataFrame, k: int, ef: int = EF, floor: float | None = None) -> DataFrame:
    """query_id, id, similarity, rank, compared: about the k most similar vectors of each query.

    ``ef`` vectors are kept while a graph is searched: more find more and compare more.
    Similarities of what is found are exact to single precision. ``compared`` is the mean number
    of vectors that a query was compared with, in the graph of the row.
    """
    spark = graphs.sparkSession
    ship_package(spark)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64()), ("compared", pa.int64())])

    def searched(block) -> DataFrame:
        def run(batches):
            asked, q = block.value
            for batch in batches:
                for row in batch.to_pylist():
                    graph, found = Graph(**row), []
                    step = max(1, CELLS // max(1, len(graph.ids)))
                    for at in range(0, len(asked), step):
                        some = q[at : at + step].astype(np.float32)
                        best, sim, n = graph.search(some, max(ef, k))
                        a, b = np.nonzero(best >= 0)
                        a, own, s = best_of(a, graph.ids[best[a, b]], sim[a, b].astype(np.float64), k)
                        keep = s >= floor if floor is not None else np.ones(len(s), bool)
                        found.append((asked[at + a[keep]], own[keep], s[keep], np.full(keep.sum(), n // len(some))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        return graphs.mapInArrow(run, FOUND)

    parts = [searched(spark.sparkContext.broadcast(block)) for block in query_blocks(queries)]
    met = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

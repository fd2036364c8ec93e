"""Hard negatives by distributed radix selection over integer scores.

Vectors are packed into chunks, anchors into blocks; a task multiplies the two exactly and
counts, for each window of an anchor (its positives, then the band of scores below a positive),
how many rows fall into each bucket of the window's range. A window's kth row lies in the bucket
where the counts from the top reach k: the range shrinks to that bucket, digit by digit, first of
the score and then, among rows of one score, of the id. What is gathered at the end are the rows
at or before the kth, k a window. Neither scores nor pairs are stored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_batches

CHUNK_ROWS = 4096
ANCHORS_A_BLOCK = 512
BLOCKS_AT_ONCE = 16  # so many blocks of anchors are sent to every task together: some 16 MB at 64 dimensions
DIGIT = 12  # bits


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, relabel: Column | None, scale: int) -> DataFrame:
    """vec_id, label, q (floor(scale * x) of each component) of the rows that take part. Of rows
    that repeat an id the least (label, q) counts."""
    x = F.col(vector_col)
    good = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & x.isNotNull()
    good &= F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    label = (relabel if relabel is not None else F.col(label_col)).cast("long")
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double"))).alias("q"))
    twice = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def packed(rows: DataFrame) -> DataFrame:
    """Chunks of at most ``CHUNK_ROWS`` rows: ids, labels and components as bytes, their width
    and the largest squared length."""
    schema = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("q", pa.binary()), ("width", pa.int64()), ("longest", pa.float64())])

    def pack(parts):
        ids, labels, flat = (np.concatenate(x) for x in zip(*parts))
        width = len(flat) // len(ids)
        q = flat.reshape(len(ids), width)
        longest = float((q.astype(np.float64) ** 2).sum(1).max(initial=0.0))
        kind = np.int32 if width and np.abs(q.astype(np.float64)).max(initial=0) < 2**31 else np.int64
        cells = [ids.tobytes(), labels.tobytes(), q.astype(kind).tobytes(), width, longest]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            widths = set(np.diff(batch.column(2).offsets.to_numpy()).tolist())
            if len(widths) > 1:
                raise ValueError(f"vectors of several widths: {sorted(widths)}")
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                if held + some.num_rows > CHUNK_ROWS:
                    yield pack(parts)
                    parts, held = [], 0
                parts.append((some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).flatten().to_numpy()))
                held += some.num_rows
        if held:
            yield pack(parts)

    return rows.mapInArrow(run, "ids binary, labels binary, q binary, width long, longest double")


def exact_scores(left: np.ndarray, right: np.ndarray, wide: bool) -> np.ndarray:
    """Integer inner products; in doubles where these hold every partial sum exactly."""
    return left.astype(np.int64) @ right.astype(np.int64).T if wide else (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)


def buckets(keys: np.ndarray, span: int, need: int) -> tuple[list[int], list[int], int]:
    """Lowest buckets of ``keys`` (from 0 to ``span``) with their counts, down to where the counts
    reach ``need`` (the kth of all rows cannot lie further), and the digits below a bucket."""
    shift = max(0, span.bit_length() - DIGIT)
    found, counts = np.unique(keys >> np.uint64(shift), return_counts=True)
    upto = int(np.searchsorted(np.cumsum(counts), need)) + 1
    return found[:upto].tolist(), counts[:upto].tolist(), shift


#: What a task knows of a window: its key (anchor, other), rows of the anchor's label or of
#: others, the scores lo to hi and then the ids ilo to ihi that hold its kth row, how many rows
#: it still needs there, and by what it is narrowed. ``top`` is the highest score it admits; when
#: done, its rows are those above ``cut``, and those at ``cut`` with ids up to ``icut``.
STATE = ("other", "same", "lo", "hi", "top", "ilo", "ihi", "need", "by", "cut", "icut")


def over_chunks(chunks: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, per_window, ddl: str, wide: bool) -> DataFrame:
    """The rows that ``per_window(window, scores, ids)`` gives for every window over every chunk.
    Blocks of anchors go to all tasks, ``BLOCKS_AT_ONCE`` together, which bounds what is sent."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids_b, labels_b, q_b = (batch.column(i)[at].as_buffer() for i in range(3))
                width = batch.column(3)[at].as_py()
                ids, labels = np.frombuffer(ids_b, np.int64), np.frombuffer(labels_b, np.int64)
                q = np.frombuffer(q_b, np.int32 if q_b.size == 4 * len(ids) * width else np.int64).reshape(len(ids), width)
                own, found = batch.column(4)[at].as_py(), []
                if widths := {len(a["q"]) for a in own} - {width}:
                    raise ValueError(f"vectors of several widths: {sorted({width} | widths)}")
                for a, scores in zip(own, exact_scores(np.array([a["q"] for a in own], np.int64).reshape(-1, width), q, wide)):
                    for x in a["windows"]:
                        keep = (labels == a["label"]) & (ids != a["anchor"]) if x["same"] else labels != a["label"]
                        keep = np.flatnonzero(keep & (scores >= x["lo" if x["by"] != "done" else "cut"]) & (scores <= x["hi" if x["by"] != "done" else "top"]))
                        if len(keep):
                            found += [(a["anchor"], x["other"], *row) for row in per_window(x, scores[keep], ids[keep])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    own = windows.groupBy("anchor").agg(F.collect_list(F.struct(*STATE)).alias("windows")).join(anchors, "anchor")
    blobs = own.groupBy("block").agg(F.collect_list(F.struct("anchor", "label", "q", "windows")).alias("own"))
    parts = []
    for at in range(0, blocks, BLOCKS_AT_ONCE):
        last = min(at + BLOCKS_AT_ONCE, blocks) - 1
        dealt = chunks.select("ids", "labels", "q", "width", F.explode(F.sequence(F.lit(at), F.lit(last))).alias("block"))
        some = dealt.join(F.broadcast(blobs.where(F.col("block").between(at, last))), "block")
        parts.append(some.select("ids", "labels", "q", "width", "own").mapInArrow(run, ddl))
    return reduce(DataFrame.unionAll, parts)


def narrowed(chunks: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, wide: bool) -> DataFrame:
    """Windows whose range is the bucket that holds their kth row."""

    def count(x, scores, ids):
        if x["by"] == "score":  # from the highest
            found, counts, shift = buckets((x["hi"] - scores).astype(np.uint64), x["hi"] - x["lo"], x["need"])
            return [(b, max(x["lo"], x["hi"] - ((b + 1) << shift) + 1), x["hi"] - (b << shift), n) for b, n in zip(found, counts)]
        ids = ids[(ids >= x["ilo"]) & (ids <= x["ihi"])]  # from the smallest; differences wrap, so none overflows
        found, counts, shift = buckets(ids.view(np.uint64) - np.uint64(x["ilo"] % 2**64), x["ihi"] - x["ilo"], x["need"])
        return [(b, x["ilo"] + (b << shift), min(x["ihi"], x["ilo"] + ((b + 1) << shift) - 1), n) for b, n in zip(found, counts)]

    undone = windows.where("by <> 'done'")
    counts = over_chunks(chunks, anchors, undone, blocks, count, "anchor long, other long, bucket long, first long, last long, n long", wide)
    counts = counts.groupBy("anchor", "other", "bucket", "first", "last").agg(F.sum("n").alias("n"))
    from_best = Window.partitionBy("anchor", "other").orderBy("bucket")
    upto = counts.join(undone.select("anchor", "other", F.col("need").alias("_need")), ["anchor", "other"]).withColumn("upto", F.sum("n").over(from_best))
    kth = upto.where("upto >= _need AND upto - n < _need").select("anchor", "other", "first", "last", (F.col("_need") - F.col("upto") + F.col("n")).cast("int").alias("left"), (F.col("upto") == F.col("_need")).alias("whole"))
    joined = windows.join(kth, ["anchor", "other"], "left")
    few, by_score = F.col("first").isNull(), F.col("by") == "score"  # fewer rows than k: all of them
    ends = few | F.col("whole")
    return joined.select(
        "anchor", "other", "same", F.when(by_score & ~few, F.col("first")).otherwise(F.col("lo")).alias("lo"), F.when(by_score & ~few, F.col("last")).otherwise(F.col("hi")).alias("hi"), "top",
        F.when(~by_score & ~few, F.col("first")).otherwise(F.col("ilo")).alias("ilo"), F.when(~by_score & ~few, F.col("last")).otherwise(F.col("ihi")).alias("ihi"),
        F.coalesce("left", "need").alias("need"),
        F.when((F.col("by") == "done") | ends, "done").when(by_score & (F.col("first") < F.col("last")), "score").otherwise("id").alias("by"),
        F.when(by_score & ends, F.coalesce("first", "lo")).when(~by_score & (F.col("by") != "done"), F.col("lo")).otherwise(F.col("cut")).alias("cut"),
        F.when((F.col("by") == "id") & ends, F.coalesce("last", "ihi")).otherwise(F.col("icut")).alias("icut"),
    )


def best(chunks: DataFrame, anchors: DataFrame, windows: DataFrame, blocks: int, wide: bool) -> DataFrame:
    """anchor, other, vec_id, score, rank: the first ``need`` rows of every window."""
    windows = materialise(windows, "windows")
    while not windows.where("by <> 'done'").isEmpty():
        windows = materialise(narrowed(chunks, anchors, windows, blocks, wide), "windows")

    def gather(x, scores, ids):
        keep = (scores > x["cut"]) | (ids <= x["icut"])
        return list(zip(ids[keep].tolist(), scores[keep].tolist()))

    found = over_chunks(chunks, anchors, windows, blocks, gather, "anchor long, other long, vec_id long, score long", wide)
    order = Window.partitionBy("anchor", "other").orderBy(F.desc("score"), "vec_id")
    return materialise(found.withColumn("rank", F.row_number().over(order)), "best")


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: Column | None = None, relabel: Column | None = None,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product. An anchor's
    positives are its first ``positives`` other rows of its label, and for each the first
    ``negatives`` rows of other labels are returned whose score lies between ``low`` and ``high``
    per cent of the positive's; higher scores come first, ties by smaller id. ``anchor`` says
    which rows are anchors (default: all).

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Of rows that repeat an id the one with the least label, then components, counts. Equal
    vectors are ranked by id. An empty table gives no rows; other columns are ignored. Vectors
    of several widths, and scores that might pass 62 bits, are errors.
    """
    spark = df.sparkSession
    text_batches(spark)
    rows = materialise(quantised(df, id_col, vector_col, label_col, relabel, scale), "quantised")
    chunks = materialise(packed(rows.select("vec_id", "label", "q")), "chunks")
    longest = chunks.agg(F.coalesce(F.max("longest"), F.lit(0.0))).first()[0]
    if longest >= 2.0**62:
        raise ValueError("components are too large for 64-bit scores")
    least, most = rows.agg(F.coalesce(F.min("vec_id"), F.lit(0)), F.coalesce(F.max("vec_id"), F.lit(0))).first()
    own = rows.where(anchor) if anchor is not None else rows
    blocks = max(1, -(-own.count() // ANCHORS_A_BLOCK))
    anchors = materialise(own.select(F.col("vec_id").alias("anchor"), "label", "q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")), "anchors")
    wide = longest >= 2.0**53
    ids = [F.lit(v).cast("long").alias(c) for c, v in (("ilo", least), ("ihi", most))]

    def windows(over: DataFrame, other, same: bool, lo, hi, need: int) -> DataFrame:
        state = over.select("anchor", F.lit(other).cast("long").alias("other") if isinstance(other, int) else other.alias("other"), F.lit(same).alias("same"), lo.alias("lo"), hi.alias("hi"))
        return state.where("lo <= hi").select("*", F.col("hi").alias("top"), *ids, F.lit(need).alias("need"), F.lit("score").alias("by"), F.col("lo").alias("cut"), F.lit(most).cast("long").alias("icut"))

    reach = F.lit(int(longest) + 1).cast("long")
    near = best(chunks, anchors, windows(anchors, 0, True, -reach, reach, positives), blocks, wide).select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score"))
    # integers s with low * p <= 100 * s <= high * p; none where p is negative
    p = "CAST(positive_score AS DECIMAL(20, 0))"
    at_least, at_most = F.expr(f"CAST(({p} * {low} + 99) div 100 AS BIGINT)"), F.expr(f"CAST(({p} * {high}) div 100 AS BIGINT)")
    bands = windows(near.where("positive_score >= 0"), F.col("positive"), False, at_least, at_most, negatives)
    found = best(chunks, anchors, bands, blocks, wide).select("anchor", F.col("other").alias("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor", "positive"]).select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH flat AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS q FROM flat),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.q * b.q) AS BIGINT) AS score
  FROM cells a JOIN cells b USING (i) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

"""Exact duplicates by content sort, in DataFrame functions only.

1. Rows are dealt by Spark's sampled range splitters over the normalised content (its head, then
   a 64-bit hash of the whole, so that a splitter is short). Each partition is sorted
   externally, and each row's whole normalised text is compared with its neighbour's: where
   they differ, a new run of equal texts begins. Rows of one content have one splitter key, so
   a run is the whole group and is settled on the spot.
2. Only the texts that very many rows share are dealt to several partitions (``hot_keys``: by
   count, at most ``MOST_HOT`` keys whatever the corpus, so the list has a proven bound and is
   broadcast). The first rows of their runs are sorted and compared by content once more, and
   rows of these texts learn the outcome through their run's number.

No row is dropped or sampled for that, and no digest decides what is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_HOT, ascii_lower, materialise

HEAD_CHARS = 48
RUN = ["head", "hash", "salt", "run"]


def normalised(text: Column) -> Column:
    """Null is the empty text; A-Z are lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def hot_keys(df: DataFrame, text_col: str, least: int) -> DataFrame:
    """hash, salts: content hashes of more than ``least`` rows and of more than one row in
    ``MOST_HOT`` of all, with the number of parts that brings a part below that size."""
    counts = materialise(df.groupBy(F.xxhash64(normalised(F.col(text_col))).alias("hash")).agg(F.count(F.lit(1)).alias("n")), "content-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(least, total // MOST_HOT)
    return counts.where(F.col("n") > share).select("hash", F.ceil(F.col("n") / share).cast("int").alias("salts"))


def sorted_runs(df: DataFrame, carried: Column, norm: Column, id_col: str, text_col: str, keep: str, least: int) -> DataFrame:
    """row, id, the run's key (``RUN``), hot, and first: whether the run begins with this row.

    ``norm`` is the normalised text again, as an expression over ``row`` (what is carried)."""
    hot = F.broadcast(hot_keys(df, text_col, least))
    text = normalised(F.col(text_col))
    keyed = df.select(carried.alias("row"), F.col(id_col).alias("id"), F.substring(text, 1, HEAD_CHARS).alias("head"), F.xxhash64(text).alias("hash"))
    # ids may repeat or be null, so the parts of a hot text are filled by the rows' places
    keyed = keyed.join(hot, "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"), F.lit(0)))
    dealt = keyed.select("row", "id", "head", "hash", "salt", F.col("salts").isNotNull().alias("hot")).repartitionByRange("head", "hash", "salt").withColumn("norm", norm)
    by_id = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    in_order = Window.partitionBy("head", "hash", "salt").orderBy("norm", by_id)
    begins = F.coalesce(F.lag("norm").over(in_order) != F.col("norm"), F.lit(True))
    compared = dealt.withColumn("first", begins)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return compared.withColumn("run", F.sum(F.col("first").cast("int")).over(upto).cast("int"))


def met_runs(firsts: DataFrame, keep: str) -> DataFrame:
    """Runs of hot texts (``RUN``, norm, id, n), compared by content across their parts: ``RUN``,
    keep_id, group_size and winner (the run that holds the row that stays)."""
    best = [F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last(), F.col("salt"), F.col("run")]
    in_order = Window.partitionBy("head", "hash").orderBy("norm", *best)
    new = F.coalesce(F.lag("norm").over(in_order) != F.col("norm"), F.lit(True))
    text = F.sum(F.col("new").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = firsts.withColumn("new", new).withColumn("text", text).drop("norm")
    group = Window.partitionBy("head", "hash", "text")
    return rows.select(*RUN, F.first("id").over(group.orderBy(*best)).alias("keep_id"), F.sum("n").over(group).alias("group_size"), F.col("new").alias("winner"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", least: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null is the empty text. Of a group
    the row with the smallest (``keep='min'``) or largest id stays; a null id stays only where
    no row of the group has one (keep_id is then null). Exactly one row of a group is kept,
    also where rows repeat an id. An empty table gives no rows; other columns are ignored.
    """
    runs = sorted_runs(df, normalised(F.col(text_col)), F.col("row"), id_col, text_col, keep, least)
    digest = F.sha2("norm", 256).alias("text_sha256")
    rows = materialise(runs.select("id", *RUN, "hot", "first", digest, F.when(F.col("hot") & F.col("first"), F.col("norm")).alias("norm")), "exact-runs")
    run = Window.partitionBy(*RUN)
    sizes = rows.where("hot").groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    met = materialise(met_runs(rows.where("hot and first").select(*RUN, "norm", "id").join(sizes, RUN), keep), "hot-runs")
    cold = rows.where("not hot").select("id", F.first("id").over(run.orderBy(F.desc("first"))).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"), F.col("first").alias("kept"), "text_sha256")
    hot = rows.where("hot").join(met, RUN).select("id", "keep_id", "group_size", (F.col("first") & F.col("winner")).alias("kept"), "text_sha256")
    return cold.unionAll(hot).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", least: int = 256) -> DataFrame:
    """The rows of ``df`` that stay, with its columns as they were: one of each group, by the
    same rules as ``exact_groups`` (null and empty texts are one group, rows that repeat an id
    or have none are told apart, an empty table gives no rows)."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    runs = sorted_runs(df, own, normalised(F.col(f"row.`{text_col}`")), id_col, text_col, keep, least)
    firsts = materialise(runs.where("first").select("row", "id", *RUN, "hot", F.when(F.col("hot"), F.col("norm")).alias("norm")), "exact-firsts")
    winners = met_runs(firsts.where("hot").select(*RUN, "norm", "id", F.lit(1).alias("n")), keep).where("winner").select(*RUN)
    met = firsts.where("hot").join(materialise(winners, "hot-winners"), RUN, "left_semi")
    return firsts.where("not hot").select("row.*").unionAll(met.select("row.*"))


OP6_SQL = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
hashed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM norm)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""

"""Shared helpers of the corpus operators: table access, Arrow batches, joins of hot keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, materialise, shared_folder, text_batches

__all__ = ["LARGE_ROWS", "MOST_HOT", "ascii_lower", "id_text", "materialise", "record_batch", "shared_folder", "split_join", "table", "text_batches"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read; a null text is the empty text."""
    text_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: At most so many keys are called hot, whatever the rows, so that a list of them is small.
MOST_HOT = 1 << 16


def split_join(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame, total: int, least: int = 256) -> DataFrame:
    """Inner join on ``key``, of which ``one`` has each value once, without a task that gets all
    rows of a hot value: ``sizes`` (key, n) counts the rows of ``many``; values with more than
    ``least`` of them, and more than one in ``MOST_HOT`` of all, are dealt in parts, to which
    their row of ``one`` is repeated. The list of such values is bounded and broadcast."""
    share = max(least, total // MOST_HOT)
    hot = F.broadcast(sizes.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_parts")))
    others = [F.col(c) for c in many.columns if c != key]
    dealt = many.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"]).drop("_part")


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

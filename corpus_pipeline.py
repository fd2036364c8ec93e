"""Corpus pipeline: rules, exact and near copies, personal data, packing.

``STAGES`` are applied in order; each result is written as Parquet to the shared folder and
read again as the next stage's documents. All but the last return the columns of
``documents``. Nulls, empty texts, repeated rows, empty tables and extra columns are handled
as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, near_copies, packing, pii, quality_rules
from tessera.llm.common import table
from tessera.session import remove_folder, scratch, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_exact_copies(docs, keep="min")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word similarity of 0.8 or more, the one with the smallest id."""
    return near_copies.drop_near_copies(docs, width=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data under the session's key; ``n_chars`` follows."""
    return pii.pseudonymise_column(docs, key=pii.session_key(spark), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids. Workers serve other stages too, so they remember little."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1, max_memo=300_000).drop("ids")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", pack)]

#: Sketches, near-copy components, Feistel pseudonyms and packing are beyond SQL; tests compare
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces. A stage's own tables, and the documents
    that it read, are removed when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if last is not None:
            remove_folder(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

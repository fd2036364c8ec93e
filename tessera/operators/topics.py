"""Topic lists from clause labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause_order, rotate, short_label, tidy_clause

MAX_ROUNDS = 64


def topic_base(chunks: DataFrame) -> DataFrame:
    """doc_id, clause, doc_title, first_seen, page of every clause that is not blank."""
    named = chunks.where(F.col("clause").isNotNull() & (F.trim("clause") != ""))
    return named.groupBy("doc_id", "clause").agg(F.min_by("doc_title", "chunk_index").alias("doc_title"), F.min("chunk_index").alias("first_seen"), F.min("page_from").alias("page"))


def corpus_topics(chunks: DataFrame, limit: int | None = 6, ready: DataFrame | None = None) -> DataFrame:
    """place, doc_id, doc_label, clause, page: the i-th clause of each document in turn,
    documents by title. ``ready`` (doc_id) restricts to ready documents."""
    if ready is not None:
        chunks = chunks.join(ready.select("doc_id"), "doc_id", "left_semi")
    base = topic_base(chunks).withColumn("clause", tidy_clause("clause")).where(F.col("clause").isNotNull())
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(clause_order("clause"), "first_seen"))
    turned = base.withColumn("turn", turn).where(F.col("turn") <= MAX_ROUNDS)
    if limit is not None:
        turned = turned.orderBy("turn", "doc_title", "doc_id").limit(limit)
    place = F.row_number().over(Window.orderBy("turn", "doc_title", "doc_id"))
    return turned.select(place.alias("place"), "doc_id", short_label("doc_title").alias("doc_label"), "clause", "page")


def suggestions(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """query_id, topics: the (few) topics as an array, rotated by each query's text."""
    listed = topics.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_label", "clause"))), lambda t: F.struct(t["doc_label"].alias("doc_label"), t["clause"].alias("clause"))).alias("all"))
    return queries.crossJoin(listed).select("query_id", rotate("all", "query").alias("topics"))  # one row

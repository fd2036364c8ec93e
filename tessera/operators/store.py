"""Store semantics on DataFrames: readiness, keys, upsert, resume, finalise, statistics.

A change is a new DataFrame; ``sources.store`` swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "chunk_index"]


def ready_only(chunks: DataFrame, documents: DataFrame, doc: str | None = None) -> DataFrame:
    """Chunks of ready documents, of one document if named. The documents side is one narrow
    key column; Spark broadcasts it where its size allows."""
    if doc is not None:
        chunks, documents = chunks.where(F.col("doc_id") == doc), documents.where(F.col("doc_id") == doc)
    return chunks.join(documents.where("status = 'ready'").select("doc_id"), "doc_id", "left_semi")


def keep_lowest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = KEY, order: list[str | Column] | None = None) -> DataFrame:
    """New rows, and the old ones whose key is not among them. Of new rows that share a key the
    first by ``order`` stays (give what makes the last writer first); without an order, or
    where it ties, the first by all their columns as text, so that the result is the same in
    every run."""
    rest = [F.to_json(F.struct(*[c for c in new.columns if c not in keys])).desc()]
    fresh = keep_lowest(new, keys, [*(order or []), *rest])
    return fresh.select(old.columns).unionByName(old.join(fresh.select(*keys), keys, "left_anti").select(old.columns))


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` are replaced by its rows."""
    touched = new.select("doc_id").distinct()
    return old.join(touched, "doc_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def to_do(wanted: DataFrame, stored: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Chunks that are not stored yet: the resume set's complement."""
    return wanted.join(stored.select(*keys), keys, "left_anti")


def begin_documents(state: DataFrame, starting: DataFrame) -> DataFrame:
    """``starting`` (doc_id, content_hash) with resumable: a pending run of the same content."""
    prior = state.select("doc_id", F.col("status").alias("_status"), F.col("content_hash").alias("_hash"))
    same = (F.col("_status") == "pending") & F.col("_hash").isNotNull() & (F.col("_hash") == F.col("content_hash"))
    return starting.join(prior, "doc_id", "left").withColumn("resumable", F.coalesce(same, F.lit(False))).drop("_status", "_hash")


def finalise(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_count, embedded_count, promoted, status: a document is ready when as many
    distinct chunks are stored as it has (a chunk stored twice counts once)."""
    stored = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_index").alias("embedded_count"))
    joined = documents.select("doc_id", "chunk_count", "status").join(stored, "doc_id", "left").withColumn("embedded_count", F.coalesce("embedded_count", F.lit(0)))
    enough = F.col("embedded_count") >= F.col("chunk_count")
    return joined.select("doc_id", "chunk_count", "embedded_count", ((F.col("status") != "ready") & enough).alias("promoted"), F.when(enough, "ready").otherwise(F.col("status")).alias("status"))


def delete_documents(chunks: DataFrame, documents: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, one row removed_docs, removed_chunks)."""
    names = gone.select("doc_id").distinct()
    removed = documents.join(names, "doc_id", "left_semi").agg(F.count("*").alias("removed_docs")).crossJoin(chunks.join(names, "doc_id", "left_semi").agg(F.count("*").alias("removed_chunks")))
    return chunks.join(names, "doc_id", "left_anti"), documents.join(names, "doc_id", "left_anti"), removed


def orphans(stored: DataFrame, bundle: DataFrame) -> DataFrame:
    """Stored documents that a bundle does not have."""
    return stored.join(bundle.select("doc_id"), "doc_id", "left_anti")


def corpus_stats(documents: DataFrame) -> DataFrame:
    """One row: doc_count and chunk_count of ready documents, pending_count."""
    ready = F.col("status") == "ready"
    return documents.agg(
        F.count_if(ready).alias("doc_count"),
        F.coalesce(F.sum(F.when(ready, F.col("chunk_count"))), F.lit(0)).cast("long").alias("chunk_count"),
        F.count_if(F.col("status") == "pending").alias("pending_count"),
    )


def health(documents: DataFrame) -> DataFrame:
    """One row: status (ok, or degraded without a ready chunk), ready and pending documents,
    chunks, scanned documents (which cannot be cited)."""
    counts = corpus_stats(documents).crossJoin(documents.agg(F.count_if("is_scanned").alias("scanned")))  # one row each
    return counts.withColumn("status", F.when(F.col("chunk_count") > 0, "ok").otherwise("degraded"))


def verify_load(documents: DataFrame, chunks: DataFrame, expected_docs: int, expected_chunks: int) -> DataFrame:
    """One row: docs, chunks, not_ready, promised (sum of chunk counts) and ok."""
    d = documents.agg(F.count("*").alias("docs"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("promised"), F.count_if(F.col("status") != "ready").alias("not_ready"))
    both = d.crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each
    ok = (F.col("docs") == expected_docs) & (F.col("chunks") == expected_chunks) & (F.col("promised") == expected_chunks) & (F.col("not_ready") == 0)
    return both.withColumn("ok", ok)


def backfill_embedded(documents: DataFrame) -> DataFrame:
    """Ready documents of old stores without a count have all their chunks."""
    return documents.withColumn("embedded_count", F.when((F.col("status") == "ready") & (F.col("embedded_count") == 0), F.col("chunk_count")).otherwise(F.col("embedded_count")))


def pending(documents: DataFrame) -> DataFrame:
    """Documents of a run that has not ended, by source file."""
    return documents.where("status = 'pending'").select("doc_id", "source_file", "chunk_count", "embedded_count").orderBy("source_file", "doc_id")


def citable(documents: DataFrame) -> DataFrame:
    return documents.where("not is_scanned").select("doc_id", "doc_title", "source_file", "page_count")


def listing(documents: DataFrame) -> DataFrame:
    return documents.where("status = 'ready'").select("doc_id", "doc_title").orderBy("doc_title", "doc_id")


def document_source(documents: DataFrame, doc_id: str) -> DataFrame:
    """The ready document of an id: one row or none."""
    return documents.where((F.col("doc_id") == doc_id) & (F.col("status") == "ready"))


def index_change(stored: dict | None, wanted: dict) -> str:
    """What a changed fingerprint asks for: keep, rewrite, wipe or recreate."""
    if stored is None:
        return "rewrite"
    if stored["dims"] != wanted["dims"]:
        return "recreate"
    return "keep" if (stored["provider"], stored["model"]) == (wanted["provider"], wanted["model"]) else "wipe"


def should_prune(results: DataFrame, selected: int, keep_stale: bool = False) -> tuple[bool, str, list[str]]:
    """(prune, reason, failed files) of an ingest run; ``results`` is one row a file: file,
    chunks, error, skipped, reason. Only the aggregate and failed names reach the driver."""
    if keep_stale:
        return False, "keep-stale", []
    bad = F.col("error").isNotNull() | (F.coalesce("skipped", F.lit(False)) & (F.coalesce("reason", F.lit("")) != "unchanged"))
    row = results.agg(F.count("*").alias("n"), F.count_if((F.coalesce("chunks", F.lit(0)) > 0) | (F.coalesce("reason", F.lit("")) == "unchanged")).alias("landed"), F.array_sort(F.collect_list(F.when(bad, F.col("file")))).alias("failed")).first()
    if not selected or not row["landed"] and not row["failed"]:
        return False, "empty-selection", []
    return (False, "ingest-failed", row["failed"]) if row["failed"] else (True, "ok", [])

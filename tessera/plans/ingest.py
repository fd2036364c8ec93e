"""The indexing plan: pages to chunks to vectors to a store, and snapshot import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.models import embed, embed_within
from ..functions.text import embeddable_text
from ..operators import chunking, pages, store
from ..session import materialise
from ..sources.snapshot import FORMAT, SnapshotError, pdf_report, read_bundle, summarise_pdfs
from ..sources.store import CHUNKS, Store


def documents_from_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): running heads off, titles found, scanned documents marked and left
    out of the pages. raw: doc_id, source_file, page_number, text."""
    report = pages.scan_report(raw)
    titles = pages.document_titles(raw)
    docs = report.join(titles, "doc_id").join(raw.groupBy("doc_id").agg(F.min("source_file").alias("source_file"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\f"), 256).alias("content_hash")), "doc_id")
    text = pages.strip_running_heads(raw.select("doc_id", "page_number", "text"))
    usable = docs.where("not is_scanned").select("doc_id", "doc_title")
    return text.join(usable, "doc_id"), docs


def index_pages(raw: DataFrame, to: Store, embedder: Callable, dims: int, settings: Settings = Settings(), cap: int | None = None, kind: str = "cloud") -> None:
    """Chunk, embed and store; chunks that a stopped run of the same content stored already are
    not embedded again; a document turns ready when all its chunks are there. With ``cap`` at most
    so many requests are sent, none for documents that are ready with the same content; those whose
    chunks had to wait stay pending, and the next run goes on with them."""
    # read by several branches: extracted and chunked once
    raw = materialise(raw, "pages")
    text, docs = documents_from_pages(raw)
    docs = materialise(docs, "document-reports")
    chunks = materialise(chunking.chunk_documents(text, settings), "chunked")
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    meta = docs.join(counts, "doc_id")
    if cap is not None:  # requests are few: what is ready and the same is left alone
        same = to.read("documents").where("status = 'ready'").select("doc_id", "content_hash")
        meta = materialise(meta.join(same, ["doc_id", "content_hash"], "left_anti"), "documents-to-index")
        chunks = chunks.join(meta.select("doc_id"), "doc_id", "left_semi")
    begun = store.begin_documents(to.read("documents"), meta.select("doc_id", "content_hash"))
    resumable = begun.where("resumable").select("doc_id")
    rows = meta.select(
        "doc_id", "doc_title", "source_file", F.col("total_pages").cast("int").alias("page_count"), "chunk_count", "is_scanned",
        F.current_timestamp().alias("ingested_at"), F.lit("pending").alias("status"), F.lit(0).alias("embedded_count"), "content_hash",
    )
    # chunks of a document that begins anew are all to do; of the others those that are not stored
    again, _ = to.to_do(chunks.join(resumable, "doc_id", "left_semi"))
    todo = chunks.join(resumable, "doc_id", "left_anti").unionByName(again)
    todo = todo.withColumn("_input", embeddable_text("doc_title", "clause", "page_from", "heading", "content"))
    if cap is None:
        done = embed(todo, "_input", embedder, dims, settings.embed_batch_size)
    else:
        done = embed_within(todo, "_input", embedder, dims, cap, settings.embed_batch_size, kind).where("embedding IS NOT NULL")
    new = done.select(F.xxhash64("doc_id", "chunk_index").alias("id"), *[c.split()[0] for c in CHUNKS.split(", ")[1:-2]], F.col("embedding"), F.current_timestamp().alias("created_at"))
    touched = meta.select("doc_id")
    to.change(
        touched=touched,
        chunks=lambda old: old.join(touched, "doc_id", "left_anti").unionByName(old.join(resumable, "doc_id", "left_semi")).unionByName(new),
        documents=lambda old: to.promoted(touched)(store.upsert(old, rows, ["doc_id"])),
    )


def import_and_report(spark: SparkSession, folder: str, to: Store, embed_config: dict, pdfs: DataFrame, settings: Settings = Settings(), replace: bool = False, format_name: str = FORMAT) -> tuple[DataFrame, DataFrame, str]:
    """``import_bundle``, then how the bundle's documents stand to the files that are there:
    (orphans, report, summary). ``pdfs``: source_file, sha256."""
    orphans = import_bundle(spark, folder, to, embed_config, settings, replace, format_name)
    docs, _, _ = read_bundle(spark, folder, embed_config, settings, format_name)
    digest = F.col("pdf.sha256") if "pdf" in docs.columns else F.lit(None).cast("string")
    report = materialise(pdf_report(docs.select("doc_id", "source_file", digest.alias("sha256")), pdfs), "pdf-report")
    return orphans, report, summarise_pdfs(report)


def import_bundle(spark: SparkSession, folder: str, to: Store, embed_config: dict, settings: Settings = Settings(), replace: bool = False, format_name: str = FORMAT) -> DataFrame:
    """Check configuration and checksums, compare with the store, verify what was read against
    the manifest, then load it and its fingerprint by one change; returns the stored documents that the bundle does
    not have (reported and kept, or with ``replace`` gone)."""
    docs, chunks, manifest = read_bundle(spark, folder, embed_config, settings, format_name)
    held = to.fingerprint()
    if held is not None and not replace and store.index_change(held, embed_config) != "keep":
        raise SnapshotError("the store holds vectors of another model; use replace")
    created = F.to_timestamp(F.lit(manifest["createdAt"]))
    full_docs = docs.select("doc_id", "doc_title", "source_file", "page_count", "chunk_count", "is_scanned", created.alias("ingested_at"), "status", "embedded_count", F.lit(None).cast("string").alias("content_hash"))
    full = chunks.select(F.xxhash64("doc_id", "chunk_index").alias("id"), "doc_id", "doc_title", "page_from", "page_to", "clause", "chunk_index", "content", "embedding", created.alias("created_at"))
    full_docs, full = materialise(full_docs, "bundle-documents"), materialise(full, "bundle-chunks")
    check = store.verify_load(full_docs, full, manifest["corpus"]["docCount"], manifest["corpus"]["chunkCount"]).first()
    if not check["ok"]:
        raise SnapshotError(f"load differs from the manifest: {check.asDict()}")
    orphans = materialise(store.orphans(to.read("documents"), full_docs), "orphans")
    mark = {k: embed_config[k] for k in ("provider", "model", "dims")}
    if replace:
        to.change(fingerprint=mark, documents=lambda _: full_docs, chunks=lambda _: full)
    else:
        to.change(touched=full_docs, fingerprint=mark, documents=lambda old: store.upsert(old, full_docs, ["doc_id"]), chunks=lambda old: store.replace_documents(old, full))
    return orphans

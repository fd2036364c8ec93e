"""Queries of the store, topics, calibration, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clause_order, human_bytes, rotate, short_label, tidy_clause
from ..operators import calibrate, store, topics
from ..sources import snapshot
from ..session import shared_folder
from ..streaming import ingest, progress
from .carriers import SQL_DOCUMENTS, chunks, documents, table, vectors

LINE_KEY = ["l_orderkey", "l_linenumber"]
REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def dedupe_keep_lowest(spark, d):
    kept = store.keep_lowest(table(spark, d, "lineitem"), LINE_KEY, REST)
    return kept.select(*LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _counted(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("n_chars").alias("size"))


def upsert_merge(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("size"))
    new = table(spark, d, "documents").select("doc_id", "source").join(lab, "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), "size")
    again = new.withColumn("size", F.col("size") + 10)  # every key twice: the last writer wins
    return store.upsert(_counted(spark, d), new.unionAll(again), order=[F.desc("size")])


def replace_documents(spark, d):
    new = table(spark, d, "documents").where("lang = 'fr' and source in ('src1', 'src2', 'src3')").select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1_000_000).alias("chunk_index"), F.col("n_chars").alias("size"))
    return store.replace_documents(_counted(spark, d), new)


def resume_antijoin(spark, d):
    stored = vectors(spark, d).select(F.col("id").alias("doc_id"))
    return store.to_do(table(spark, d, "documents").select("doc_id", "n_chars"), stored, ["doc_id"])


def begin_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "lang")
    state = documents(spark, d).select("doc_id", "status").join(docs.where("lang <> 'de'").select("doc_id", "content_hash"), "doc_id", "left")
    return store.begin_documents(state, docs.select("doc_id", "content_hash")).select("doc_id", "resumable")


def finalize_guard(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.groupBy(F.col("source").alias("doc_id")).agg(F.floor(F.count("*") * 0.4).alias("chunk_count")).withColumn("status", F.lit("pending"))
    stored = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"))
    return store.finalise(wanted, stored.unionAll(stored))


def orphans(spark, d):
    return store.orphans(vectors(spark, d).select(F.col("id").alias("doc_id"), "label"), table(spark, d, "labels"))


def corpus_stats(spark, d):
    return store.corpus_stats(documents(spark, d))


def health(spark, d):
    return store.health(documents(spark, d))


def load_verify(spark, d):
    docs = documents(spark, d)
    n = docs.agg(F.count("*"), F.sum("chunk_count")).first()
    return store.verify_load(docs, vectors(spark, d), n[0], n[1])


def citable(spark, d):
    return store.citable(documents(spark, d))


def document_titles_ready(spark, d):
    return store.listing(documents(spark, d))


def backfill_embedded(spark, d):
    docs = documents(spark, d).withColumn("embedded_count", F.when(F.col("page_count") > 2, F.col("chunk_count")).otherwise(0))
    return store.backfill_embedded(docs).select("doc_id", "status", "chunk_count", "embedded_count")


def delete_documents(spark, d):
    docs = documents(spark, d)
    c = vectors(spark, d).select(F.col("id").cast("string").alias("doc_id"))
    return store.delete_documents(c, docs, docs.where("is_scanned"))[2]


def _clauses(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("the "), "p_brand").alias("doc_title"), F.col("p_partkey").alias("chunk_index"), F.col("p_size").alias("page_from"), F.concat_ws(".", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 12).cast("string"))).alias("clause"))


def topics_round_robin(spark, d):
    got = topics.corpus_topics(_clauses(spark, d), 18)
    return got.select(F.col("place").cast("long").alias("place"), "doc_id", "doc_label", "clause", "page")


def clause_sort(spark, d):
    from pyspark.sql import Window

    distinct = _clauses(spark, d).select("clause").distinct().where(tidy_clause("clause").isNotNull())
    return distinct.select("clause", F.row_number().over(Window.orderBy(clause_order("clause"))).cast("long").alias("place"))


def topic_rotate(spark, d):
    names = table(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("names"))
    return table(spark, d, "customer").crossJoin(names).select("c_custkey", F.array_join(rotate("names", "c_name"), ",").alias("rotated"))  # names is one row


def labels_and_sizes(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", human_bytes((F.col("o_totalprice") * F.col("o_orderkey")).cast("long")).alias("size"), short_label(F.concat(F.lit("The order, "), "o_orderpriority", F.lit(", of customer number "), F.col("o_custkey").cast("string"), F.lit(" — draft"))).alias("label"))


def _probes(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select(F.when(F.col("quality") == 1, "in").otherwise("out").alias("label"), (F.col("n_chars") / 1000).alias("score"))


def calibrate_distributions(spark, d):
    return calibrate.distributions(_probes(spark, d))


def calibrate_verdict(spark, d):
    return calibrate.verdict(_probes(spark, d))


def calibrate_gap(spark, d):
    rows = _probes(spark, d).withColumn("score", F.when(F.col("label") == "in", 1 + F.col("score")).otherwise(1 / (1 + F.col("score"))))
    return calibrate.verdict(rows).select(*[F.round(c, 9).alias(c) if c != "overlapping" else c for c in ("max_out", "min_in", "overlapping", "suggestion")])


def probe_scores(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_type") == "purchase").alias("relevant"), F.col("value").alias("score"))
    got = calibrate.probe_scores(e)
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


def manifest_counts(spark, d):
    return snapshot.manifest_counts(documents(spark, d), vectors(spark, d))


def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def pdf_report(spark, d):
    docs = documents(spark, d).select("doc_id", F.when(F.col("page_count") > 1, F.concat("doc_id", F.lit(".pdf"))).alias("source_file"), F.when(~F.col("is_scanned"), F.md5("doc_id")).alias("sha256"))
    files = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.md5(F.when(F.col("quality") == 1, F.col("doc_id").cast("string")).otherwise("x")).alias("sha256"))
    return snapshot.pdf_report(docs, files)


def event_windows(spark, d):
    return ingest.arrivals(table(spark, d, "events"))


def snapshot_roundtrip(spark, d):
    """Export all chunks and documents, read them back through every check."""
    c, docs = chunks(spark, d), documents(spark, d).withColumnRenamed("doc_title", "t").withColumn("doc_title", F.col("t")).drop("t")
    embed = {"provider": "local", "model": "test/64", "dims": 64}
    folder = snapshot.export_bundle(docs, c, shared_folder(spark, "snapshots"), embed)
    _, back, _ = snapshot.read_bundle(spark, folder, embed)
    return back.select("doc_id", "chunk_index", F.sha2("content", 256).alias("sha256"), F.size("embedding").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def stream_ingest(spark, d):
    """Land all chunks as a stream of files, upsert them into a store, read the store."""
    from ..sources.store import CHUNKS, Store

    root = shared_folder(spark, "stream")
    landed = chunks(spark, d).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    landed.select(*[x.split()[0] for x in CHUNKS.split(", ")]).write.parquet(f"{root}/landing")
    kept = Store(spark, f"{root}/store")
    ingest.ingest_stream(spark, f"{root}/landing", kept, f"{root}/checkpoint").awaitTermination()
    return kept.read("chunks").select("doc_id", "chunk_index", F.sha2("content", 256).alias("sha256"))


def store_resume(spark, d):
    """Of all texts, as chunks of their source, those that a store of the ones with vectors lacks;
    the store's key filters say which of its partitions need not be read."""
    from ..sources.store import CHUNKS, Store

    kept = Store(spark, f"{shared_folder(spark, 'resume')}/store")
    held = chunks(spark, d).withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).select(*[x.split()[0] for x in CHUNKS.split(", ")])
    kept.change(chunks=lambda _: held)
    wanted = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("chunk_index"), "n_chars")
    return kept.to_do(wanted)[0]


def stream_progress(spark, d):
    """Each source as a document that begins, and its texts as chunks, a labelled one twice; in
    two batches. The last that the stream tells of each document."""
    docs = table(spark, d, "documents")
    begun = docs.groupBy(F.col("source").alias("doc_id")).agg((F.count("*") + F.when(F.max("doc_id") % 2 == 0, 0).otherwise(1)).cast("int").alias("chunk_count")).withColumn("chunk_index", F.lit(None).cast("long"))
    there = docs.select(F.col("source").alias("doc_id"), F.lit(None).cast("int").alias("chunk_count"), F.col("doc_id").alias("chunk_index"))
    again = there.join(table(spark, d, "labels").select(F.col("doc_id").alias("chunk_index")), "chunk_index").select(there.columns)
    root = shared_folder(spark, "progress")
    for n, part in enumerate((there.where("chunk_index % 3 = 0").unionAll(begun), there.where("chunk_index % 3 <> 0").unionAll(again))):
        part.coalesce(1).write.mode("append").parquet(f"{root}/landing")
        progress.follow(spark, f"{root}/landing", f"{root}/told", f"{root}/checkpoint").awaitTermination()
    told = spark.read.schema(progress.PROGRESS).parquet(f"{root}/told")
    # a document whose chunks come again after it was ready is told of once more, without a count
    told = told.where("chunk_count IS NOT NULL")
    return told.groupBy("doc_id").agg(F.max("chunk_count").alias("chunk_count"), F.max("embedded_count").alias("embedded_count"), F.max_by("status", F.struct("embedded_count", F.col("status") == "ready")).alias("status"))


DOCS = f"docs AS ({SQL_DOCUMENTS})"
CLAUSES = "c AS (SELECT p_brand AS doc_id, 'the ' || p_brand AS doc_title, p_partkey AS chunk_index, p_size AS page_from, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.' || (p_partkey % 12) ELSE CAST(p_size AS VARCHAR) END AS clause FROM part)"
PROBES = "p AS (SELECT CASE WHEN quality = 1 THEN 'in' ELSE 'out' END AS label, n_chars / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"
FIT = r"regexp_matches(clause, '^[1-9]\d{0,2}(?:\.\d{1,3}){0,2}$')"
NUMBERS = "CAST(string_split(clause, '.')[1] AS INTEGER)"
SECOND = "CAST(coalesce(string_split(clause, '.')[2], '0') AS INTEGER)"
CHUNKS_SQL = "SELECT source AS doc_id, CAST(d.doc_id AS INTEGER) AS chunk_index, sha256(text) AS sha256{more} FROM documents d JOIN embeddings ON d.doc_id = vec_id"

SQL = {
    "dedupe_keep_lowest": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(REST)}) AS n FROM lineitem) WHERE n = 1""",
    "upsert_merge": "SELECT source AS doc_id, d.doc_id AS chunk_index, coalesce(CAST(quality AS BIGINT) + 10, n_chars) AS size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "replace_documents": """WITH n AS (SELECT source AS doc_id, doc_id + 1000000 AS chunk_index, n_chars AS size FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3'))
SELECT * FROM n UNION ALL SELECT source, doc_id, n_chars FROM documents WHERE source NOT IN (SELECT doc_id FROM n)""",
    "resume_antijoin": "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "begin_documents": f"WITH {DOCS} SELECT docs.doc_id, status = 'pending' AND lang <> 'de' AS resumable FROM docs JOIN documents d ON docs.doc_id = CAST(d.doc_id AS VARCHAR)",
    "finalize_guard": """WITH w AS (SELECT source AS doc_id, CAST(floor(count(*) * 0.4) AS BIGINT) AS chunk_count FROM documents GROUP BY 1),
s AS (SELECT source AS doc_id, count(DISTINCT doc_id) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT w.doc_id, chunk_count, coalesce(n, 0) AS embedded_count, coalesce(n, 0) >= chunk_count AS promoted, CASE WHEN coalesce(n, 0) >= chunk_count THEN 'ready' ELSE 'pending' END AS status FROM w LEFT JOIN s ON w.doc_id = s.doc_id""",
    "orphans": "SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "corpus_stats": f"WITH {DOCS} SELECT count(*) FILTER (status = 'ready') AS doc_count, CAST(coalesce(sum(chunk_count) FILTER (status = 'ready'), 0) AS BIGINT) AS chunk_count, count(*) FILTER (status = 'pending') AS pending_count FROM docs",
    "health": f"""WITH {DOCS} SELECT count(*) FILTER (status = 'ready') AS doc_count, CAST(coalesce(sum(chunk_count) FILTER (status = 'ready'), 0) AS BIGINT) AS chunk_count, count(*) FILTER (status = 'pending') AS pending_count,
 count(*) FILTER (is_scanned) AS scanned, CASE WHEN coalesce(sum(chunk_count) FILTER (status = 'ready'), 0) > 0 THEN 'ok' ELSE 'degraded' END AS status FROM docs""",
    "load_verify": f"""WITH {DOCS} SELECT count(*) AS docs, CAST(sum(chunk_count) AS BIGINT) AS promised, count(*) FILTER (status <> 'ready') AS not_ready, (SELECT count(*) FROM embeddings) AS chunks,
 (SELECT count(*) FROM embeddings) = sum(chunk_count) AND count(*) FILTER (status <> 'ready') = 0 AS ok FROM docs""",
    "citable": f"WITH {DOCS} SELECT doc_id, doc_title, source_file, page_count FROM docs WHERE NOT is_scanned",
    "document_titles_ready": f"WITH {DOCS} SELECT doc_id, doc_title FROM docs WHERE status = 'ready'",
    "backfill_embedded": f"WITH {DOCS} SELECT doc_id, status, chunk_count, CASE WHEN page_count > 2 OR status = 'ready' THEN chunk_count ELSE 0 END AS embedded_count FROM docs",
    "delete_documents": f"WITH {DOCS}, g AS (SELECT doc_id FROM docs WHERE is_scanned) SELECT (SELECT count(*) FROM g) AS removed_docs, (SELECT count(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) IN (SELECT doc_id FROM g)) AS removed_chunks",
    "topics_round_robin": f"""WITH {CLAUSES}, b AS (SELECT doc_id, clause, min_by(doc_title, chunk_index) AS doc_title, min(page_from) AS page FROM c WHERE {FIT} GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {NUMBERS}, {SECOND}, len(string_split(clause, '.'))) AS turn FROM b)
SELECT row_number() OVER (ORDER BY turn, doc_title) AS place, doc_id, substr(doc_title, 5) AS doc_label, clause, page FROM t WHERE turn <= 64 ORDER BY place LIMIT 18""",
    "clause_sort": f"WITH {CLAUSES} SELECT clause, row_number() OVER (ORDER BY {NUMBERS}, {SECOND}, len(string_split(clause, '.'))) AS place FROM (SELECT DISTINCT clause FROM c WHERE {FIT})",
    "topic_rotate": """WITH n AS (SELECT list(r_name ORDER BY r_name) AS names FROM region),
h AS (SELECT c_custkey, names, list_reduce(list_transform(string_split(c_name, ''), lambda x: CAST(ord(x) AS HUGEINT)), lambda a, x: (xor(CAST(a AS BIGINT), CAST(x AS BIGINT))::HUGEINT * 16777619) % 4294967296, 2166136261::HUGEINT) AS h FROM customer, n),
s AS (SELECT c_custkey, names, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % len(names) AS BIGINT) AS start FROM h)
SELECT c_custkey, array_to_string(list_concat(list_slice(names, start + 1, len(names)), list_slice(names, 1, start)), ',') AS rotated FROM s""",
    "labels_and_sizes": """WITH t AS (SELECT o_orderkey, floor(o_totalprice * o_orderkey) AS n, 'order, ' || o_orderpriority || ', of customer number ' || o_custkey AS base FROM orders), h AS (SELECT *, left(base, 34) AS head FROM t)
SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS BIGINT) || ' B' WHEN n < 10240 THEN printf('%.1f KB', n / 1024) WHEN n < 1048576 THEN CAST(round(n / 1024) AS BIGINT) || ' KB' WHEN n < 10485760 THEN printf('%.1f MB', n / 1048576)
 WHEN n < 1073741824 THEN CAST(round(n / 1048576) AS BIGINT) || ' MB' WHEN n < 10737418240 THEN printf('%.1f GB', n / 1073741824) ELSE CAST(round(n / 1073741824) AS BIGINT) || ' GB' END AS size,
 CASE WHEN length(base) <= 34 THEN base WHEN regexp_matches(head, '^.{13,},[^,]*$') THEN regexp_extract(head, '^(.{13,}),[^,]*$', 1) ELSE regexp_extract(head, '^(.{13,}) [^ ]*$', 1) || '…' END AS label FROM h""",
    "calibrate_distributions": f"WITH {PROBES} SELECT label, count(*) AS n, min(score) AS low, max(score) AS high, list_sort(list(score))[count(*) // 2 + 1] AS median FROM p GROUP BY label",
    "calibrate_verdict": f"""WITH {PROBES}, e AS (SELECT max(score) FILTER (label = 'out') AS max_out, min(score) FILTER (label = 'in') AS min_in FROM p)
SELECT max_out, min_in, count(*) FILTER (label = 'out' AND score >= min_in) AS overlapping, CASE WHEN count(*) FILTER (label = 'out' AND score >= min_in) = 0 THEN (max_out + min_in) / 2 END AS suggestion FROM p, e GROUP BY 1, 2""",
    "calibrate_gap": f"""WITH {PROBES}, q AS (SELECT label, CASE WHEN label = 'in' THEN 1 + score ELSE 1 / (1 + score) END AS score FROM p), e AS (SELECT max(score) FILTER (label = 'out') AS max_out, min(score) FILTER (label = 'in') AS min_in FROM q)
SELECT round(max_out, 9) AS max_out, round(min_in, 9) AS min_in, count(*) FILTER (label = 'out' AND score >= min_in) AS overlapping, CASE WHEN count(*) FILTER (label = 'out' AND score >= min_in) = 0 THEN round((max_out + min_in) / 2, 9) END AS suggestion FROM q, e GROUP BY e.max_out, e.min_in""",
    "probe_scores": """SELECT user_id AS query_id, """ + ", ".join(f"round({f}(value) FILTER ({c}), 6) AS {n}_{f}" for n, c in (("relevant", "event_type = 'purchase'"), ("irrelevant", "event_type <> 'purchase'")) for f in ("avg", "min", "max")) + " FROM events GROUP BY 1",
    "manifest_counts": f"WITH {DOCS} SELECT count(*) AS doc_count, CAST(sum(page_count) AS BIGINT) AS page_count, (SELECT count(*) FROM embeddings) AS chunk_count FROM docs",
    "content_digest": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "pdf_report": f"""WITH {DOCS}, x AS (SELECT doc_id, CASE WHEN page_count > 1 THEN doc_id || '.pdf' END AS source_file, CASE WHEN NOT is_scanned THEN md5(doc_id) END AS recorded FROM docs),
f AS (SELECT CAST(doc_id AS VARCHAR) || '.pdf' AS source_file, md5(CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) ELSE 'x' END) AS actual FROM labels)
SELECT doc_id, x.source_file, CASE WHEN x.source_file IS NULL OR actual IS NULL THEN 'missing' WHEN recorded IS NULL THEN 'unverified' WHEN recorded <> actual THEN 'modified' ELSE 'present' END AS state FROM x LEFT JOIN f ON x.source_file = f.source_file""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "snapshot_roundtrip": CHUNKS_SQL.format(more=", CAST(len(embedding) AS INTEGER) AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total"),
    "store_resume": "SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS chunk_index, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "stream_progress": """SELECT source AS doc_id, CAST(count(*) + CASE WHEN max(doc_id) % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS chunk_count, count(*) AS embedded_count,
 CASE WHEN max(doc_id) % 2 = 0 THEN 'ready' ELSE 'pending' END AS status FROM documents GROUP BY source""",
    "stream_ingest": CHUNKS_SQL.format(more=""),
}
QUERIES = {
    f.__name__: f
    for f in (
        dedupe_keep_lowest, upsert_merge, replace_documents, resume_antijoin, begin_documents, finalize_guard, orphans, corpus_stats, health, load_verify,
        citable, document_titles_ready, backfill_embedded, delete_documents, topics_round_robin, clause_sort, topic_rotate, labels_and_sizes,
        calibrate_distributions, calibrate_verdict, calibrate_gap, probe_scores, manifest_counts, content_digest, pdf_report, event_windows,
        snapshot_roundtrip, stream_ingest, stream_progress, store_resume,
    )
}

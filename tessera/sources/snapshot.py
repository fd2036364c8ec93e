"""Index snapshots: gzip JSON lines, a manifest with checksums, and a pointer to the latest.

Two layouts are read and written. ``one_file``: each table is one file, whose length and digest
the manifest names, and the manifest lists the documents; for stores of common size and for
exchange with other programs. Otherwise a table is a folder of parts of bounded size, each with
its digest, which tasks write, check and read side by side.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.vectors import parse_vector_literal, vector_literal

#: What a manifest calls its format; a bundle of another program is read by naming its format.
FORMAT = "tessera-index-snapshot"
PART_ROWS = 20_000
# Names and version of the format
FORMAT_VERSION = 1
DOCUMENTS_FILE, CHUNKS_FILE, MANIFEST_FILE, LATEST_FILE = "documents.jsonl.gz", "chunks.jsonl.gz", "manifest.json", "LATEST"
CHUNK_ROW = "doc_id string, doc_title string, page_from int, page_to int, clause string, chunk_index int, content string, embedding string"
DOCUMENT_ROW = "doc_id string, doc_title string, source_file string, page_count int, chunk_count int, is_scanned boolean, status string, embedded_count int, pdf struct<bytes:bigint,sha256:string>"


class SnapshotError(ValueError):
    pass


def bundle_name(embed: dict, created_at: dt.datetime) -> str:
    model = re.sub(r"[^A-Za-z0-9._-]+", "-", embed["model"])
    return f"{created_at:%Y%m%dT%H%M%SZ}-{embed['provider']}-{model}-{embed['dims']}d"


class Files:
    """Small files and folders of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(self.at(name)))

    def read(self, name: str) -> str:
        return self.spark.read.text(self.at(name), wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(self.at(name)), True)
        out.write(bytearray(text.encode()))
        out.close()

    def digests(self, name: str) -> dict:
        """bytes and sha256 of a file, or part name -> those of a folder's parts. A single file
        is read as a stream; parts are bounded, and tasks read them."""
        path = self.path(self.at(name))
        status = self.fs.getFileStatus(path)
        if not status.isDirectory():
            stream = self.fs.open(path)
            try:
                return {"bytes": status.getLen(), "sha256": self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)}
            finally:
                stream.close()
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(self.at(name))
        got = rows.select(F.element_at(F.split("path", "/"), -1).alias("f"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        return {r["f"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in got.collect()}

    def write_lines(self, name: str, rows: DataFrame, one_file: bool) -> None:
        """Gzip JSON lines, in a folder of bounded parts or, joined, in one file. Tasks compress
        their parts side by side either way."""
        if not one_file:
            rows.write.option("compression", "gzip").option("maxRecordsPerFile", PART_ROWS).json(self.at(name))
            return
        rows.write.option("compression", "gzip").json(self.at(f"{name}.parts"))
        self.join(f"{name}.parts", name)

    def join(self, folder: str, name: str) -> None:
        """The parts of a folder as one file, in the order of their names: gzip files one after
        another are a gzip file. The file system joins them where it can; else their bytes pass
        through here as a stream."""
        jvm, folder = self.spark._jvm, self.path(self.at(folder))
        parts = sorted((s.getPath() for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".gz") and s.getLen()), key=lambda p: p.getName())
        final = self.path(self.at(name))
        if len(parts) > 1:
            try:
                others = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
                for i, p in enumerate(parts[1:]):
                    others[i] = p
                self.fs.concat(parts[0], others)
                parts = parts[:1]
            except UnsupportedOperationException:
                pass  # their bytes are copied below
        if len(parts) == 1:
            self.fs.rename(parts[0], final)
        else:
            out = self.fs.create(final)
            try:
                for p in parts:
                    one = self.fs.open(p)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(one, out, 1 << 20, False)
                    finally:
                        one.close()
            finally:
                out.close()
        self.fs.delete(folder, True)

    def read_lines(self, name: str, ddl: str) -> DataFrame:
        """Rows of gzip JSON lines. Blank lines are skipped; a line that is no such row raises an
        error that names its file and number."""
        lines = self.spark.read.text(self.at(name)).select("value", F.col("_metadata.file_name").alias("file"), (F.monotonically_increasing_id().bitwiseAND(2**33 - 1) + 1).alias("line"))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        rows = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", f"{ddl}, _bad string", options))
        bad = rows.where(F.col("row").isNull() | F.col("row._bad").isNotNull()).orderBy("file", "line").select("file", "line").first()
        if bad is not None:
            raise SnapshotError(f"{bad['file']} line {bad['line']} is not a valid row")
        return rows.select("row.*").drop("_bad")


def resolve_bundle(spark: SparkSession, root: str, explicit: str | None = None) -> str | None:
    """An explicit folder, else the one that LATEST names; a pointer that leads elsewhere is
    refused."""
    if explicit:
        return explicit
    files = Files(spark, root)
    if not files.exists(LATEST_FILE):
        return None
    name = files.read(LATEST_FILE).strip()
    return None if not name or name == ".." or "/" in name or "\\" in name else f"{root}/{name}"


def manifest_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: doc_count, page_count, chunk_count."""
    d = documents.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("page_count"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunk_count")))  # one row each


def build_manifest(documents: DataFrame, chunks: DataFrame, embed: dict, settings: Settings, files: dict, created_at: dt.datetime, format_name: str = FORMAT, listed: bool = False) -> dict:
    """``listed``: with the list of documents, which the driver gathers for it."""
    counts = manifest_counts(documents, chunks).first()
    names = {"docId": "doc_id", "docTitle": "doc_title", "sourceFile": "source_file", "pageCount": "page_count", "chunkCount": "chunk_count"}
    pdf = [F.col(f"pdf.{f}") if "pdf" in documents.columns else F.lit(None) for f in ("bytes", "sha256")]
    rows = documents.orderBy("doc_id").select(*[F.col(c).alias(n) for n, c in names.items()], pdf[0].alias("pdfBytes"), pdf[1].alias("pdfSha256")).collect() if listed else []
    return {
        "format": format_name,
        "formatVersion": FORMAT_VERSION,
        "createdAt": created_at.strftime("%Y-%m-%dT%H:%M:%S.000Z"),
        "embed": {"provider": embed["provider"], "model": embed["model"], "dims": int(embed["dims"]), "prefixTitle": bool(embed.get("prefixTitle"))},
        "chunking": {"chars": settings.chunk_chars, "overlap": settings.chunk_overlap, "minSealChars": settings.chunk_min_seal_chars},
        "corpus": {"docCount": counts["doc_count"], "chunkCount": counts["chunk_count"], "pageCount": counts["page_count"]},
        **({"documents": [r.asDict() for r in rows]} if listed else {}),
        "files": files,
    }


def validate(manifest: object, embed: dict, settings: Settings, format_name: str = FORMAT) -> tuple[list[str], list[str]]:
    """(errors, warnings), all at once. What changes vectors is an error, what only would change
    a new ingest is a warning."""
    if not isinstance(manifest, dict):
        return ["the manifest is not an object"], []
    errors, warnings = [], []
    if manifest.get("format") != format_name:
        errors.append(f"format is {manifest.get('format')!r}, not {format_name!r}")
    version = manifest.get("formatVersion")
    if not isinstance(version, int) or version < 1:
        errors.append(f"formatVersion is {version!r}")
    elif version > FORMAT_VERSION:
        errors.append(f"formatVersion {version} is newer than {FORMAT_VERSION}")
    own = manifest.get("embed") or {}
    errors += [f"embedding {k} differs: {own.get(k)!r} and {embed.get(k)!r}" for k in ("provider", "model", "dims") if own.get(k) != embed.get(k)]
    if "prefixTitle" in own and bool(own["prefixTitle"]) != bool(embed.get("prefixTitle")):
        warnings.append("prefixTitle differs")
    here = {"chars": settings.chunk_chars, "overlap": settings.chunk_overlap, "minSealChars": settings.chunk_min_seal_chars}
    cut = manifest.get("chunking") or {}
    warnings += [f"chunking {k} differs: {cut[k]} and {v}" for k, v in here.items() if k in cut and cut[k] != v]
    return errors, warnings


def export_bundle(
    documents: DataFrame, chunks: DataFrame, root: str, embed: dict, settings: Settings = Settings(), created_at: dt.datetime | None = None, one_file: bool = False, pdfs: DataFrame | None = None, format_name: str = FORMAT
) -> str:
    """Write documents and chunks in key order as gzip JSON lines, the manifest last as the mark
    of completeness, then LATEST. An empty store is refused and a failed export is removed.
    Surrogate ids and times are left out. ``pdfs`` (source_file, bytes, sha256) adds digests."""
    spark = chunks.sparkSession
    if chunks.isEmpty() or documents.isEmpty():
        raise SnapshotError("the store is empty")
    created_at = created_at or dt.datetime.now(dt.timezone.utc)
    name = bundle_name(embed, created_at)
    files = Files(spark, f"{root}/{name}")
    if pdfs is not None:
        found = pdfs.select("source_file", F.struct(F.col("bytes").cast("bigint").alias("bytes"), "sha256").alias("pdf"))
        documents = documents.drop("pdf").join(found, "source_file", "left")
    try:
        docs = documents.withColumn("embedded_count", F.col("chunk_count")).orderBy("doc_id")
        keep = [x.split()[0] for x in re.sub(r"struct<[^>]*>", "struct", DOCUMENT_ROW).split(", ")]
        files.write_lines(DOCUMENTS_FILE, docs.select(*[c for c in keep if c in docs.columns]), one_file)
        rows = chunks.withColumn("embedding", vector_literal(F.col("embedding"))).orderBy("doc_id", "chunk_index")
        files.write_lines(CHUNKS_FILE, rows.select(*[x.split()[0] for x in CHUNK_ROW.split(", ")]), one_file)
        sums = {n: files.digests(n) for n in (DOCUMENTS_FILE, CHUNKS_FILE)}
        files.write(MANIFEST_FILE, json.dumps(build_manifest(documents, chunks, embed, settings, sums, created_at, format_name, one_file), indent=1))
    except Exception:
        files.fs.delete(files.path(files.root), True)
        raise
    Files(spark, root).write(LATEST_FILE, name)
    return files.root


def export_store(store, root: str, embed: dict, settings: Settings = Settings(), **options) -> str:
    """Export what a store holds, under its own fingerprint. A store without one, or with
    another than the configuration's ``embed``, is refused: its vectors would be misnamed."""
    held = store.fingerprint()
    if held is None:
        raise SnapshotError("the store does not say which model made its vectors")
    own = {k: held.get(k) for k in ("provider", "model", "dims")}
    wanted = {k: embed.get(k) for k in own}
    if own != wanted:
        raise SnapshotError(f"the store holds vectors of {own}, the configuration says {wanted}")
    documents = store.read("documents").where("status = 'ready'")
    chunks = store.read("chunks").join(documents.select("doc_id"), "doc_id", "left_semi")
    return export_bundle(documents, chunks, root, {**held, **embed}, settings, **options)


def read_bundle(spark: SparkSession, folder: str, embed: dict, settings: Settings = Settings(), format_name: str = FORMAT) -> tuple[DataFrame, DataFrame, dict]:
    """(documents, chunks, manifest) after all checks: configuration first, then checksums."""
    files = Files(spark, folder)
    if not files.exists(MANIFEST_FILE):
        raise SnapshotError("no manifest: the bundle is not complete")
    manifest = json.loads(files.read(MANIFEST_FILE))
    errors, _ = validate(manifest, embed, settings, format_name)
    named = manifest.get("files") or {} if isinstance(manifest, dict) else {}
    for name in (DOCUMENTS_FILE, CHUNKS_FILE) if not errors else ():
        if not files.exists(name):
            errors.append(f"{name} is missing")
        elif name in named and files.digests(name) != named[name]:
            errors.append(f"{name}: checksum or length differs from the manifest")
    if errors:
        raise SnapshotError("; ".join(errors))
    chunks = files.read_lines(CHUNKS_FILE, CHUNK_ROW).withColumn("embedding", parse_vector_literal(F.col("embedding")))
    return files.read_lines(DOCUMENTS_FILE, DOCUMENT_ROW), chunks, manifest


def pdf_report(documents: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, source_file, state of recorded digests against files (source_file, sha256)."""
    there = files.select("source_file", F.col("sha256").alias("_actual"))
    joined = documents.select("doc_id", "source_file", F.col("sha256").alias("_recorded")).join(there, "source_file", "left")
    state = F.when(F.col("source_file").isNull() | F.col("_actual").isNull(), "missing").when(F.col("_recorded").isNull(), "unverified").when(F.col("_recorded") != F.col("_actual"), "modified").otherwise("present")
    return joined.select("doc_id", "source_file", state.alias("state"))


def summarise_pdfs(report: DataFrame) -> str:
    counts = {r["state"]: r["n"] for r in report.groupBy("state").agg(F.count("*").alias("n")).collect()}
    return ", ".join(f"{counts.get(s, 0)} {s}" for s in ("present", "unverified", "modified", "missing"))

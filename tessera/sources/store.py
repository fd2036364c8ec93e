"""A chunk store of ordinary Parquet folders, partitioned by a hash of the document.

A change writes the partitions that it touches as a new version, then the manifest of all
partitions under the next number. That file appears whole, by one rename to a name that was
free, and readers take the highest number; so they see the store before the change or after it,
never between, and a writer that stops half way leaves the old state. There is one writer, and
the file system's rename must be whole (HDFS, a local disk); object stores do not promise that.
Only the last manifest counts for new readers, but those that began before go on reading older
versions: files are removed when no manifest of the last ``keep_hours`` names them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as ops
from ..session import materialise
from . import key_filter
from .keyword_index import KeywordIndex

CHUNKS = "id long, doc_id string, doc_title string, page_from int, page_to int, clause string, chunk_index int, content string, embedding array<float>, created_at timestamp"
DOCUMENTS = "doc_id string, doc_title string, source_file string, page_count int, chunk_count int, is_scanned boolean, ingested_at timestamp, status string, embedded_count int, content_hash string"
BUCKETS = 64
PREFIX = "manifest-"
KEEP_HOURS = 24.0


class Store:
    """chunks and documents under ``root`` (any folder that Spark reads and writes)."""

    SCHEMAS = {"chunks": CHUNKS, "documents": DOCUMENTS}

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, keep_hours: float = KEEP_HOURS, keywords: bool = False):
        """``keywords``: changes keep an inverted index of titles and contents too (a store that
        has one keeps it)."""
        self.spark, self.root, self.keep_hours = spark, root, keep_hours
        self._pending: dict | None = None
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._manifest().get("buckets", buckets)
        self._keywords = keywords or "keywords" in self._manifest()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names(self.root) if n.startswith(PREFIX)]

    def _load(self, name: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect()))

    def _manifest(self) -> dict:
        """The last one; within a change, with what the change has written so far."""
        if self._pending is not None:
            return self._pending
        names = self._manifests()
        return self._load(names[-1]) if names else {}

    def _commit(self, manifest: dict) -> None:
        names = self._manifests()
        number = int(names[-1].removeprefix(PREFIX)) + 1 if names else 1
        new, final = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/{PREFIX}{number:012d}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps({**manifest, "buckets": self.buckets}).encode()))
        out.close()
        if not self._fs.rename(new, final):
            raise RuntimeError(f"{final} is there already: a second writer?")
        self._tidy()

    def _tidy(self) -> None:
        """Remove manifests that were replaced over ``keep_hours`` ago, and files of that age
        which no manifest names."""
        before = (time.time() - 3600 * self.keep_hours) * 1000
        names = self._manifests()
        ages = {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._path(self.root))}
        # a manifest was in force until the next one came
        old = [n for n, following in zip(names, names[1:]) if ages[following] < before]
        kept = [self._load(n) for n in names if n not in old]
        live = {(t, v) for m in kept for t in self.SCHEMAS for v in m.get(t, {}).values()}
        live |= {("filters", f["path"].rsplit("/", 1)[1]) for m in kept for f in m.get("filters", [])}
        live |= {("keywords", x["path"].rsplit("/", 1)[1]) for m in kept for part in m.get("keywords", {}).values() for x in part}
        for table in (*self.SCHEMAS, "keywords", "filters"):
            folder = self._path(f"{self.root}/{table}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (table, status.getPath().getName()) not in live and status.getModificationTime() < before:
                    self._fs.delete(status.getPath(), True)
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{n}"), False)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or those of its partitions."""
        return self._table(self._manifest(), name, buckets)

    def _table(self, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        versions = manifest.get(name, {})
        paths = [f"{self.root}/{name}/{v}/bucket={b}" for b, v in versions.items() if buckets is None or int(b) in buckets]
        schema = self.SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def change(self, touched: DataFrame | None = None, fingerprint: dict | None = None, **made: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the named tables by what the functions make of them, all at once, in the order
        given: what a later function reads from the store has the earlier ones' results.

        With ``touched`` (a doc_id column) only the partitions of these documents are read and
        written, and the functions must change no other document. ``fingerprint`` is recorded by
        the same commit."""
        some = None if touched is None else {r[0] for r in touched.select(self.bucket()).distinct().collect()}  # at most ``buckets``
        if some == set():
            return
        manifest = {**self._manifest(), **({"fingerprint": fingerprint} if fingerprint is not None else {})}
        before = dict(manifest)
        self._pending = manifest
        try:
            for name, change in made.items():
                version = uuid.uuid4().hex
                old = self.read(name, some)
                new = change(old).select(old.columns).withColumn("bucket", self.bucket())
                if some is not None:
                    new = new.where(F.col("bucket").isin(*some))
                # rows of one partition to one task, so that a change makes few files
                new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
                kept = {} if some is None else {b: v for b, v in manifest.get(name, {}).items() if int(b) not in some}
                written = [n.removeprefix("bucket=") for n in self._names(f"{self.root}/{name}/{version}") if n.startswith("bucket=")]
                manifest[name] = {**kept, **{b: version for b in written}}
            if "chunks" in made:
                manifest["filters"] = self._filters(before, some)
            if self._keywords and "chunks" in made:
                manifest["keywords"] = self._index_change(before, touched, some)
        finally:
            self._pending = None
        self._commit(manifest)

    def _filters(self, before: dict, some: set[int] | None) -> list[dict]:
        """Filters of the chunk keys of the touched partitions, beside those of the others."""
        rows, path = self.read("chunks", some), f"{self.root}/filters/{uuid.uuid4().hex}"
        n = rows.groupBy(self.bucket()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        key_filter.build_filters(rows, self.bucket(), ops.KEY, key_filter.bits_for(n)).write.parquet(path)
        kept = [] if some is None else [{**f, "buckets": left} for f in before.get("filters", []) if (left := [b for b in f["buckets"] if b not in some])]
        return [*kept, {"path": path, "buckets": sorted(some) if some is not None else list(range(self.buckets))}]

    def to_do(self, wanted: DataFrame) -> tuple[DataFrame, dict]:
        """The rows of ``wanted`` whose chunk is not stored yet, and how many partitions had to be
        read for it. Keys that the filters do not know are new without a read; the partitions
        of the others are read and joined exactly."""
        parts = self._manifest().get("filters")
        if parts is None:
            return ops.to_do(wanted, self.read("chunks")), {"partitions": self.buckets, "read": self.buckets}
        filters = None
        for f in parts:
            own = self.spark.read.schema(key_filter.FILTERS).parquet(f["path"]).where(F.col("bucket").isin(f["buckets"]))
            filters = own if filters is None else filters.unionAll(own)
        tested = materialise(key_filter.may_hold(wanted, filters, self.bucket(), ops.KEY), "tested-keys")
        new = tested.where("not _maybe").drop("_bucket", "_maybe")
        hit = {r[0] for r in tested.where("_maybe").select("_bucket").distinct().collect()}  # at most ``buckets``
        if not hit:
            return new, {"partitions": self.buckets, "read": 0}
        maybe = tested.where("_maybe").drop("_bucket", "_maybe")
        return new.unionByName(ops.to_do(maybe, self.read("chunks", hit))), {"partitions": self.buckets, "read": len(hit)}

    def _index_change(self, before: dict, touched: DataFrame | None, some: set[int] | None) -> dict:
        """The index after a change: a segment of the touched documents, whose older postings die."""
        index = KeywordIndex(self.spark, f"{self.root}/keywords", before.get("keywords") if some is not None else None)
        new, gone = self.read("chunks", some), None
        if touched is not None:
            names = touched.select("doc_id").distinct()
            new = new.join(names, "doc_id", "left_semi")
            gone = self._table(before, "chunks", some).join(names, "doc_id", "left_semi").select("id")
        return index.change(new, gone, text=F.concat_ws(" ", "doc_title", "content"))

    def keyword_index(self) -> KeywordIndex:
        """The index of titles and contents, as the last change left it."""
        return KeywordIndex(self.spark, f"{self.root}/keywords", self._manifest().get("keywords"))

    def fingerprint(self) -> dict | None:
        return self._manifest().get("fingerprint")

    def record_fingerprint(self, wanted: dict) -> None:
        self._commit({**self._manifest(), "fingerprint": wanted})

    def sync_fingerprint(self, wanted: dict) -> str:
        """Wipe the store if the embedding changed; always record the new fingerprint."""
        done = ops.index_change(self.fingerprint(), wanted)
        manifest = self._manifest()
        if done in ("wipe", "recreate"):
            manifest = {k: v for k, v in manifest.items() if k not in (*self.SCHEMAS, "keywords", "filters")}
        self._commit({**manifest, "fingerprint": wanted})
        return done

    def upsert_chunks(self, new: DataFrame, finalise: bool = False) -> None:
        """Of new rows of one key the one of the latest ``created_at`` stays. With ``finalise``
        documents whose chunks are then all stored turn ready by the same commit."""
        made = {"chunks": lambda old: ops.upsert(old, new, order=[F.desc_nulls_last("created_at"), F.desc("id")])}
        self.change(touched=new, **made, **({"documents": self.promoted(new)} if finalise else {}))

    def finalise(self, touched: DataFrame | None = None) -> None:
        """Promote documents (of ``touched``, or any) whose chunks are all stored."""
        self.change(touched=touched, documents=self.promoted(touched))

    def promoted(self, touched: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
        """What makes documents of whom all chunks are stored (seen within a change) ready."""

        def promote(old: DataFrame) -> DataFrame:
            some = None if touched is None else {r[0] for r in touched.select(self.bucket()).distinct().collect()}
            now = ops.finalise(old, self.read("chunks", some)).select("doc_id", "embedded_count", "status")
            return old.drop("embedded_count", "status").join(now.withColumn("embedded_count", now["embedded_count"].cast("int")), "doc_id", "left")

        return promote

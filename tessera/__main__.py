"""Command line: python -m tessera export|import|stats|ask|calibrate STORE ...

``ask`` and ``calibrate`` need models: ``--models`` names a Python module with ``embed(texts)``, which
gives a vector for each text, and for ``ask`` with ``translate(prompts)`` and ``generate(prompts)``.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.models import embed
from .functions.text import query_input
from .operators import calibrate as calibration
from .operators.keywords import postings
from .operators.store import corpus_stats, ready_only
from .operators.vectors import vector_top_k
from .plans.answer import answer_batch
from .plans.ingest import import_and_report, import_bundle
from .sources.files import list_pdfs
from .sources.snapshot import export_store, resolve_bundle
from .sources.store import Store


def ask(store: Store, questions: list[str], models, settings: Settings) -> DataFrame:
    """The answers to questions, by ready documents and the injected models."""
    spark = store.spark
    rows = spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
    chunks = ready_only(store.read("chunks"), store.read("documents"))
    index = store.keyword_index()
    if not index.state["segments"]:
        index = postings(chunks, "id", F.concat_ws(" ", "doc_title", "content"))
    embedded = lambda df: embed(df.withColumn("_asked", query_input("english")), "_asked", models.embed, settings.embed_dims).drop("_asked")
    found = answer_batch(rows, chunks, index, embedded, models.translate, models.generate, settings)
    return rows.join(found, "query_id").orderBy("query_id")


def calibrate(store: Store, probes: DataFrame, models, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(distributions, verdict) of the best similarity of probes (query, label: in or out)."""
    rows = probes.withColumn("query_id", F.xxhash64("query", "label"))
    asked = embed(rows.withColumn("_asked", query_input("query")), "_asked", models.embed, settings.embed_dims)
    chunks = ready_only(store.read("chunks"), store.read("documents"))
    best = vector_top_k(chunks, asked, 1).select("query_id", F.col("similarity").alias("score"))
    scored = rows.join(best, "query_id").select("label", "score")
    return calibration.distributions(scored), calibration.verdict(scored)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["export", "import", "stats", "ask", "calibrate"])
    p.add_argument("store")
    p.add_argument("question", nargs="*", help="what to ask")
    p.add_argument("--snapshots", default="index-snapshots")
    p.add_argument("--bundle")
    p.add_argument("--embed", type=json.loads, help="JSON: provider, model, dims; an export takes the store's own")
    p.add_argument("--one-file", action="store_true", help="each table of an export in one file")
    p.add_argument("--replace", action="store_true")
    p.add_argument("--pdfs", help="folder of the documents' files, for a report after an import")
    p.add_argument("--models", help="module with embed, translate and generate")
    p.add_argument("--probes", help="JSON lines for calibrate: query, label (in or out)")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    store, settings = Store(spark, a.store), Settings.from_env().validate()
    if a.command in ("ask", "calibrate"):
        if a.models is None:
            raise SystemExit(f"{a.command} needs --models")
        models = importlib.import_module(a.models)
    if a.command == "stats":
        corpus_stats(store.read("documents")).show()
    elif a.command == "export":
        print(export_store(store, a.snapshots, a.embed or store.fingerprint() or {}, one_file=a.one_file))
    elif a.command == "ask":
        for r in ask(store, a.question, models, settings).collect():
            print(f"{r['query']}\n  {r['outcome']}{' (' + r['band'] + ')' if r['band'] else ''}: {r['answer'] or r['reason'] or ''}  {r['sources'] or ''}")
    elif a.command == "calibrate":
        if a.probes is None:
            raise SystemExit("calibrate needs --probes")
        for part in calibrate(store, spark.read.schema("query string, label string").json(a.probes), models, settings):
            part.show()
    else:
        if a.embed is None:
            raise SystemExit("import needs --embed")
        folder = resolve_bundle(spark, a.snapshots, a.bundle)
        if folder is None:
            raise SystemExit("no bundle")
        if a.pdfs is None:
            import_bundle(spark, folder, store, a.embed, replace=a.replace).show()
        else:
            files = list_pdfs(spark, a.pdfs, content=True).select("source_file", F.sha2("content", 256).alias("sha256"))
            orphans, report, said = import_and_report(spark, folder, store, a.embed, files, replace=a.replace)
            orphans.show()
            report.show()
            print(said)


if __name__ == "__main__":
    main()

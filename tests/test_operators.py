"""Chunking, retrieval, store, snapshot, stream and plan operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import models
from tessera.operators import chunking, fusion, keywords, pages, store, topics, vectors
from tessera.plans import answer, ingest, retrieval
from tessera.sources import files, snapshot
from tessera.sources.store import CHUNKS, Store
from tessera.streaming.ingest import arrivals, ingest_stream

S = "The value shall be recorded after drying for one hour at the stated temperature in a clean oven."


def shape(rows):
    return [(r["page_from"], r["page_to"], len(r["content"])) for r in rows]


def test_chunker_golden_values():
    assert shape(chunking.chunk_pages([(i, "\n".join([S] * 6)) for i in (1, 2, 3)])) == [(1, 1, 586), (1, 2, 880), (2, 3, 880)]
    two = chunking.chunk_pages([(1, "4 MARKING\n" + "\n".join([S] * 5) + "\n5 PACKING AND STORAGE OF THE GOODS IN BAGS\n" + "\n".join([S] * 5))])
    assert [r["clause"] for r in two] == ["4", "5"] and all(r["heading"].startswith("PACKING") for r in two)
    line = " ".join(f"Word{i} value." for i in range(300)).replace(". ", ", ")
    assert [n for *_, n in shape(chunking.chunk_pages([(1, line)]))] == [1200, 1193, 1199, 794]
    assert [n for *_, n in shape(chunking.chunk_pages([(1, "\n".join([S] * 6) + "\n\n" + line)]))] == [586, 1494, 2395, 2394, 1995, 794]
    pages_ = [(1, "1 SCOPE\nThis covers biscuits.\n\n5 REQUIREMENTS\n5.1 Moisture\nMoisture shall not exceed 6.0 percent by mass.\n\n5.2 Ash\nAsh shall not exceed 0.05 percent."), (2, "6 SAMPLING\nSampling per Annex A.\n\nThe acidity shall not exceed 0.1 percent.")]
    assert [r["clause"] for r in chunking.chunk_pages(pages_)] == ["5.1", "5.2", "6"]
    assert chunking.chunk_pages([]) == [] and chunking.chunk_pages([(1, "")]) == []


def test_chunks_are_dense_per_document(spark):
    rows = [(d, f"T {d}", p, "\n".join([S] * 6)) for d in ("a", "b") for p in (2, 1)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, doc_title string, page_number int, text string"))
    by = {d: [r["chunk_index"] for r in sorted(got.where(F.col("doc_id") == d).collect(), key=lambda r: r["chunk_index"])] for d in ("a", "b")}
    assert by == {"a": [0, 1], "b": [0, 1]}


def test_running_heads(spark):
    rows = [("d", i, f"IS 10 : 2000\nHEAD\nbody {i}\nmore\nPage {i} of 9") for i in range(1, 7)] + [("e", 1, "HEAD\nx")]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {(r["doc_id"], r["page_number"]): r["text"] for r in pages.strip_running_heads(df).collect()}
    # on a page of two lines each is first and last, so both count twice
    assert got["d", 3] == "body 3" and got["e", 1] == ""
    assert pages.scan_report(df).where("is_scanned").count() == 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5), v.astype(np.float32).astype(np.float64)


def test_top_k_is_exact(spark, corpus, monkeypatch):
    df, v = corpus
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for tile, cells in ((32 << 20, 4 << 20), (4 * 16 * 1024, 50)):  # the second: queries one by one
        monkeypatch.setattr(vectors, "TILE_BYTES", tile)
        monkeypatch.setattr(vectors, "CELLS", cells)
        q = df.where("id < 20").withColumnRenamed("id", "query_id")
        got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.vector_top_k(df, q, 3, exclude_self=True).collect()}
        sim = u[:20] @ u.T
        sim[np.arange(20), np.arange(20)] = -9
        assert got == {(i, k + 1): int(j) for i in range(20) for k, j in enumerate(np.argsort(-sim[i], kind="stable")[:3])}
    assert vectors.vector_top_k(df, q.limit(0), 3).count() == 0 == vectors.vector_top_k(df.limit(0), q, 3).count()


def test_top_k_of_many_groups_and_equal_vectors(spark, monkeypatch):
    """3,000 chunks in groups and 1,500 queries in blocks; a third of the vectors are the same."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 4)).astype(np.float32)
    v[::3] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(3000)] + [(5000, None)], "id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(vectors, "TILE_BYTES", 4 * 4 * 1024)
    q = df.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.vector_top_k(df, q, 3).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = np.round(u[::2] @ u.T, 12)
    assert got == {(2 * i, k + 1): int(j) for i in range(1500) for k, j in enumerate(np.argsort(-sim[i], kind="stable")[:3])}
    assert got[0, 1] == 0 and got[0, 3] == 6


def test_pruned_top_k_recall(spark, corpus):
    df, v = corpus
    q = df.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in vectors.vector_top_k(df, q, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vectors.pruned_top_k(df, q, v[:8].tolist(), 10, cells=7).collect()}
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_pruned_query_recall(spark, sf):
    import os

    from tessera.catalogue.retrieval import ann_pruned_topk, vector_topk

    if not os.path.isdir(data := f"/root/testdata/{sf}"):
        pytest.skip("no test data")
    exact, found = ({(r["query_id"], r["id"]) for r in q(spark, data).collect()} for q in (vector_topk, ann_pruned_topk))
    other = {(q, i) for q, i in exact if q != i}  # the query itself is a free hit
    print(sf, len(exact & found) / len(exact), len(other & found) / len(other))
    assert len(exact & found) / len(exact) >= 0.9 and len(other & found) / len(other) >= 0.9


def test_width_is_checked(spark, corpus):
    df, _ = corpus
    assert vectors.with_width(df, "embedding", 16).count() == 300
    with pytest.raises(Exception, match="vector width"):
        vectors.with_width(df, "embedding", 8).select("embedding").collect()


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "Fly ash in cement. Ash!"), (2, "cement and fly-ash"), (3, "ash fly"), (4, None)], "id long, text string")
    index = keywords.postings(docs)
    q = lambda *terms: spark.createDataFrame([(9, list(terms))], "query_id long, terms array<string>")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(keywords.match_all(index, q("fly", "ash", "ash"))) == [1, 2, 3]
    assert ids(keywords.match_phrase(index, q("fly", "ash"))) == [1, 2]
    assert ids(keywords.match_any(index, q("cement", "none"))) == [1, 2]
    assert ids(keywords.without(keywords.match_all(index, q("ash")).select("query_id", "id"), keywords.match_any(index, q("cement")))) == [3]
    assert ids(keywords.match_all(index, q())) == []
    top = keywords.keyword_top_k(index, q("ash"), 2).orderBy("rank").collect()
    assert [(r["id"], round(r["text_rank"], 6)) for r in top] == [(1, 0.2), (2, 0.1)]


def covers(groups):
    """Minimal covers by their definition: spans with all terms and none of them within another."""
    events = sorted((p, g) for g, positions in enumerate(groups) for p in positions)
    spans = []
    for i in range(len(events)):
        for j in range(i, len(events)):
            if {g for _, g in events[i : j + 1]} == set(range(len(groups))):
                spans.append((i, j))
                break
    least = [s for s in spans if not any(t != s and t[0] >= s[0] and t[1] <= s[1] for t in spans)]
    return sum(0.1 / (1 + events[j][0] - events[i][0] + 1 - (j - i + 1)) for i, j in least)


def test_cover_density_by_definition(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(150):
        places = rng.permutation(np.arange(1, 40))[: rng.integers(4, 25)].tolist()
        terms = 1 + n % 4
        own = [sorted(places[k::terms]) for k in range(terms)]
        rows.append((n, 0, [(f"t{k}", len(p), p) for k, p in enumerate(own)]))
    df = spark.createDataFrame(rows, "query_id long, id long, matched array<struct<term:string,tf:long,positions:array<int>>>")
    got = {r["query_id"]: r["text_rank"] for r in keywords.cover_density(df).collect()}
    for n, _, matched in rows:
        assert got[n] == pytest.approx(covers([p for *_, p in matched])), matched


def test_postings_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (1, "a"), (None, "Z z")], "id long, text string")
    index = keywords.postings(docs)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r["id"], r["term"], r["tf"], list(r["positions"])) for r in index.collect()), key=repr)
    assert got == sorted([(1, "a", 1, [1]), (1, "a", 1, [2]), (1, "b", 2, [1, 3]), (None, "z", 2, [1, 2])], key=repr)


def test_web_style_queries(spark):
    docs = {1: "Fly ash in cement. Ash!", 2: "cement and fly-ash", 3: "ash fly", 4: None, 5: "sand or stone", 6: "fly sand ash"}
    index = keywords.postings(spark.createDataFrame(list(docs.items()), "id long, text string"))
    asked = {
        "fly ash": [1, 2, 3, 6], '"fly ash"': [1, 2], "fly-ash": [2], '"fly ash" -and': [1], "sand or cement": [1, 2, 5, 6], "sand OR fly cement": [1, 2, 5, 6],
        'ash -"fly ash"': [3, 6], "-ash": [5], "-ash or -cement": [3, 5, 6], "": [], None: [], "...": [], '"fly ash': [1, 2], "nowhere or stone": [5], "nowhere sand": [], '-"sand or" stone': [], '"a-b" or "ash fly"': [3],
    }
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in keywords.match_websearch(index, q).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert {t: sorted(got.get(i, [])) for i, t in enumerate(asked)} == asked


def test_fusion(spark):
    arm = lambda rows: spark.createDataFrame(rows, "query_id long, id long, similarity double, rank int")
    v, k = arm([(1, 10, 0.7, 1), (1, 11, 0.6, 2)]), arm([(1, 11, 0.6, 1), (1, 12, 0.1, 2)])
    got = fusion.fuse(v, k, limit=5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [11, 10, 12] and got[0]["fused"] == pytest.approx(1 / 62 + 1 / 61)
    assert fusion.fuse(v, k).count() == 2 and fusion.fuse(v.limit(0), k).count() == 0
    assert fusion.heads(fusion.fuse(v, k, limit=5)).first()["band"] == "soft"  # the head by rank, not the best


@pytest.mark.parametrize(("sim", "band"), [(0.67, "answer"), (0.6699, "soft"), (0.60, "soft"), (0.5999, "bridge"), (0.45, "bridge"), (0.4499, "miss"), (None, "miss")])
def test_band_edges(spark, sim, band):
    assert spark.range(1).select(fusion.band(F.lit(sim).cast("double"))).first()[0] == band


def test_identifier_promotion(spark):
    ranked = spark.createDataFrame([(1, 5, 0.5, 1, "other"), (1, 6, 0.48, 2, "IS 456 applies")], "query_id long, id long, similarity double, rank int, content string")
    q = spark.createDataFrame([(1, "what says IS 456")], "query_id long, query string")
    got = fusion.promote_identifiers(ranked, q).orderBy("rank").collect()
    assert [(r["id"], r["band"], r["promoted"]) for r in got] == [(6, "soft", True), (5, "soft", True)]


def test_budget_prefix(spark):
    rows = [(1, r, "T", None, 1, 1, "x" * 220, 230) for r in (1, 2, 3)] + [(2, 1, "T", None, 1, 1, "y" * 5000, 100)]
    got = retrieval.fit_passages(spark.createDataFrame(rows, "query_id long, rank int, doc_title string, clause string, page_from int, page_to int, content string, available int")).collect()
    by = {(r["query_id"], r["rank"]): r for r in got}
    assert set(by) == {(1, 1), (1, 2), (2, 1)} and by[2, 1]["clipped"] and len(by[2, 1]["content"]) < 220


def test_finalise_counts_distinct_chunks(spark):
    docs = spark.createDataFrame([("a", 2, "pending"), ("b", 2, "pending")], "doc_id string, chunk_count int, status string")
    chunks = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 1)], "doc_id string, chunk_index int")
    assert {r["doc_id"]: r["status"] for r in store.finalise(docs, chunks).collect()} == {"a": "pending", "b": "ready"}


def test_prune_decision(spark):
    ddl = "file string, chunks int, error string, skipped boolean, reason string"
    run = lambda rows, n, **k: store.should_prune(spark.createDataFrame(rows, ddl), n, **k)[:2]
    ok = ("a", 3, None, False, None)
    assert run([ok], 1) == (True, "ok") and run([ok], 1, keep_stale=True) == (False, "keep-stale")
    assert run([], 0) == (False, "empty-selection") and run([ok, ("b", 0, "boom", False, None)], 2) == (False, "ingest-failed")
    assert run([ok, ("b", 0, None, True, "unchanged")], 2) == (True, "ok") and run([ok, ("b", 0, None, True, "scanned")], 2) == (False, "ingest-failed")


def test_topics_take_turns(spark):
    rows = [("a", "A", i, 1, c) for i, c in enumerate(["1", "2", "10", "2018"])] + [("b", "B", 0, 3, "Annex A"), ("b", "B", 1, 4, None)]
    df = spark.createDataFrame(rows, "doc_id string, doc_title string, chunk_index int, page_from int, clause string")
    assert [(r["doc_label"], r["clause"]) for r in topics.corpus_topics(df, 4).orderBy("place").collect()] == [("A", "1"), ("B", "Annex A"), ("A", "2"), ("A", "10")]


def chunk_rows(spark, n=6):
    rows = [(i, f"d{i % 2}", f"T{i % 2}", 1, 1, None, i, f"content {i}", [0.6, 0.8], dt.datetime(2024, 1, 1)) for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def doc_rows(spark, chunks=3):
    from tessera.sources.store import DOCUMENTS

    return spark.createDataFrame([(f"d{i}", f"T{i}", f"d{i}.pdf", 2, chunks, False, dt.datetime(2024, 1, 1), "pending", 0, "h") for i in range(2)], DOCUMENTS)


EMBED = {"provider": "local", "model": "a/b c", "dims": 2}


def test_store_stream_and_snapshot(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "store"))
    assert kept.read("chunks").count() == 0
    kept.change(documents=lambda old: store.upsert(old, doc_rows(spark), ["doc_id"]))
    land = str(tmp_path / "land")
    chunk_rows(spark, 4).write.parquet(land)
    ingest_stream(spark, land, kept, str(tmp_path / "cp")).awaitTermination()
    assert kept.read("chunks").count() == 4 and store.corpus_stats(kept.read("documents")).first()["doc_count"] == 0
    chunk_rows(spark, 6).write.mode("append").parquet(land)  # old keys again, and the rest
    ingest_stream(spark, land, kept, str(tmp_path / "cp")).awaitTermination()
    assert kept.read("chunks").count() == 6
    assert tuple(store.corpus_stats(kept.read("documents")).first()) == (2, 6, 0)
    folder = snapshot.export_bundle(kept.read("documents"), kept.read("chunks"), str(tmp_path / "snap"), EMBED, created_at=dt.datetime(2024, 5, 6, 7, 8, 9))
    assert folder.endswith("20240506T070809Z-local-a-b-c-2d") and snapshot.resolve_bundle(spark, str(tmp_path / "snap")) == folder
    other = Store(spark, str(tmp_path / "other"))
    assert ingest.import_bundle(spark, folder, other, EMBED).count() == 0
    key = ["doc_id", "chunk_index", "content", "embedding"]
    assert sorted(map(str, other.read("chunks").select(*key).collect())) == sorted(map(str, kept.read("chunks").select(*key).collect()))
    with pytest.raises(snapshot.SnapshotError, match="dims"):
        snapshot.read_bundle(spark, folder, {**EMBED, "dims": 3})
    part = next((tmp_path / "snap").glob("*/chunks.jsonl.gz/*.gz"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(snapshot.SnapshotError, match="checksum"):
        snapshot.read_bundle(spark, folder, EMBED)
    assert kept.sync_fingerprint({**EMBED, "dims": 3}) == "rewrite" and kept.sync_fingerprint({**EMBED, "dims": 4}) == "recreate"
    assert kept.read("chunks").count() == 0


def test_readers_see_the_store_before_or_after_a_change(spark, tmp_path, monkeypatch):
    kept = Store(spark, str(tmp_path / "s"), buckets=4)
    kept.change(documents=lambda _: doc_rows(spark), chunks=lambda _: chunk_rows(spark, 6))
    commit, seen = Store._commit, []

    def look(self, manifest):  # both tables are written, the manifest is not
        other = Store(spark, str(tmp_path / "s"))
        seen.append((other.read("chunks").count(), other.read("documents").count()))
        commit(self, manifest)

    monkeypatch.setattr(Store, "_commit", look)
    kept.change(chunks=lambda c: c.where("id < 2"), documents=lambda d: d.limit(1))
    assert seen == [(6, 2)] and kept.read("chunks").count() == 2 and kept.read("documents").count() == 1

    def stop(self, manifest):
        raise RuntimeError("stopped")

    monkeypatch.setattr(Store, "_commit", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        kept.change(chunks=lambda c: c.limit(0))
    assert Store(spark, str(tmp_path / "s")).read("chunks").count() == 2


def test_only_touched_partitions_are_written(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"), buckets=8)
    rows = [(i, f"d{i}", "T", 1, 1, None, 0, "old", [1.0], dt.datetime(2024, 1, 1)) for i in range(60)]
    kept.change(chunks=lambda _: spark.createDataFrame(rows, CHUNKS))
    before = kept._manifest()["chunks"]
    new = spark.createDataFrame([(100, "d7", "T", 1, 1, None, 0, "new", [1.0], dt.datetime(2024, 1, 2)), (101, "d7", "T", 1, 1, None, 0, "newer", [1.0], dt.datetime(2024, 1, 3))], CHUNKS)
    kept.upsert_chunks(new)
    after = kept._manifest()["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    got = {r["doc_id"]: r["content"] for r in kept.read("chunks").collect()}
    assert len(got) == 60 == kept.read("chunks").count() and got["d7"] == "newer" and got["d8"] == "old"
    kept.keep_hours = 0
    for n in range(4):
        kept.upsert_chunks(new.limit(1))
    assert len(kept._names(str(tmp_path / "s" / "chunks"))) <= 3 and len(kept._manifests()) <= 2
    kept.upsert_chunks(new.limit(0))
    assert kept.read("chunks").count() == 60


def test_a_read_outlives_three_batches(spark, tmp_path):
    """A read that began before three micro-batches of a stream finishes after them; each is one
    commit. Only what is older than the store keeps goes."""
    kept = Store(spark, str(tmp_path / "s"), buckets=4, keywords=True)
    kept.change(documents=lambda _: doc_rows(spark), chunks=lambda _: chunk_rows(spark, 2))
    began, words = kept.read("chunks"), kept.keyword_index()
    before = len(kept._manifests())
    for n in (3, 4, 6):
        land = str(tmp_path / "land")
        chunk_rows(spark, n).write.mode("append").parquet(land)
        ingest_stream(spark, land, kept, str(tmp_path / "cp")).awaitTermination()
    assert len(kept._manifests()) == before + 3
    assert began.count() == 2 and words.postings().where("term = 'content'").count() == 2
    assert kept.read("chunks").count() == 6 and kept.read("documents").where("status = 'ready'").count() == 2
    assert kept.keyword_index().postings().where("term = 'content'").count() == 6
    kept.keep_hours = 0
    kept.upsert_chunks(chunk_rows(spark, 1))
    kept.upsert_chunks(chunk_rows(spark, 1))
    assert len(kept._manifests()) <= 2 and kept.read("chunks").count() == 6
    live = {x["path"].rsplit("/", 1)[1] for x in kept._manifest()["keywords"]["segments"]}
    assert live <= set(kept._names(str(tmp_path / "s" / "keywords")))


def test_pending_documents(spark):
    assert [tuple(r) for r in store.pending(doc_rows(spark).unionAll(doc_rows(spark).withColumn("status", F.lit("ready")))).collect()] == [("d0", "d0.pdf", 3, 0), ("d1", "d1.pdf", 3, 0)]


def test_one_file_bundles(spark, tmp_path):
    """A bundle as other programs write it, made here by hand; and what is refused."""
    import gzip
    import hashlib
    import json

    docs = [{"doc_id": f"d{i}", "doc_title": f"T{i}", "source_file": f"d{i}.pdf", "page_count": 2, "chunk_count": 2, "is_scanned": False, "status": "ready", "embedded_count": 2, "pdf": {"bytes": 5, "sha256": "ab"}} for i in range(2)]
    chunks = [{"doc_id": f"d{i % 2}", "doc_title": f"T{i % 2}", "page_from": 1, "page_to": 1, "clause": None, "chunk_index": i // 2, "content": f"text {i}\n", "embedding": "[0.6,0.8]"} for i in range(4)]
    folder = tmp_path / "b"
    folder.mkdir()

    def bundle(lines, name="of another program", **over):
        sums = {}
        for file, body in lines.items():
            (folder / file).write_bytes(raw := gzip.compress(body.encode(), 9))
            sums[file] = {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
        manifest = {"format": name, "formatVersion": 1, "createdAt": "2026-09-27T11:53:19.000Z", "embed": {**EMBED, "prefixTitle": False}, "corpus": {"docCount": 2, "chunkCount": 4, "pageCount": 4}, "files": sums}
        (folder / "manifest.json").write_text(json.dumps({**manifest, **over}))

    text = lambda rows: "\n".join(map(json.dumps, rows)) + "\n\n"
    good = {"documents.jsonl.gz": text(docs), "chunks.jsonl.gz": text(chunks)}
    bundle(good)
    kept = Store(spark, str(tmp_path / "s"))
    assert ingest.import_bundle(spark, str(folder), kept, EMBED, format_name="of another program").count() == 0
    assert kept.read("chunks").count() == 4 and kept.fingerprint() == EMBED and kept.read("documents").where("status = 'ready'").count() == 2
    with pytest.raises(snapshot.SnapshotError, match="format is"):
        snapshot.read_bundle(spark, str(folder), EMBED)
    bundle({**good, "chunks.jsonl.gz": text(chunks[:1]) + "{broken\n"})
    with pytest.raises(snapshot.SnapshotError, match="chunks.jsonl.gz line 3 "):
        snapshot.read_bundle(spark, str(folder), EMBED, format_name="of another program")
    bundle({**good, "chunks.jsonl.gz": text(chunks[:3])})
    with pytest.raises(snapshot.SnapshotError, match="differs from the manifest"):  # and nothing is wiped for it
        ingest.import_bundle(spark, str(folder), kept, EMBED, replace=True, format_name="of another program")
    assert kept.read("chunks").count() == 4
    pdfs = spark.createDataFrame([("d1.pdf", 9, "cd")], "source_file string, bytes long, sha256 string")
    made = snapshot.export_store(kept, str(tmp_path / "out"), EMBED, one_file=True, pdfs=pdfs)
    from pathlib import Path

    manifest = json.loads(Path(made, "manifest.json").read_text())
    raw = Path(made, "chunks.jsonl.gz").read_bytes()
    assert manifest["files"]["chunks.jsonl.gz"] == {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
    assert [(d["docId"], d["pdfBytes"], d["pdfSha256"]) for d in manifest["documents"]] == [("d0", None, None), ("d1", 9, "cd")]
    assert [json.loads(x)["content"] for x in gzip.decompress(raw).decode().splitlines()] == ["text 0\n", "text 2\n", "text 1\n", "text 3\n"]
    _, back, _ = snapshot.read_bundle(spark, made, EMBED)
    assert back.count() == 4
    with pytest.raises(snapshot.SnapshotError, match="configuration"):
        snapshot.export_store(kept, str(tmp_path / "out"), {**EMBED, "model": "x"})
    with pytest.raises(snapshot.SnapshotError, match="does not say"):
        snapshot.export_store(Store(spark, str(tmp_path / "none")), str(tmp_path / "out"), EMBED)


def test_pdf_sources(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "ListOfProducts.pdf", "x.txt"):
        (tmp_path / name).write_bytes(f"{name} one\fpage two".encode())
    found = files.list_pdfs(spark, str(tmp_path), ["listofproducts"], content=True)
    assert [r["source_file"] for r in found.collect()] == ["a.pdf", "b.PDF"]
    got = files.extract_pages(found, lambda b: b.decode().split("\f"))
    assert {(r["doc_id"], r["page_number"], r["text"]) for r in got.collect()} == {("a", 1, "a.pdf one"), ("a", 2, "page two"), ("b", 1, "b.PDF one"), ("b", 2, "page two")}
    assert files.list_pdfs(spark, str(tmp_path / "none")).count() == 0
    assert [files.resolve_in("/c", n) for n in ("a.pdf", "../x", "/etc", "a\x00", None, "s/../b.pdf")] == ["/c/a.pdf", None, None, None, None, "/c/b.pdf"]


def fake_embed(texts):
    return [[float(t.count(c)) + 0.01 for c in "abcdefgh"] for t in texts]


def test_index_pages_and_resume(spark, tmp_path):
    raw = spark.createDataFrame([(d, f"{d}.pdf", p, "\n".join(f"{S} {d}{p}{k}." for k in range(6))) for d in ("x", "y") for p in (1, 2)] + [("z", "z.pdf", 1, "")], "doc_id string, source_file string, page_number int, text string")
    kept = Store(spark, str(tmp_path / "s"))
    ingest.index_pages(raw, kept, fake_embed, 8)
    docs = {r["doc_id"]: r for r in kept.read("documents").collect()}
    assert set(docs) == {"x", "y"} and all(r["status"] == "ready" for r in docs.values())
    first = kept.read("chunks").count()
    ingest.index_pages(raw, kept, fake_embed, 8)
    assert kept.read("chunks").count() == first == sum(r["chunk_count"] for r in docs.values())


def test_embedding_is_checked_and_normalised(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string")
    got = models.embed(df, "t", fake_embed, 8, batch=1).collect()
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1, abs=1e-6) for r in got)
    with pytest.raises(Exception, match="width"):
        models.embed(df, "t", fake_embed, 9).collect()


def test_every_outcome_of_answering(spark):
    texts = {1: "aaaa bbbb cement", 2: "cccc dddd", 3: "eeee ffff IS 456 limit"}
    rows = [(i, fake_embed([t])[0], "T", None, 1, 1, t) for i, t in texts.items()]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, doc_title string, clause string, page_from int, page_to int, content string")
    asked = {
        1: "hello", 2: "what about aaaa bbbb", 3: "aaaa bbbb", 4: "what is gggghhhh", 5: "सीमेंट क्या",
        6: "what of eeee ffff fail", 7: "what of cccc dddd none", 8: "what about cccc dddd loop",
    }
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")

    def generate(prompts):
        p = prompts[0]
        if "fail" in p:
            raise models.ModelError("no")
        return ["NOT_FOUND" if "none" in p else "no" if "loop" in p else "The limit for aaaa is stated in the passage."]

    def translate(_):
        raise models.ModelError("down")

    embed = lambda df: models.embed(df, "english", fake_embed, 8)
    got = {r["query_id"]: r for r in answer.answer_batch(q, chunks, keywords.postings(chunks, "id", "content"), embed, translate, generate, Settings(bridge_floor=0.6, soft_threshold=0.65, similarity_threshold=0.7)).collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {1: "chitchat", 2: "answered", 3: "located", 4: "miss", 5: "translation_failed", 6: "generation_failed", 7: "declined", 8: "generation_degenerate"}
    assert got[2]["sources"][0] == 1 and got[2]["answer"].startswith("The limit") and got[4]["reason"] == "nothing_above_bridge_floor"


def test_models_are_called_in_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def model(texts):
        sizes.add(1)
        if any("bad" in t for t in texts):
            raise models.ModelError("no", 400)
        if any("quota" in t for t in texts):
            raise models.ModelError("quota", 402)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(20)], "i int, p string").coalesce(1)
    got = {r["i"]: r["o"] for r in answer._call(df, model, "p", "o").collect()}
    assert sizes.value == 1 + 16 + 1 and got[3]["error"] and got[3]["text"] is None and all(got[i]["text"] == f"T{i}" for i in got if i != 3)
    one = spark.createDataFrame([("quota",)], "p string")
    assert answer._call(one, model, "p", "o", lambda texts: ["second"]).first()["o"]["text"] == "second" and answer._call(one, model, "p", "o").first()["o"]["error"]


def test_late_events_are_windowed(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 0, 59), "a"), (dt.datetime(2024, 1, 1, 1, 0), "a")], "ts timestamp, event_type string")
    assert sorted(r["n"] for r in arrivals(df).collect()) == [1, 2]

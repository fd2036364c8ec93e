"""Keyed state of documents: counted once, dropped when ready, told when stalled."""

from tessera.streaming import progress


def land(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id string, chunk_count int, chunk_index long").coalesce(1).write.mode("append").parquet(folder)


def test_chunks_count_once_and_state_goes(spark, tmp_path):
    land_at, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))

    def run(rows, stalled=3_600_000):
        land(spark, land_at, rows)
        q = progress.follow(spark, land_at, out, check, stalled)
        q.awaitTermination()
        told = {(r["doc_id"], r["status"], r["chunk_count"], r["embedded_count"]) for r in spark.read.schema(progress.PROGRESS).parquet(out).collect()}
        return told, sum(s.get("numRowsTotal", 0) for p in q.recentProgress[-1:] for s in p["stateOperators"])

    far = progress.PAGE + 5
    told, held = run([("a", 4, None), ("a", None, 0), ("a", None, 0), ("b", 1, None), ("c", None, far), ("d", 2, None), (None, 1, 1)])
    assert told == {("a", "pending", 4, 1), ("b", "pending", 1, 0), ("c", "pending", None, 1), ("d", "pending", 2, 0)} and held > 0
    # the same keys again, late, and the rest
    told, _ = run([("a", None, 0), ("a", None, 1), ("a", None, 2), ("c", 3, None), ("c", None, far), ("c", None, 0)])
    assert ("a", "pending", 4, 3) in told and ("c", "pending", 3, 2) in told
    told, held = run([("a", None, 2), ("a", None, 3), ("b", None, 0), ("c", None, 7), ("d", None, 0), ("d", None, 1), ("d", None, 1)])
    assert {("a", "ready", 4, 4), ("b", "ready", 1, 1), ("c", "ready", 3, 3), ("d", "ready", 2, 2)} <= told
    assert held == 0


def test_stalled_documents_are_told(spark, tmp_path):
    land_at, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    for rows in ([("s", 3, None), ("s", None, 0), ("late", None, 0)], [("t", 9, None)], [("u", 9, None)]):
        land(spark, land_at, rows)
        progress.follow(spark, land_at, out, check, 1).awaitTermination()
    told = {tuple(r) for r in spark.read.schema(progress.PROGRESS).parquet(out).select("doc_id", "status", "embedded_count").collect()}
    assert ("s", "stalled", 1) in told and not any(d == "late" and s == "stalled" for d, s, _ in told)

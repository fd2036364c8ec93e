"""Requests within a cap, resets, provider forms and rotation beyond the basic plane."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import models, text
from tessera.plans import ingest
from tessera.sources.store import Store

S = "The value shall be recorded after drying for one hour at the stated temperature in a clean oven."


class Service:
    """Counts the requests of a day in a file, and refuses those above its cap."""

    def __init__(self, path, cap, fail_every=0):
        self.path, self.cap, self.fail_every = str(path), cap, fail_every

    def __call__(self, texts):
        import os

        fd = os.open(self.path, os.O_APPEND | os.O_CREAT | os.O_RDWR)
        os.write(fd, b"x")
        n = os.fstat(fd).st_size
        os.close(fd)
        if n > self.cap:
            raise models.ModelError("quota: daily reset tomorrow", 429)
        if self.fail_every and n % self.fail_every == 0:
            raise models.ModelError("down", 503)
        return [[float(t.count(c)) + 0.01 for c in "abcd"] for t in texts]

    def sent(self):
        import os

        return os.path.getsize(self.path) if os.path.exists(self.path) else 0


@pytest.mark.parametrize("fail_every", [0, 4])
def test_cap_is_never_exceeded(spark, tmp_path, fail_every):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "i int, t string").repartition(3)
    service = Service(tmp_path / "n", 1000, fail_every)
    for cap, rows in ((7, 35), (1, 5), (0, 0), (100, 200)):
        before = service.sent()
        got = models.embed_within(df, "t", service, 4, cap, batch=5, kind="local")
        done = got.where("embedding IS NOT NULL").count()
        assert service.sent() - before <= cap and got.count() == 200
        assert done == rows if not fail_every else done <= rows
    early = Service(tmp_path / "m", 3)  # the service's own cap comes first: a clean stop
    assert models.embed_within(df, "t", early, 4, 20, batch=5).where("embedding IS NOT NULL").count() <= 15


def test_the_next_run_finishes(spark, tmp_path):
    raw = spark.createDataFrame([(d, f"{d}.pdf", p, "\n".join(f"{S} {d}{p}{k}." for k in range(6))) for d in ("x", "y") for p in (1, 2)], "doc_id string, source_file string, page_number int, text string")
    from tessera.config import Settings

    kept, days = Store(spark, str(tmp_path / "s")), 0
    settings = Settings(embed_batch_size=1)
    while days < 9:
        days += 1
        service = Service(tmp_path / f"day{days}", 3)
        ingest.index_pages(raw, kept, service, 4, settings, cap=3)
        assert service.sent() <= 3
        states = [r["status"] for r in kept.read("documents").collect()]
        if set(states) == {"ready"}:
            break
        assert "pending" in states
    chunks = kept.read("chunks").count()
    assert set(states) == {"ready"} and 1 < days <= chunks


def test_resets_are_waited_for():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise models.ModelError("slow down", 429, reset=1000.0 + (7 if len(calls) == 1 else 900 if len(calls) == 2 else -5))
        return "ok"

    assert models.with_retry(call, "cloud", waits.append, clock=lambda: 1000.0) == "ok"
    assert waits[0] == 7.5 and 2 <= waits[1] <= 2.5 and 4 <= waits[2] <= 4.5
    for status, ceiling in ((503, 8.0), (429, 45.0)):
        waits.clear()

        def fail(status=status):
            raise models.ModelError("x", status)

        with pytest.raises(models.ModelError):
            models.with_retry(fail, "cloud", waits.append)
        assert len(waits) == 7 and ceiling <= waits[-1] <= ceiling + 0.5
    with pytest.raises(models.OutOfBudget):
        models.with_retry(lambda: models.with_retry(fail, "router", lambda _: None, models.Budget(2)), "router")


def test_inputs_of_services(spark):
    df = spark.createDataFrame([("body", "Title"), ("body", ""), ("body", None)], "t string, h string")
    rows = df.select(text.titled_input("t", "h").alias("a"), text.titled_input("t", "h", False).alias("b"), text.separate_input("t", "h").alias("c"), text.document_input("t", "h").alias("d")).collect()
    assert [r["a"] for r in rows] == ["Title\n\nbody", "body", "body"] and {r["b"] for r in rows} == {"body"}
    assert [tuple(r["c"]) for r in rows] == [("body", "Title"), ("body", None), ("body", None)] and rows[0]["d"] == "search_document: Title\n\nbody"


def test_rotation_takes_utf16_units(spark):
    def plain(s):
        h = 2166136261
        raw = s.encode("utf-16-be", "surrogatepass")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) % 2**32
        return h - 2**32 if h >= 2**31 else h

    texts = ["", "abc", "Ünï", "a🙂b", "𝔘𝔫𝔦"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.fnv1a("t")).collect()] == [plain(t) if t else 2166136261 for t in texts]


def test_import_reports_files(spark, tmp_path):
    from tessera.sources import snapshot

    docs = spark.createDataFrame([(f"d{i}", "T", f"d{i}.pdf", 1, 1, False, "ready", 1) for i in range(4)], "doc_id string, doc_title string, source_file string, page_count int, chunk_count int, is_scanned boolean, status string, embedded_count int")
    chunks = spark.createDataFrame([(i, f"d{i}", "T", 1, 1, None, 0, "x", [1.0], dt.datetime(2024, 1, 1)) for i in range(4)], "id long, doc_id string, doc_title string, page_from int, page_to int, clause string, chunk_index int, content string, embedding array<float>, created_at timestamp")
    embed = {"provider": "local", "model": "m", "dims": 1}
    then = spark.createDataFrame([("d0.pdf", 1, "aa"), ("d1.pdf", 1, "bb"), ("d3.pdf", 1, "cc")], "source_file string, bytes long, sha256 string")
    folder = snapshot.export_bundle(docs, chunks, str(tmp_path / "b"), embed, one_file=True, pdfs=then)
    now = spark.createDataFrame([("d0.pdf", "aa"), ("d1.pdf", "zz"), ("d2.pdf", "yy")], "source_file string, sha256 string")
    orphans, report, said = ingest.import_and_report(spark, folder, Store(spark, str(tmp_path / "s")), embed, now)
    assert orphans.count() == 0 and {r["doc_id"]: r["state"] for r in report.collect()} == {"d0": "present", "d1": "modified", "d2": "unverified", "d3": "missing"}
    assert said == "1 present, 1 unverified, 1 modified, 1 missing"


def test_one_file_export_is_joined_from_parts(spark, tmp_path):
    import gzip
    import json

    from tessera.sources.snapshot import Files

    rows = spark.range(5000).select(F.col("id"), F.repeat(F.lit("x"), 50).alias("t")).repartition(7).orderBy("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        Files(spark, str(tmp_path)).write_lines("rows.jsonl.gz", rows, one_file=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    raw = (tmp_path / "rows.jsonl.gz").read_bytes()
    assert raw.count(b"\x1f\x8b\x08") > 1  # several members
    assert [json.loads(x)["id"] for x in gzip.decompress(raw).splitlines()] == list(range(5000))
    assert spark.read.text(str(tmp_path / "rows.jsonl.gz")).count() == 5000 and not (tmp_path / "rows.jsonl.gz.parts").exists()

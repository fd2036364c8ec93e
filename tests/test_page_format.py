"""The page source: partitions, filters that open one file, and a stream that goes on."""

import os

from tessera.sources import page_format
from tessera.sources.page_format import PageReader, PageStream


def extract(raw):
    return raw.decode().split("\f")


def folder(tmp_path, n=6):
    for i in range(n):
        path = tmp_path / f"doc{i}.PDF"
        path.write_text("\f".join(f"doc{i} page {p}" for p in range(1, 4)))
        os.utime(path, (1000 + i, 1000 + i))
    (tmp_path / "notes.txt").write_text("no")
    return str(tmp_path)


def test_batch_reads_and_filters(spark, tmp_path):
    page_format.register(spark, extract)
    at = folder(tmp_path)
    df = spark.read.format("pages").option("partitionBytes", 70).load(at)
    assert df.count() == 18 and df.rdd.getNumPartitions() == 3
    one = df.where("doc_id = 'doc3' and page_number >= 2 and text like '%page%'")
    assert sorted(tuple(r) for r in one.collect()) == [("doc3", "doc3.PDF", 2, "doc3 page 2"), ("doc3", "doc3.PDF", 3, "doc3 page 3")]
    assert one.rdd.getNumPartitions() == 1
    for i in range(6):  # only the file of the document is opened: the others are no longer there
        if i != 3:
            (tmp_path / f"doc{i}.PDF").write_bytes(b"\xff\xfe not text")
    assert one.count() == 2
    assert df.where("doc_id in ('doc3', 'none')").count() == 3
    assert spark.read.format("pages").load(str(tmp_path / "none")).count() == 0


def test_partitions_are_bounded(tmp_path):
    at = folder(tmp_path)
    reader = PageReader({"path": at, "partitionBytes": "1"}, extract)
    assert [len(p.files) for p in reader.partitions()] == [1] * 6
    assert [len(p.files) for p in PageReader({"path": at}, extract).partitions()] == [6]


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    page_format.register(spark, extract)
    (tmp_path / "in").mkdir()
    at, out, check = folder(tmp_path / "in", 3), str(tmp_path / "out"), str(tmp_path / "check")

    def drain():
        q = spark.readStream.format("pages").load(at).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert drain() == 9
    new = tmp_path / "in" / "later.pdf"
    new.write_text("a\fb")
    os.utime(new, (2000, 2000))
    assert drain() == 11 and drain() == 11
    stream = PageStream({"path": at}, extract)
    assert [len(p.files) for p in stream.partitions(stream.initialOffset(), stream.latestOffset())] == [4]
    assert stream.partitions(stream.latestOffset(), stream.latestOffset()) == []


def test_pages_of_several_files_are_numbered_through(spark, tmp_path):
    import duckdb

    from tessera.catalogue.texts import SQL, page_source

    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    con = duckdb.connect()
    for i, n in enumerate((3, 1, 4)):
        con.execute(f"COPY (SELECT range AS doc_id, 'text {i}-' || range AS text FROM range({n})) TO '{folder}/part-{i}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    got = sorted(map(tuple, page_source(spark, str(tmp_path)).select("page_number", "sha256").collect()))
    assert got == sorted(con.sql(SQL["page_source"]).fetchall()) and [n for n, _ in got] == list(range(1, 9))

"""Page sources: PDF folders read by Spark, with an injected text extractor."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of, normalise_whitespace
from ..session import ship_package

PAGES_DDL = "doc_id string, source_file string, page_number int, text string"


def list_pdfs(spark: SparkSession, folder: str, exclude: list[str] | None = None, content: bool = False) -> DataFrame:
    """path, source_file, length (and content) of the PDFs of a folder; names
    that contain an excluded word (in any case) are left out; a missing folder is empty. A
    listing is sorted by name; with content it is not, as files are not to be moved for that."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    cols = ["path", "source_file", "length", *(["content"] if content else [])]
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], "path string, source_file string, length long" + (", content binary" if content else ""))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    files = files.withColumn("source_file", F.element_at(F.split("path", "/"), -1))
    words = [w.strip().lower() for w in exclude or [] if w.strip()]
    if words:
        files = files.where(~any_of([F.contains(F.lower("source_file"), F.lit(w)) for w in words]))
    return files.select(*cols) if content else files.select(*cols).orderBy("source_file")


def extract_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """doc_id, source_file, page_number, text. ``extract`` turns a file's bytes into its pages;
    it runs in the tasks, a file at a time. The document id is the file's name without ending."""
    ship_package(files.sparkSession)
    schema = pa.schema([("doc_id", pa.string()), ("source_file", pa.string()), ("page_number", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pages = extract(content)
                doc = posixpath.splitext(name)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([doc] * len(pages), [name] * len(pages), range(1, len(pages) + 1), pages), schema)], schema=schema)

    pages = files.select("source_file", "content").mapInArrow(run, PAGES_DDL)
    return pages.withColumn("text", normalise_whitespace(F.coalesce("text", F.lit(""))))


def resolve_in(folder: str, name: str | None) -> str | None:
    """The path of a stored file below ``folder``, or None for a name that leads elsewhere."""
    if not name or "\x00" in name or name.startswith(("/", "\\")):
        return None
    path = posixpath.normpath(posixpath.join(folder, name.replace("\\", "/")))
    return path if path.startswith(posixpath.normpath(folder) + "/") else None

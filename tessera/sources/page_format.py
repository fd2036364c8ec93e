"""Pages of document files as a data source: ``spark.read.format("pages")`` and ``readStream``.

A partition is some files of at most ``partitionBytes`` together, or one larger file. Filters on
``doc_id`` and ``page_number`` are taken over: other files are not opened, other pages not returned.
A stream's offset is the time and name of the last file that was seen, so it goes on there. Files
are reached as pyarrow reaches them (a local or mounted path, hdfs, s3, gs); the extractor, which
turns a file's bytes into its pages, is given to ``register`` and runs in the tasks.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import pickle_whole, ship_package
from .files import PAGES_DDL

PARTITION_BYTES = 32 << 20
_SCHEMA = pa.schema([("doc_id", pa.string()), ("source_file", pa.string()), ("page_number", pa.int32()), ("text", pa.string())])


@dataclass(frozen=True)
class File:
    path: str
    size: int
    seen: int  # nanoseconds of its last change

    @property
    def name(self) -> str:
        return posixpath.basename(self.path)

    @property
    def doc_id(self) -> str:
        return posixpath.splitext(self.name)[0]


@dataclass
class Files(InputPartition):
    files: list[File]


def reached(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def listed(folder: str, ending: str) -> list[File]:
    """The files of a folder, by time and name; a missing folder is empty."""
    fs, path = reached(folder)
    found = [File(i.path, i.size, i.mtime_ns or 0) for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.is_file and i.path.lower().endswith(ending)]
    return sorted(found, key=lambda f: (f.seen, f.name))


def dealt(files: list[File], most: int) -> list[Files]:
    parts, size = [], most
    for f in sorted(files, key=lambda f: f.name):
        if not parts or size + f.size > most:
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(f)
        size += f.size
    return parts


def taken(f: Filter) -> Callable[[str, int | None], bool] | None:
    """A filter on the document or the page as a test of (doc_id, page or None for a whole file)."""
    compare = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
    column = getattr(f, "attribute", ())
    if type(f) not in compare or column not in (("doc_id",), ("page_number",)) or column == ("doc_id",) and not isinstance(f, (EqualTo, In)):
        return None
    test, value = compare[type(f)], f.value
    if column == ("doc_id",):
        return lambda doc, page: test(doc, value)
    return lambda doc, page: page is None or test(page, value)


class Pages:
    """Reading partitions, for batches and streams."""

    def __init__(self, options: dict, extract: Callable[[bytes], list[str]]):
        self.folder, self.extract = options["path"], extract
        self.ending = options.get("ending", ".pdf").lower()
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list = []

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        fs, _ = reached(self.folder)
        for f in partition.files if partition else []:  # without partitions one task is run all the same
            with fs.open_input_stream(f.path) as stream:
                pages = list(enumerate(self.extract(stream.read()), 1))
            pages = [(n, t) for n, t in pages if all(test(f.doc_id, n) for test in self.tests)]
            if pages:
                numbers, texts = zip(*pages)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(([f.doc_id] * len(pages), [f.name] * len(pages), numbers, texts), _SCHEMA)], schema=_SCHEMA)


class PageReader(Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (test := taken(f)) is not None:
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[Files]:
        return dealt([f for f in listed(self.folder, self.ending) if all(test(f.doc_id, None) for test in self.tests)], self.most)


class PageStream(Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seen": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder, self.ending)
        return {"seen": files[-1].seen, "name": files[-1].name} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["seen"], start["name"]), (end["seen"], end["name"])
        return dealt([f for f in listed(self.folder, self.ending) if after < (f.seen, f.name) <= upto], self.most)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, extract: Callable[[bytes], list[str]], name: str = "pages") -> None:
    """Make the format ``name`` known, with the extractor of its files. Options: path, ending
    (of file names, default ``.pdf``), partitionBytes."""
    ship_package(spark)
    pickle_whole(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES_DDL

        def reader(self, schema) -> PageReader:
            return PageReader(self.options, extract)

        def streamReader(self, schema) -> PageStream:
            return PageStream(self.options, extract)

    spark.dataSource.register(Source)

"""What a session needs before it runs this package's Python inside tasks."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MADE: list[str] | None = None  # folders of the innermost ``scratch``


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as any Spark job ships code."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def pickle_whole(module: str) -> None:
    """Send what a module defines by value. The Python processes in which the driver plans data
    sources and stream state have no files of the application."""
    if module not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(sys.modules[module])


#: Rows and bytes of an Arrow batch where rows carry whole texts; they bound what a Python
#: worker, and the JVM's buffers beside it, hold at once.
TEXT_ROWS_PER_BATCH = 512
TEXT_BYTES_PER_BATCH = 4 << 20
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Ready the session for Python tasks over whole texts: the package on the executors,
    small Arrow batches (a batch is a number of rows, and rows can be long)."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))
    if spark.conf.get(BYTES_SETTING, None) is None:
        spark.conf.set(BYTES_SETTING, str(TEXT_BYTES_PER_BATCH))


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local session gets a temporary folder; on a cluster every machine would
    have its own, so that is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/tessera-{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    if _MADE is not None:
        _MADE.append(uri)
    return uri


def remove_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """Folders that ``shared_folder`` hands out inside are removed at the end: for work whose
    result was written elsewhere by then, so that nothing will read them again."""
    global _MADE
    outer, _MADE = _MADE, []
    try:
        yield
    finally:
        made, _MADE = _MADE, outer
        for uri in made:
            remove_folder(spark, uri)


#: For rows of megabytes each: a file a row. Parquet's writer looks at its size after 100 rows, and
#: keeps the least and largest value of each group until the file ends; a reader hands on a group at once.
LARGE_ROWS = {"maxRecordsPerFile": 1}


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder (with ``options`` of the writer) and read back: computed once,
    and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

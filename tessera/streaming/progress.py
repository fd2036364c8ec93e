"""Progress of documents as keyed stream state.

For each document the stream keeps how many chunks it has, which of them were seen (a bit each) and
how many. A chunk that comes twice, in one batch or in several, counts once. When all are there the
document is reported as ready and its state is dropped; a document that stands still is reported
as stalled when its timer ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import pickle_whole, ship_package

PAGE = 1 << 15  # chunks whose bits are one entry of the state
PROGRESS = "doc_id string, chunk_count int, embedded_count long, status string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Without this a stream that ends when its input does would wait for its timers, batch by batch.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DocumentProgress(StatefulProcessor):
    """Input rows of a document: chunk_count (the document begins) or chunk_index (one is there).

    A document that begins again with another count goes on with the new one. Chunks that come
    before the count wait for it; those that come after the document was ready, and no count
    with them, are dropped when their timer ends.
    """

    def __init__(self, stalled_after_ms: int):
        self.stalled_after_ms = stalled_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "chunk_count int, embedded_count long")
        self.seen = handle.getMapState("seen", "page int", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, embedded = self.facts.get() if self.facts.exists() else (None, 0)
        for part in rows:
            counts = part["chunk_count"].dropna()
            if len(counts):
                count = int(counts.max())
            index = part["chunk_index"].dropna().astype(np.int64).unique()
            for page in np.unique(index // PAGE).tolist():
                bits = np.zeros(PAGE, bool)
                if self.seen.containsKey((page,)):
                    bits = np.unpackbits(np.frombuffer(self.seen.getValue((page,))[0], np.uint8)).astype(bool)
                own = index[index // PAGE == page] % PAGE
                embedded += int((~bits[own]).sum())
                bits[own] = True
                self.seen.updateValue((page,), (np.packbits(bits).tobytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if count is not None and embedded >= count:
            self.facts.clear()
            self.seen.clear()
            yield self.told(key, count, embedded, "ready")
        else:
            self.facts.update((count, embedded))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stalled_after_ms)
            yield self.told(key, count, embedded, "pending")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.facts.exists():
            return
        count, embedded = self.facts.get()
        if count is None:  # chunks of a document that was ready, or never began
            self.facts.clear()
            self.seen.clear()
        else:
            yield self.told(key, count, embedded, "stalled")

    def told(self, key, count, embedded, status) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "chunk_count": pd.array([count], "Int32"), "embedded_count": [embedded], "status": [status]})

    def close(self) -> None:
        pass


def document_progress(events: DataFrame, stalled_after_ms: int = 3_600_000) -> DataFrame:
    """PROGRESS rows of a stream of ``events`` (doc_id, chunk_count, chunk_index): one for each
    document of a batch, and one for each that stood still for so long. Write it with output mode
    ``append``. Rows without a document are left out."""
    spark = events.sparkSession
    ship_package(spark)
    pickle_whole(__name__)
    rows = events.select("doc_id", F.col("chunk_count").cast("int").alias("chunk_count"), F.col("chunk_index").cast("long").alias("chunk_index")).where("doc_id IS NOT NULL")
    return rows.groupBy("doc_id").transformWithStateInPandas(DocumentProgress(stalled_after_ms), PROGRESS, "append", "ProcessingTime")


def follow(spark: SparkSession, landing: str, out: str, checkpoint: str, stalled_after_ms: int = 3_600_000, files_a_batch: int | None = None):
    """Drain ``landing`` (Parquet: doc_id, chunk_count, chunk_index) into PROGRESS rows at ``out``."""
    reader = spark.readStream.schema("doc_id string, chunk_count int, chunk_index long")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    told = document_progress(reader.parquet(landing), stalled_after_ms)
    # several states and timers a key need this store; timers end with the next batch of data
    wanted = {STATE_STORE: ROCKS, NO_DATA: "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return told.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

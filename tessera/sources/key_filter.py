"""Bloom filters of stored keys, so that new keys need no read of the store.

A filter is some bits of each partition's keys; filters of one size are merged by ``or``. A key
whose bits are not all set is not stored; one whose bits are may be, and only then the partition
is read and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BITS_A_KEY, HASHES = 12, 6  # under one key in a hundred passes that is not there
LEAST_BITS = 1 << 13
FILTERS = "bucket int, bits binary"


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def bits_for(keys: int) -> int:
    """A power of two, so that filters of one size can be merged."""
    n = LEAST_BITS
    while n < BITS_A_KEY * keys:
        n *= 2
    return n


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` bits of each key, from the two halves of its hash."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def merged(filters: list[bytes]) -> bytes:
    """One filter of all keys of filters of one size."""
    return np.bitwise_or.reduce([np.frombuffer(f, np.uint8) for f in filters]).tobytes()


def build_filters(rows: DataFrame, bucket: Column, keys: list[str], bits: int) -> DataFrame:
    """bucket, bits of the keys of ``rows``: each task sets bits of its own, which are merged."""
    ship_package(rows.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("bits", pa.binary())])

    def own(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            buckets, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(buckets).tolist():
                found.setdefault(b, np.zeros(bits, bool))[places(hashes[buckets == b], bits).ravel()] = True
        for b, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], schema=schema)

    def one(part: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array([part["bucket"][0].as_py()], pa.int32()), pa.array([merged(part["bits"].to_pylist())], pa.binary())], schema=schema)

    parts = rows.select(bucket.cast("int").alias("bucket"), key_hash(keys).alias("hash")).mapInArrow(own, FILTERS)
    return parts.groupBy("bucket").applyInArrow(one, FILTERS)


def may_hold(wanted: DataFrame, filters: DataFrame, bucket: Column, keys: list[str]) -> DataFrame:
    """``wanted`` with ``_bucket`` and ``_maybe``: whether its partition can hold the key."""
    ship_package(wanted.sparkSession)

    @F.pandas_udf("boolean")
    def test(hash_, bits):
        out = np.zeros(len(hash_), bool)
        for cell, at in bits.groupby(bits, dropna=True).indices.items():
            raw = np.frombuffer(cell, np.uint8)
            p = places(hash_.to_numpy()[at], 8 * len(raw))
            out[at] = ((raw[p >> 3] >> (p & 7)) & 1).all(1)
        import pandas as pd

        return pd.Series(out)

    rows = wanted.withColumn("_bucket", bucket.cast("int"))
    rows = rows.join(filters.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), "_bucket", "left")
    return rows.withColumn("_maybe", test(key_hash(keys), F.col("_bits"))).drop("_bits")

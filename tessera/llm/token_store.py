"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A file holds, for one contiguous range of documents in ascending id order::

    magic 8 bytes | header: 8 little-endian int64 | ids | boundaries | document ids

The n+1 document boundaries (and the non-null document ids, less the smallest) are
Elias-Fano sequences: the low bits packed, the high bits unary in a bit vector, and one
32-bit count per 512 bits for ``select``. No 64-bit table is stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise, record_batch, shared_folder
from .tokens import encoder

MAGIC = b"TESSTOK1"
HEADER = struct.Struct("<8q")
BLOCK_BITS = 512


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about n(2 + log2(u/n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        blocks = int(at[-1]) // BLOCK_BITS + 1
        high = np.zeros(blocks * BLOCK_BITS, np.uint8)
        high[at] = 1
        ranks = np.concatenate([[0], np.cumsum(high.reshape(blocks, BLOCK_BITS).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ranks)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def get(self, i: int) -> int:
        """The i-th value: one search of the block counts, then a select inside a block."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, side="right")) - 1
        size = BLOCK_BITS // 8
        ones = np.flatnonzero(np.unpackbits(self.high[block * size : (block + 1) * size], bitorder="little"))
        at = block * BLOCK_BITS + int(ones[i - int(self.ranks[block])])
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((at - i) << self.low_bits) | self._low(i)

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_buffer(cls, buf, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at`` and the position after it; nothing is copied."""
        n, low_bits, n_low, n_high = struct.unpack_from("<4q", buf, at)
        at += 32
        low = np.frombuffer(buf, np.uint8, n_low, at)
        high = np.frombuffer(buf, np.uint8, n_high, at + n_low)
        n_ranks = n_high * 8 // BLOCK_BITS
        ranks = np.frombuffer(buf, "<u4", n_ranks, at + n_low + n_high)
        return cls(n, low_bits, low, high, ranks), at + n_low + n_high + 4 * n_ranks


def pack_file(doc_ids: list, ids: list[bytes], width: int) -> bytes:
    """doc_ids ascending, nulls first; ids: each document's ids as little-endian bytes."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.concatenate([[0], np.cumsum([len(b) // width for b in ids], dtype=np.int64)])
    # wrapping subtraction keeps the full 64-bit range of ids
    keys = EliasFano.build(known.view(np.uint64) - np.uint64(base & (2**64 - 1)))
    head = HEADER.pack(len(doc_ids), int(ends[-1]), width, nulls, base, 0, 0, 0)
    return b"".join([MAGIC, head, *ids, EliasFano.build(ends).to_bytes(), keys.to_bytes()])


class TokenFile:
    """A parsed file; ``document(i)`` selects one document without decoding the others."""

    def __init__(self, buf):
        if bytes(buf[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.n_docs, self.n_tokens, width, self.nulls, self.base, *_ = HEADER.unpack_from(buf, 8)
        at = 8 + HEADER.size
        self.ids = np.frombuffer(buf, f"<u{width}", self.n_tokens, at)
        self.bounds, at = EliasFano.from_buffer(buf, at + width * self.n_tokens)
        self.keys, _ = EliasFano.from_buffer(buf, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]

    def doc_ids(self) -> list:
        return [None] * self.nulls + (self.keys.all() + self.base).tolist()


def write_token_files(df: DataFrame, out_dir: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", max_file_tokens: int = 16_000_000) -> DataFrame:
    """Encode every text and write the token-id files; returns the manifest (one row a file).

    Documents are dealt by ranges of their id (Spark samples the split points) and sorted,
    so files hold ascending ids, null ids first; rows that share an id lie side by side, by
    the heads of their texts, and very many of them in several files. A null or empty text is just ``end_id``. An empty table writes no file. Files
    get their final name by a rename, so a lost executor leaves no partial file, and only
    those in the manifest count.
    """
    schema = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyarrow import fs

        enc = encoder(tokenizer)
        width = enc.dtype.itemsize if end_id is None or end_id < 1 << 8 * enc.dtype.itemsize else 4
        tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(out_dir)
        docs, ids, size, files = [], [], 0, 0

        def flush():
            nonlocal docs, ids, size, files
            name = f"ids-{context.partitionId():06d}-{files:04d}.tok"
            part = f"{root}/{name}.{context.taskAttemptId()}.part"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(part) as out:
                out.write(pack_file(docs, ids, width))
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(part, f"{root}/{name}")
            row = record_batch(schema, [[name], [docs[0]], [len(docs)], [size]])
            docs, ids, size, files = [], [], 0, files + 1
            return row

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                if width != enc.dtype.itemsize:
                    own = np.frombuffer(own, enc.dtype).astype(f"<u{width}").tobytes()
                docs.append(doc)
                ids.append(own + tail)
                size += len(ids[-1]) // width
                if size >= max_file_tokens:
                    yield flush()
        if docs:
            yield flush()

    # rows of one id, or without one, may be a third of all: their places deal them further
    rows = id_text(df, id_col, text_col).withColumns({"head": F.substring("text", 1, 16), "place": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "head", "place").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return materialise(dealt.mapInArrow(write, "file string, first_id long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, file, index.

    Files are read through Spark's own reader and parsed in tasks; only the narrow rows meet
    the manifest, which is one row a file and alone is summed up in file order.
    """
    schema = pa.schema([("file", pa.string()), ("index", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                f = TokenFile(content.as_buffer())
                at = f.bounds.all()
                crc = [zlib.crc32(f.ids[a:z].astype("<u4").tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                yield record_batch(schema, [[path.as_py().rpartition("/")[2]] * f.n_docs, range(f.n_docs), f.doc_ids(), at[:-1], np.diff(at), crc])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(out_dir).select("path", "content")
    docs = files.mapInArrow(parse, "file string, index long, doc_id long, local long, n_tokens long, ids_crc32 long")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    return docs.join(bases, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "index")


def token_files(df: DataFrame, tokenizer: str, end_id: int | None = 2, out_dir: str | None = None, **options) -> DataFrame:
    """Write the files, read them back, return one row per document."""
    spark = df.sparkSession
    out_dir = out_dir or shared_folder(spark, "token-files")
    manifest = write_token_files(df, out_dir, tokenizer, end_id, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, index long")
    return read_token_files(spark, out_dir, manifest)

"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Features of a text are its word unigrams and bigrams (lower-cased letter runs, digit runs,
punctuation runs and line ends), a pseudo-word wherever a word follows itself and one for the
length class, hashed into 2**bits buckets; a bucket seen c times among n grams weighs sqrt(c / n). A score is the logistic of a
sparse dot product. Training streams a bounded, documented sample of labelled rows through one
task (the model is a vector of fixed size); scoring reads every row and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, record_batch, text_batches

WORD = re.compile(r"[^\W\d_]+|\d+|[^\w \t\r\n]+|\n")


class Hasher:
    """Words to 64-bit hashes, remembered up to ``max_memo`` words per worker."""

    def __init__(self, max_memo: int = 400_000):
        self.memo: dict[str, int] = {}
        self.max_memo = max_memo

    def features(self, text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted buckets and their weights."""
        words = WORD.findall(text.lower())
        if len(self.memo) > self.max_memo:
            self.memo.clear()
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, 7)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        length = np.array([xxhash.xxh64_intdigest(f"length {len(words).bit_length()}", 7)], np.uint64)
        with np.errstate(over="ignore"):
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            twice = np.full(int((h[1:] == h[:-1]).sum()), xxhash.xxh64_intdigest("word again", 7), np.uint64)
            grams = np.concatenate([h, pairs ^ (pairs >> np.uint64(29)), twice, np.repeat(length, 1 + len(words) // 8)])
            grams = grams * np.uint64(0xBF58476D1CE4E5B9)
        bucket, count = np.unique((grams >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        return bucket, np.sqrt(count / len(grams))


@lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[i]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - step * w
        self.n[i] = n + g * g


def with_bias(features: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.append(features[0], 1 << bits), np.append(features[1], 1.0)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 12_000, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """float32 weights (bias last) from at most ``max_rows`` labelled ids outside the held-out
    fold, those with the smallest hash of the id; zero weights where there are none. Of rows
    that repeat an id one text is learnt (the least), so the bound holds for texts too; null
    ids and labels are left out, a null text is the empty text."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).dropna().where(fold("_id") != 1)
    # at most max_rows pairs of numbers: small enough to broadcast whatever the corpus size
    picked = F.broadcast(rows.distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows))
    data = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "_id")
    data = data.groupBy("_id", "y").agg(F.min("text").alias("text")).select("_id", "text", "y").orderBy(F.xxhash64("_id"), "_id", "y").coalesce(1)
    schema = pa.schema([("weights", pa.binary())])

    def fit(batches):
        model, rows = Ftrl(bits), []
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                i, x = with_bias(hasher().features(text, bits), bits)
                rows.append((i.astype(np.int32), x.astype(np.float32), y))
        order = np.random.default_rng(11)
        for _ in range(epochs if rows else 0):
            for k in order.permutation(len(rows)):
                i, x, y = rows[k]
                model.update(i, x.astype(np.float64), y)
        weights = model.weights(np.arange(len(model.z))).astype("<f4").tobytes()
        yield record_batch(schema, [[zlib.compress(weights)]])

    found = data.mapInArrow(fit, "weights binary").collect()
    return zlib.decompress(found[0]["weights"]) if found else np.zeros((1 << bits) + 1, "<f4").tobytes()


def score(docs: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted. A null or empty text is scored by the
    bias and its length class; null and repeated ids keep their own row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)
    bits = (len(weights) // 4 - 1).bit_length() - 1
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        w = np.frombuffer(model.value, "<f4").astype(np.float64)
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                i, x = hasher().features(text, bits)
                scores.append(sigmoid(float(w[i] @ x + w[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train outside the held-out fold, score every row: doc_id, held_out, score, predicted.

    Every row gets a score, also null and empty texts, null ids (not held out) and rows that
    repeat an id; whole texts count, however long. Without documents there are no rows; without
    labels every score is 0.5. Other columns, whatever their names, are ignored.
    """
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")

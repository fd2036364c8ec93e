"""Stand-ins: the test tables as the relations that the operators read, in Spark and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import patterns as P
from ..operators.keywords import tokens

#: Bands for random 64-dimensional vectors, whose neighbours are far.
BANDS = Settings(embed_dims=64, similarity_threshold=0.40, soft_threshold=0.36, bridge_floor=0.33, show_nearest_from=0.35)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def queries(df: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return df.where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with vectors, as chunks; the source is the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    e = vectors(spark, sf_dir)
    return d.join(e, d["doc_id"] == e["id"]).select(
        "id", F.col("source").alias("doc_id"), F.col("source").alias("doc_title"), F.lit(1).alias("page_from"), F.lit(1).alias("page_to"),
        F.lit(None).cast("string").alias("clause"), F.col("id").cast("int").alias("chunk_index"), F.col("text").alias("content"), "embedding",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a document of one chunk; ready if labelled good and not toxic."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ready = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ready").otherwise("pending")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("doc_title"), F.concat("source", F.lit(".pdf")).alias("source_file"),
        F.ceil(F.col("n_chars") / 1000).cast("int").alias("page_count"), F.ceil(F.col("n_chars") / 1200).cast("int").alias("chunk_count"),
        (F.col("n_chars") < 80).alias("is_scanned"), ready.alias("status"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a source as the pages of documents, some twenty each at any scale."""
    doc = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 400).cast("string"))
    return table(spark, sf_dir, "documents").select(doc.alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def term_queries(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """query_id, terms: the first n words of every hundredth text."""
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, n).alias("terms"))


def re2(pattern: str) -> str:
    """A fixed pattern as DuckDB's engine reads it, for SQL: its word boundary, its escapes."""
    border = f"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    for was in (border, border[3:-1], P.W0, P.W1):
        pattern = pattern.replace(was, r"\b")
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace("'", "''")


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: Words and compounds of ``text``, and what they are made of, as ``operators.keywords`` has them.
TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}]+(?:[-./@_][\p{L}\p{N}\p{M}]+)*')"
UNITS = r"list_transform(regexp_extract_all(regexp_replace({} || '.', '[-/@_]', '. ', 'g'), '(?:\p{{Nd}}+\.)+|[^. ]+\.'), lambda u: left(u, length(u) - 1))"


def posted_sql(source: str) -> str:
    """Common tables that end in p (id, term, pos) of ``source`` (id, toks)."""
    return f"""w0 AS (SELECT id, unnest(range(1, len(toks) + 1)) AS nth, unnest(toks) AS w FROM {source}),
w1 AS (SELECT id, nth, w, string_split_regex(w, '[/@]') AS pieces FROM w0),
w2 AS (SELECT id, nth, w, len(pieces) AS m, unnest(range(1, len(pieces) + 1)) AS s, unnest(pieces) AS piece FROM w1),
w3 AS (SELECT *, {UNITS.format('piece')} AS units FROM w2),
w4 AS (SELECT id, nth, w, m, s, piece, len(units) AS n, unnest(range(1, len(units) + 1)) AS u, unnest(units) AS unit FROM w3),
w5 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth, s, u) AS pos, count(*) OVER (PARTITION BY id, nth) AS total FROM w4),
p AS (SELECT id, unit AS term, pos FROM w5 UNION ALL SELECT id, piece, pos FROM w5 WHERE u = 1 AND n > 1 AND m > 1 UNION ALL SELECT id, w, pos FROM w5 WHERE s = 1 AND u = 1 AND total > 1)"""


SQL_DOCUMENTS = """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.source AS doc_title, d.source || '.pdf' AS source_file,
 CAST(ceil(n_chars / 1000.0) AS INTEGER) AS page_count, CAST(ceil(n_chars / 1200.0) AS INTEGER) AS chunk_count, n_chars < 80 AS is_scanned,
 CASE WHEN quality = 1 AND toxic = 0 THEN 'ready' ELSE 'pending' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
SQL_QUERIES = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0"


def top_sql(source: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH q AS ({SQL_QUERIES}), s AS (SELECT query_id, c.vec_id AS id, list_cosine_similarity(q.e, c.embedding::DOUBLE[]) AS sim FROM q, {source} c),
r AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE {where})
SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= {k}"""

"""Mixing sources to target weights, with DataFrame functions only.

Words are summed by source, targets follow from weights, and a source's rate is its target over
its words. A document is taken floor(rate) times, and once more by a Bernoulli draw whose
probability is the rate's fraction. The draw comes from the document's hash and a seed; of
``SEEDS`` seeds a source takes the one whose words come nearest to its target, so long documents
and small sources miss it by little. Equal rows draw alike, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, split_join

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEEDS = 32
SPAN = 1 << 32


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: Column) -> DataFrame:
    """doc_id, key (the source, never null), source, size in words, two draws a and b of 32 bits,
    and ``more``."""
    doc_id, source, text = F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), text))
    draw = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return df.select(doc_id.alias("doc_id"), source_key(source).alias("key"), source.alias("source"), size.alias("size"), draw(1).alias("a"), draw(9).alias("b"), *more)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nth``, their place from 0 by code point, null last: each range of a
    sampled split counts its own, and the ranges' totals are added up."""
    parts = max(1, sources.sparkSession.sparkContext.defaultParallelism)
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return ranged.withColumn("own", own).join(offsets, "part").withColumn("nth", F.col("offset") + F.col("own")).drop("part", "own", "offset")


def targets(sources: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, words) with ``target``: ``share`` of all words dealt by weight, of
    which no source gets over ``most`` times its own; the excess is dealt again among the others
    until none is above. Only sums of each round reach the driver."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = materialise(numbered(sources).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("words") * most), "weighed")
    level, below = 0.0, -1
    total = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    while True:
        capped = (F.col("cap") <= F.lit(level) * F.col("weight")) if below >= 0 else F.lit(False)
        n, caps, left = rows.agg(F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == below or not left:
            break
        level, below = (share * total - caps) / left, n
    reach = F.lit(level) * F.col("weight")
    return rows.withColumn("target", F.when((F.col("cap") <= reach) | F.lit(not left), F.col("cap").cast("double")).otherwise(reach))


def source_rates(rows: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, words, n, target, rate and seed of every source of ``rows`` (from ``measured``)."""
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    aims = targets(sources, share, most, weights)
    rate = F.when(F.col("words") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("words"))).otherwise(0.0)
    aims = materialise(aims.select("key", "words", "n", "target", rate.alias("rate")), "rates")
    rated = split_join(rows, aims.drop("n"), "key", aims, rows_of(aims))
    sums = rated.groupBy("key", "target").agg(*[F.sum(F.col("size") * copies(F.lit(k))).alias(f"k{k}") for k in range(SEEDS)])
    missed = F.array_min(F.array(*[F.struct(F.abs(F.col(f"k{k}") - F.col("target")).alias("by"), F.lit(k).cast("long").alias("seed")) for k in range(SEEDS)]))
    return materialise(aims.join(sums.select("key", missed["seed"].alias("seed")), "key"), "seeds")


def rows_of(rates: DataFrame) -> int:
    return rates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copies(seed: Column) -> Column:
    """floor(rate), and one more where the draw under ``seed`` falls below the fraction."""
    drawn = (F.col("a") + seed * F.col("b")) % SPAN
    whole = F.floor("rate")
    return whole + F.when(drawn < (F.col("rate") - whole) * float(SPAN), 1).otherwise(0)


def planned(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` with their source's figures and ``copies``; a source of many rows is dealt in parts."""
    return split_join(rows, rates.drop("n"), "key", rates, rows_of(rates)).withColumn("copies", copies(F.col("seed")))


def mixing_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts words (null or empty text: 0), source_size and target are the source's, rate is
    at most ``most``, and taken is copies times size. A null source is a source of its own, last
    in order. A null id draws by text and source; rows equal in id, source and text draw alike.
    A source without words has target and rate 0. An empty table gives no rows, and other
    columns are ignored. ``settings`` are those of ``targets``.
    """
    rows = materialise(measured(df, id_col, text_col, source_col), "sizes")  # texts are read once
    dealt = planned(rows, source_rates(rows, **settings))
    return dealt.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mixed corpus: the rows of ``df``, each as often as ``mixing_plan`` says (a text without
    words too), with ``copy`` from 1. The columns of ``df`` stay as they are; it may not have a
    column ``copy`` of its own."""
    if "copy" in df.columns:
        raise ValueError("the documents already have a column 'copy'")
    rates = source_rates(materialise(measured(df, id_col, text_col, source_col), "sizes"), **settings)
    dealt = planned(measured(df, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), rates)
    return dealt.where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


#: The draws are md5 digits, so that SQL can make them too. A source is capped if its cap does not
#: exceed the level of those less generously capped (by cap for a unit of weight).
OP11_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(source, '') || ' ' || coalesce(text, '')) AS digest
  FROM documents),
drawn AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS b FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM drawn GROUP BY source),
weighed AS (
  SELECT *, 2 * words AS cap, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
filled AS (
  SELECT *, cap / weight AS reach, row_number() OVER w AS place,
         (1.5::DOUBLE * (SELECT sum(words) FROM weighed) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, nth)),
levelled AS (
  SELECT *, (SELECT level FROM filled WHERE cap > level * weight ORDER BY place LIMIT 1) AS final FROM filled),
aims AS (
  SELECT source, words, CASE WHEN final IS NULL OR cap <= final * weight THEN CAST(cap AS DOUBLE) ELSE final * weight END AS target FROM levelled),
rates AS (
  SELECT *, CASE WHEN words > 0 THEN least(2.0::DOUBLE, target / words) ELSE 0.0::DOUBLE END AS rate FROM aims),
tried AS (
  SELECT d.source, k, sum(size * (floor(rate)::BIGINT + CASE WHEN (a + k * b) % 4294967296 < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END)) AS got
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(32) t(k) GROUP BY d.source, k),
seeds AS (
  SELECT r.source, words, target, rate, arg_min(k, (abs(got - target), k)) AS seed
  FROM tried t JOIN rates r ON t.source IS NOT DISTINCT FROM r.source GROUP BY ALL)
SELECT doc_id, size, words AS source_size, target,
       CAST(size * (floor(rate)::BIGINT + CASE WHEN (a + seed * b) % 4294967296 < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source
"""

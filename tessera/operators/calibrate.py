"""Threshold calibration from labelled probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def distributions(scores: DataFrame) -> DataFrame:
    """label, n, low, high, median of score; the median is the upper one, an observed value:
    sorted[floor(n / 2)], exactly.

    Equal scores are counted together before they are moved; the counts are sorted by ranges,
    and only the range that the median lies in is looked at row by row.
    """
    counts = scores.where("score IS NOT NULL").groupBy("label", "score").agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange("label", "score").withColumn("part", F.spark_partition_id()), "score-counts")
    sums = ranged.groupBy("label", "part").agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    label = Window.partitionBy("label")
    before = lambda order: F.coalesce(F.sum("n").over(label.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before("part")).withColumn("middle", F.floor(F.sum("n").over(label) / 2))
    total = sums.groupBy("label").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    inside = (F.col("before") <= F.col("middle")) & (F.col("middle") < F.col("before") + F.col("n"))
    target = sums.where(inside).select(F.col("label").alias("_label"), F.col("part").alias("_part"), (F.col("middle") - F.col("before")).alias("at"))
    near = ranged.join(target, F.col("label").eqNullSafe(F.col("_label")) & (F.col("part") == F.col("_part"))).select("label", "score", "n", "at")
    near = near.withColumn("before", before("score")).where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    median = near.select(F.col("label").alias("_label"), F.col("score").alias("median"))
    return total.join(median, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def verdict(scores: DataFrame) -> DataFrame:
    """One row: max_out, min_in, overlapping (outs at or above the least in), suggestion (the
    middle of the gap, null where the distributions overlap)."""
    ends = scores.agg(F.max(F.when(F.col("label") == "out", F.col("score"))).alias("max_out"), F.min(F.when(F.col("label") == "in", F.col("score"))).alias("min_in"))
    joined = scores.crossJoin(ends)  # one row
    counted = joined.groupBy("max_out", "min_in").agg(F.count_if((F.col("label") == "out") & (F.col("score") >= F.col("min_in"))).alias("overlapping"))
    return counted.withColumn("suggestion", F.when(F.col("overlapping") == 0, (F.col("max_out") + F.col("min_in")) / 2))


def probe_scores(scores: DataFrame) -> DataFrame:
    """query_id, relevant and irrelevant average, least and greatest score."""
    part = lambda flag, name: [f(F.when(F.col("relevant") == flag, F.col("score"))).alias(f"{name}_{k}") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return scores.groupBy("query_id").agg(*part(True, "relevant"), *part(False, "irrelevant"))

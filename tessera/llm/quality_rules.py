"""Quality rules with thresholds learnt from the corpus itself.

Tasks measure each text once. Per (language, source) a KLL quantile sketch of each measure is
built by Spark; sketches merge, so a hot source is pre-aggregated map-side, and those of a
language and of everything come from the same ones. Documents of equal measures count once in
a sketch, so that no group of copies can narrow a fence. Fences are read from the sketches
alone: upper = q(tail) + spread * (q(tail) - q(0.5)), and lower likewise where too little is
bad too. Quantiles of a group of n documents are drawn towards those of its language by
prior / (n + prior), the language's likewise towards all; there is no size at which another
rule holds. A group's fence is as wide as its language's at least. The fences meet the
documents by an ordinary join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, record_batch, text_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Fence:
    """Limit of one measure. ``tail``: the quantile that a fence starts from, ``spread``: how many
    times its distance from the median the fence lies beyond; ``lower``: too little is bad too."""

    name: str
    value: str
    tail: float
    spread: float
    lower: bool = False


#: Shares are smoothed, (count + 1) / (of + 2), so that short texts vary as they should.
FENCES = (
    Fence("symbol_share", "(n_symbols + 1) / (word_chars + 2)", 0.75, 12.0),
    Fence("dup_line_share", "(n_dup_lines + 1) / (n_lines + 2)", 0.98, 1.0),
    Fence("repeat_share", "(n_repeat_words + 1) / (n_words + 2)", 0.98, 1.0),
    Fence("word_length", "word_chars / greatest(n_words, 1)", 0.75, 6.0, lower=True),
)


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    words = text.encode().split()  # bytes split on ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        triple = pair[:-1] * len(number) + ids[2:]
        ordered = np.sort(triple)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.isin(triple, twice)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= at
            repeated = int(covered.sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: bool) -> DataFrame:
    """The measures of every row; with ``carry`` the row itself, as the struct ``own``."""
    text_batches(df.sparkSession)
    own = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")] if carry else [F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    src = df.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    names = ["n_words", *MEASURES, "n_lines"]
    kept = src.drop("_text").schema

    def run(batches):
        for batch in batches:
            rows = list(zip(*map(measure, batch.column(batch.num_columns - 1).to_pylist()))) or [[]] * len(names)
            arrays = [pa.array(r, pa.int64()) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *names])

    for n in names:
        kept = kept.add(n, "long")
    out = src.mapInArrow(run, kept)
    if carry:
        out = out.withColumns({"lang": F.col(f"own.`{lang_col}`"), "source": F.col(f"own.`{source_col}`")})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumns({f.name: F.expr(f.value).cast("double") for f in FENCES})


def sketched(rows: DataFrame, sketch_k: int) -> DataFrame:
    """lang, source, n and a sketch of each measure, over the rows that pass the base rules;
    rows of equal measures count once."""
    once = rows.where("not base_failed").select("lang", "source", *[f.name for f in FENCES]).distinct()
    return once.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(f.name, F.lit(sketch_k)).alias(f.name) for f in FENCES])


def fences(sketches: DataFrame, prior: float) -> DataFrame:
    """(g_lang, g_source) -> low and high limit of each measure, from the sketches."""
    merged = [F.kll_merge_agg_double(f.name).alias(f.name) for f in FENCES]
    size = F.sum("n").alias("n")

    def quantiles(df: DataFrame, level: str) -> DataFrame:
        points: list[Column] = []
        for f in FENCES:
            for place, q in (("mid", 0.5), ("top", f.tail), ("low", 1 - f.tail)):
                points.append(F.kll_sketch_get_quantile_double(f.name, F.lit(q)).alias(f"{level}_{f.name}_{place}"))
        keys = [F.col(k).alias(f"{level}_{k}") for k in ("lang", "source") if k in df.columns]
        return df.where("n > 0").select(*keys, F.col("n").alias(f"{level}_n"), *points)

    own, lang, every = quantiles(sketches, "g"), quantiles(sketches.groupBy("lang").agg(size, *merged), "l"), quantiles(sketches.agg(size, *merged), "o")
    joined = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).crossJoin(every)  # one row

    def drawn(level: str, measure: str, place: str) -> Column:
        if level == "o":
            return F.col(f"o_{measure}_{place}")
        n = F.col(f"{level}_n")
        return (n * F.col(f"{level}_{measure}_{place}") + prior * drawn({"g": "l", "l": "o"}[level], measure, place)) / (n + prior)

    limits: list[Column] = []
    for f in FENCES:
        wide = lambda level, a, b: drawn(level, f.name, a) - drawn(level, f.name, b)  # noqa: B023, E731
        slip = 1e-9 * F.abs(drawn("g", f.name, "mid"))  # for rounding alone
        up = F.greatest(wide("g", "top", "mid"), wide("l", "top", "mid"))
        down = F.greatest(wide("g", "mid", "low"), wide("l", "mid", "low"))
        limits.append((drawn("g", f.name, "top") + f.spread * up + slip).alias(f"{f.name}_high"))
        limits.append((drawn("g", f.name, "low") - f.spread * down - slip if f.lower else F.lit(0.0)).alias(f"{f.name}_low"))
    return joined.select("g_lang", "g_source", *limits)


def judged(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, carry: bool, prior: float, sketch_k: int) -> DataFrame:
    rows = materialise(measured(df, id_col, text_col, lang_col, source_col, carry), "measures")
    # written first: a table of known, small size is joined without moving the documents
    limits = materialise(fences(materialise(sketched(rows, sketch_k), "sketches"), prior), "fences")
    met = rows.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for f in FENCES:
        inside = inside & F.coalesce(F.col(f.name).between(F.col(f"{f.name}_low"), F.col(f"{f.name}_high")), F.lit(True))
    return met.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = 100.0, sketch_k: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_words, the four measures, base_failed, kept.

    A null or empty text has no words and fails the base rules. A null language or source is a
    group like any other; rows that repeat an id, or have none, keep their own row; an empty
    table gives no rows; other columns are ignored. Whole texts are measured, however long.
    Sketches of more than ``sketch_k`` values are randomised, so a fence can move by its rank
    error between runs, and documents next to it can be judged otherwise.
    """
    return judged(df, id_col, text_col, lang_col, source_col, False, prior, sketch_k).select("doc_id", "n_words", *MEASURES, "base_failed", "kept")


def keep_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = 100.0, sketch_k: int = 1024) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns as they were, by the verdict of
    ``quality_rules``: null and empty texts go, rows that repeat an id are judged one by one
    (all stay or all go where their texts are equal), an empty table gives no rows."""
    return judged(df, id_col, text_col, lang_col, source_col, True, prior, sketch_k).where("kept").select("own.*")

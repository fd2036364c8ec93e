"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, hard_negatives, lexicon, mixing, packing, pii, quality_model, quality_rules, simhash, substring_dedup, tiered_search, token_store
from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_store.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1).drop("ids")


def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.messages_as_events(rows.unionByName(chat.control_conversation(spark)))
    return chat.chat_digests(chat.format_chats(log))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=pii.session_key(spark, pii.TEST_KEY))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tiered_search.build_index(table(spark, sf_dir, "documents"))
    return tiered_search.search(index, table(spark, sf_dir, "benchmark"), k=50).drop("tiers")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, relabel=relabel)


QUERIES = {
    f.__name__: f
    for f in (op1_token_files, op2_packing, op3_bpe_lexicon, op4_quality_model, op5_chat, op6_exact_dedup, op7_substring_dedup, op8_quality_rules, op9_simhash, op10_pii, op11_mixing, op12_tiered_search, op13_hard_negatives)
}
ORACLE_SQL: dict[str, str] = {"op5_chat": chat.OP5_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL, "op7_substring_dedup": substring_dedup.OP7_SQL, "op11_mixing": mixing.OP11_SQL, "op12_tiered_search": tiered_search.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}

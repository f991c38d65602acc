"""Queries opN_<name> over the text tables, one for each operator, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.llm import byte_bpe, html_extract, interpolated_lm, language_id, mixing, near_dedup, periodic_runs, prefix_forest, prefix_trie, quality, quality_rules, sharding, simhash
from canopyflow.llm.folds import fold
from canopyflow.session import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.97, max_repeats=4.0, carry=False)


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = interpolated_lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    return language_id.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.cascade(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *quality_rules.MEASURES, base_failed.alias("base_failed"), "kept")


def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.trained())


def op8_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where((fold("doc_id", 5) != 0) & (F.col("quality") == 1))
    model = quality.train(docs.where(fold("doc_id", 5) != 0), labels)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    codec = byte_bpe.train_free_codec(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return codec.digests(docs)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, most_bits=2)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.looped(table(spark, sf_dir, "documents"))))


_QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_temperature_mix, op3_interpolated_lm, op4_prefix_forest, op5_language_id, op6_rule_cascade, op7_html_crf, op8_hash_ring, op9_quality_pu, op10_byte_bpe, op11_simhash, op12_prefix_trie, op13_periodic_runs)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op6_rule_cascade": quality_rules.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}

"""A corpus pipeline over `documents`: language, quality, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last
return the columns of documents. run() writes each stage below the session's shared folder and rereads it.

Rejected: texts without a letter or whose language is less likely than not; texts that the quality
classifier holds for low quality; all but the least doc_id of each near-duplicate group (five-word shingles,
similarity 0.8). Mixing repeats documents of small sources (up to four times) and drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.llm import byte_bpe, language_id, mixing, near_dedup, quality
from canopyflow.session import materialise, release_shuffles, shared_dir, ship, table

#: Least posterior of the predicted language; least quality score.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.3
#: Ids up to which a list of removed documents is broadcast; a longer one is joined by a shuffle.
SMALL_IDS = 1_000_000


#: Rows of an Arrow batch: whole rows and their texts pass through Python, so the default of 10,000 holds many megabytes a task.
BATCH_ROWS = 2_000


def _prepared(spark: SparkSession) -> None:
    """The library is on the executors, Arrow batches are small, and the driver has let go of the plans, models and broadcasts
    of the stages before; of plans that it has run it keeps descriptions of bounded length."""
    ship(spark)
    release_shuffles(spark)
    spark.conf.set("spark.sql.maxPlanStringLength", str(byte_bpe.PLAN_CHARS))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language: not `und`, and posterior at least LEAST_LANGUAGE."""
    _prepared(spark)
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    judged = language_id.score(numbered, language_id.train(docs), keep=("row",))
    return judged.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a quality score of at least LEAST_QUALITY."""
    _prepared(spark)
    positives = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    model = quality.train(docs, positives)
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return quality.score(numbered, model, threshold=LEAST_QUALITY, keep=("row",)).where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least doc_id, of each near-duplicate group; of a repeated doc_id one row of each different text."""
    _prepared(spark)
    own = docs.columns
    found = near_dedup.near_duplicates(docs, k=5, percent=80)
    found = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or("kept").alias("kept")), f"{shared_dir(spark)}/kept")
    removed, repeated = found.where("not kept").select("doc_id"), found.where("kept and rows > 1").select("doc_id")
    out = docs.join(F.broadcast(removed) if removed.count() <= SMALL_IDS else removed, "doc_id", "left_anti")
    if not repeated.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in own])
        twice = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("__row")).select("__row.*")
        out = out.join(repeated, "doc_id", "left_anti").unionByName(twice)
    return out.select(*[F.col(f"`{c}`") for c in own])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the temperature mix uses it; the budget is the least that drops none."""
    _prepared(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    return mixing.mix(rows, entropy_share=0.97, max_repeats=4.0).select("row.*")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, n_tokens, ids_sha256, decoded_sha256."""
    _prepared(spark)
    import public_tokenizers

    codec = byte_bpe.train_free_codec(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return codec.digests(docs, keep=("doc_id", "source"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL cannot express the stages: they are fitted models and searches. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"{path}/{k}_{name}")
    return docs

"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_model, line_quality, ngram_join, packing, passages, pieces, quality, sharding, toxicity
from .common import fold, read


def _scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select("doc_id", (fold(5, F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


#: Small, so that tables of a few megabytes split too; at full scale one would take 256 MB or more.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and compares the decoded text with the text."""
    back = pieces.decode(pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return back.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "log_score",
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_words", "n_links", "n_dup_words")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), 4, 85, 100)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.score_all(docs, fold(10, F.col("doc_id")) != 0)
    return out.select("doc_id", (fold(10, F.col("doc_id")) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, model, ["doc_id"]), toxicity.THRESHOLD)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model, ["doc_id"]), quality.THRESHOLD)


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_lm_scoring, op3_quality_rules, op4_sentencepiece, op5_substring_dedup, op6_ngram_jaccard, op7_fingerprints, op8_packing, op9_toxicity, op10_quality_classifier)
}
ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(SHARD_BYTES), "op3_quality_rules": line_quality.oracle()}

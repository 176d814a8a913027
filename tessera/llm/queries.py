"""Queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, contexttree, divergence, language, mixing, negatives, pieces, pii, quality, secrets, simhash, spans, toxicity, zipwarc
from tessera.llm.common import documents, remainder


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *spans.digests(F.col("pii"), pii.KINDS))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels).select("doc_id", "quality_verdict.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = toxicity.detect(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    predicted = F.when(F.col("toxicity.score") >= toxicity.TOXIC_AT, 1).otherwise(0)
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity.score").alias("score"), predicted.alias("predicted"), F.col("toxicity.sentence").alias("sentence"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = zipwarc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    size, digest = F.coalesce(F.length("payload").cast("long"), "declared_bytes"), F.coalesce(F.sha2("payload", 256), "declared_digest")
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.summarised(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs)
    return found.select("doc_id", *spans.digests(F.col("secrets"), secrets.KINDS))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = pieces.encode(docs, piece_model())
    return coded.select("doc_id", *pieces.digests(F.col("pieces")), F.col("pieces.n_differ").alias("n_differ"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return contexttree.score(docs, ~held).select("doc_id", held.alias("held_out"), "lm.*")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_language, op2_mixing, op3_pii, op4_quality, op5_toxicity, op6_warc, op7_audio, op8_secrets, op9_sentencepiece, op10_simhash, op11_divergence, op12_context_tree, op13_negatives)}
ORACLE: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op6_warc": zipwarc.ORACLE, "op11_divergence": divergence.ORACLE, "op13_negatives": negatives.ORACLE}

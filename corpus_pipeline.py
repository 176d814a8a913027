"""The corpus pipeline: quality rules, near-duplicate removal, redaction, mixing, and encoding of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A
stage works on every row that the one before it kept, and its decisions take effect: rejected documents go, one
document of each group of near copies stays, personal data is replaced in the texts, documents repeat or go as the
mix takes them, and the last stage adds each text's ids, decoded text and counts.

A null text has no words, so the quality rules reject it. Rows without a doc_id, or that share one, are told apart by their
texts; of rows equal throughout, one is left by near-dedup. Null sources are a source. Empty tables pass through all stages.
Columns that docs has are kept under their names and never replaced, but text and n_chars where personal data goes; the last
stage's own columns (ids, decoded, n_tokens, ids_sha256, decoded_sha256) get underscores in front where docs has such a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, pii, quality, queries, simhash
from tessera.llm.common import documents, fresh, new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the quality model keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (verdict,) = fresh(docs, "verdict")
    return quality.judge(docs, labels, into=verdict).filter(F.col(verdict)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id, whatever ids the rows share or lack."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars brought up to date."""
    (spans,) = fresh(docs, "spans")
    found = pii.find(docs, into=spans)
    text = pii.redacted(F.col("text"), F.col(spans))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.copies(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, decoded text, and digests; a name that docs has already gets underscores in front."""
    coded_as, *names = fresh(docs, "pieces", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = pieces.encode(docs, queries.piece_model(), into=coded_as)
    found = F.col(coded_as)
    added = [found["ids"], found["decoded"], *pieces.digests(found)]
    return coded.select(*docs.columns, *(c.alias(n) for c, n in zip(added, names, strict=True)))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing sources to target weights", target_weights),
    ("sentencepiece encoding and decoding", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's rows are written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: The first stage is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None

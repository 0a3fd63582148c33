"""From raw documents to packed training sequences, each stage over all that the one before kept.

Defined results: null and empty texts score as an empty passage and stay or go by that score, keep their (no) lines, are
linked with nothing, hold no item and are packed as the closing token alone; rows with a null doc_id pass the same tests
and are no one's copy in near_dedup; repeated rows are one document: they stay or go together; of equal lines and of near
copies the smallest doc_id's stays; an empty documents table gives no rows at every stage, one without labels rejects
nothing (every score is 0.5); other columns are carried along up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import decontaminate, line_dedup, near_dedup, packing, quality_classifier
from kelpie.llm.common import WORD_GAP, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labels, rejects go."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, and documents of which they leave no word."""
    out = line_dedup.dedup_lines(docs)
    left = F.regexp_replace(F.coalesce("text", F.lit("")), WORD_GAP, "")
    out = out.where((F.col("n_removed") == 0) | (left != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return near_dedup.near_dedup(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("of_doc")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["of_doc"]), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", leak_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the classifier nor sketches nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

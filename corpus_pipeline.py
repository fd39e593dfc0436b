"""Corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a
DataFrame; run() writes each stage's rows to the shared folder as Parquet and rereads them as the next
one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import langid, packing, quality, recompress, simhash
from tallyvane.llm.common import materialise, remove, table, unpacked

#: A document with a lower share of the votes for its likeliest language goes; mixed texts have about a half.
LEAST_LANGUAGE_SCORE = 0.4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.scored(docs, model, docs.columns).filter("predicted = 1"), docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not `und`, and not below LEAST_LANGUAGE_SCORE."""
    found = langid.predicted(docs, langid.fit(docs), docs.columns)
    return unpacked(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier, n_chars with them; texts without any are left as they are."""
    return recompress.without_repeats(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: The learned stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{k}", done)
        remove(spark, done[:-1])  # the last stage's rows are all that is read from here on
        done = done[-1:]
    return docs

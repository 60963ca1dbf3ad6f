"""The corpus pipeline: quality, near duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import containment, jaccard, packing, pii, quality
from causeway.llm.frames import read, written
from causeway.llm.queries import tokenizer_path

#: Documents under this score are rejected.
LEAST_QUALITY = 0.3
#: Near duplicates: five words, a similarity of 0.8.
WORDS, NUM, DEN = 5, 80, 100
WINDOW, END_ID = 2048, 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labelled documents, doesn't reject.

    Defined results: a null text is judged as the empty one; rows without an id are judged but never learnt from; repeated
    rows are all kept or all go; long texts are judged whole; without labels of both classes every score is the class's
    share, 0.5 without any, so nothing goes unless all labels say so; no rows give none.
    """
    model = quality.fit(quality.training_rows(docs, read(spark, sf_dir, "labels"), None, "doc_id", "text", "quality"))
    return quality.score(docs, model, name="cw_score").where(F.col("cw_score") >= LEAST_QUALITY).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id.

    Defined results: documents without an id, and null and empty texts, stay; rows that repeat an id stay or go together;
    long texts are compared whole; no rows give none; columns of any name are kept.
    """
    found = jaccard.components(docs.select("doc_id", "text"), n=WORDS, num=NUM, den=DEN)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate.

    Defined results: null and empty texts stay; repeated rows stay or go together; long texts are scanned whole; with no
    items, or only null or empty ones, all stay; no rows give none.
    """
    out = containment.contamination(docs, read(spark, sf_dir, "benchmark"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text.

    Defined results: a null text stays null and keeps its n_chars; empty texts and texts without spans stay as they are;
    repeated rows become equal rows; long texts are searched whole; no rows give none; columns of any name are kept.
    """
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 2048: one row per piece.

    Defined results: null and empty texts are their end id alone; repeated rows are packed each; long texts fill whole
    sequences first; rows without an id are packed under a null id; no rows give no pieces.
    """
    return packing.pack(docs, tokenizer_path(), end_id=END_ID, window=WINDOW)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The classifier, the trees and the tokenizer can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: documents through five stages, each written as Parquet and reread by the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents. ``run`` applies them to a whole table.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further
columns of any name (which it keeps, but for the last): null texts count as empty ones and are never dropped, equal texts are
judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, pii, sentencepieces, toxicity
from ledgerloom.llm.queries import tokenizer
from ledgerloom.llm.shared import free_name, new_folder, table

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below TOXIC. It learns from confirmed and unlabelled rows of ``documents``; without confirmed ones nothing is dropped."""
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    into = free_name(docs, "__score")
    return toxicity.scored(docs, model, into=into).where(F.col(into) < TOXIC).drop(into)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null ids last); rows without words all stay."""
    table(spark, sf_dir, "documents")
    return jaccard.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items, as they are; an empty benchmark drops none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars is the new length, null for a null text."""
    table(spark, sf_dir, "documents")
    return pii.redacted(docs, n_chars="n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, round_trip and ids of every document."""
    table(spark, sf_dir, "documents")
    return sentencepieces.round_trips(docs, tokenizer(spark, "piece_bpe_32k.model"), give_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Learned models and BPE can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = new_folder(spark, "stage")
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs

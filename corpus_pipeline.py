"""Corpus pipeline: quality rules, near-dedup, personal data, source mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet before the next reads
it. All but the last return the columns of documents; the last returns doc_id, and the ids of each text and the text decoded from
them. Null, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, mixing, pii, quality, simhash
from tagloom.llm.common import discard_new, helpers, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned cutoffs reject, null and empty texts among them; repeated rows stay.

    An empty table stays empty; extra columns come through.
    """
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies; of rows that share it, that of the least text.

    A row without a doc_id stays if its group has no other; an empty table stays empty; extra columns come through.
    """
    return simhash.drop_near(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data to its kind and removes the terms that reveal it; n_chars follows the text, null with a null one.

    Every row stays, repeated ones too; an empty table stays empty; extra columns come through.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, in a global order by hash; a null source is one like any other.

    Rows of one doc_id are drawn alike; an empty table stays empty; extra columns come through.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and the text that they decode to; null and empty texts have none and an empty text."""
    return bpe.decode(bpe.encode(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Components and merges of byte pairs can't be written as one SQL query; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage left in the shared folder goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), helpers()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
            discard_new(before, docs)
    return docs

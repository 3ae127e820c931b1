"""Corpus pipeline over `documents`: reject toxic documents, drop exact and near duplicates, pack the rest.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved
from lodestone.llm.crf import labelled_rows, toxicity
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.minhash import near_classes
from lodestone.llm.packing import pack_documents

REJECT_FROM = 0.7


def some_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows that keep(docs, id column, text column) leaves, with docs' own columns: the operators' results
    get no name that docs may use."""
    safe = [f"_c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, safe))
    return keep(docs.toDF(*safe), at["doc_id"], at["text"]).select(*safe).toDF(*docs.columns)


def reject_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT_FROM. It learns from the labelled rows of docs."""
    labelled = labelled_rows(spark, sf_dir, docs)
    return some_rows(docs, lambda d, i, t: toxicity(d, labelled, i, t, with_spans=False).where(F.col("score") < REJECT_FROM))


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return some_rows(docs, lambda d, i, t: exact_dedup(d, i, t).where("kept"))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the smallest doc_id."""
    return some_rows(docs, lambda d, i, t: near_classes(d, i, t).where("kept"))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and offset."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Scores, samples and packing are not expressible in SQL; tests/llm/test_near_pipeline.py checks the rows by brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what passes between stages is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs

"""The corpus pipeline: five stages from raw documents to packed token ids.

Every stage reads what its predecessor kept, as Parquet, and all but the last return the columns of ``documents``.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name;
each says below what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontaminate import decontaminated
from textloom.llm.mixing import mixed
from textloom.llm.near_dedup import one_of_each
from textloom.llm.quality import keep_good, train
from textloom.llm.token_output import encode_documents
from textloom.shared import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the pairwise ranking doesn't reject. Null and empty texts get the score of no text; repeated
    rows go together; without labels of both kinds nothing is rejected."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Texts without words
    are one group; of repeated rows one stays; rows with a null id are set against each other alone."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that share no passage with the benchmark. Rows are judged by their texts, whatever their ids; null
    and empty texts stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet tempered shares of source, language and topic. Null is a source or language of
    its own; texts without tokens stay; repeated rows go together."""
    return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token ids into Simple-8b files and gives each document's place in them. A null or empty text has the end id
    alone; repeated rows have an entry each; null ids come first."""
    return encode_documents(docs, cache=CACHE)


#: Bytes of words that a Python worker keeps: fewer than op8 on its own, as idle workers hold them in the stages of the next run too.
CACHE = 32 << 20

STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-id output", token_stage),
]

#: Learned scores, fingerprint components and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage_{i}")
    return docs

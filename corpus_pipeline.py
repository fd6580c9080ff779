"""The corpus pipeline: quality, exact and near deduplication, mixing, and tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows
its predecessor kept, and returns a DataFrame.  All but the last return the columns of
documents.  `run` applies them to the documents, each stage written as Parquet and reread.

Defined results
* Null text counts as empty, and a document without words is taken by no mix.  Rows that
  repeat id and text are one document; a null id comes after all others of its class.
* Without labels of both kinds every document passes the first stage.  Ties in the near-copies
  and the exact copies go to the smallest id.
* An empty table gives an empty result; extra columns are kept until the last stage, whatever
  their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trenchline.llm import bpe, exact_dedup, mixing, near_dup, quality
from trenchline.llm.tables import stored, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id."""
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    return bpe.digests(bpe.round_trip(docs))


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_tokens", to_tokens),
]

#: The similarity classes and the classifier are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

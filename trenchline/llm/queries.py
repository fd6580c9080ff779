"""The registered queries of this subpackage, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trenchline.llm import (
    bpe, exact_dedup, filter_audit, language, line_dedup, mixing, near_dup, quality, simhash, source_divergence, token_files, url_filter, vector_search)
from trenchline.llm.checks import CHECKS
from trenchline.llm.tables import table


def op1_near_duplicates(spark, sf_dir):
    """doc_id, class_id, class_size, kept."""
    return near_dup.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op3_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_mixing(spark, sf_dir):
    return mixing.mix_words(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_token_files(spark, sf_dir):
    return token_files.checksums(token_files.token_table(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_quality(spark, sf_dir):
    """doc_id, doc_score, site_prior, posterior, kept."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("row.doc_id", "doc_score", "site_prior", "posterior", "kept")


def op9_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_source_divergence(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_url_filter, op3_line_dedup, op4_mixing, op5_bpe_round_trip, op6_language,
    op7_token_files, op8_quality, op9_top_k, op10_exact_dedup, op11_source_divergence, op12_filter_audit, op13_simhash)}

__all__ = ["QUERIES", "CHECKS"]

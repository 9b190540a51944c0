"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, licenses, mixing, multiset, neardup, ppm, quality, toxicity, urls, wrappers
from .common import table


def op1_bpe(spark, sf_dir):
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))


def op2_ppm_code_length(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_wrapper_extraction(spark, sf_dir):
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op5_quality_posterior(spark, sf_dir):
    """The documents that the rules keep, with their posterior to six places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.assess(docs, columns=["doc_id"]).where(F.col("posterior") >= quality.KEEP_AT)
    return judged.withColumn("posterior", F.floor(F.col("posterior") * 1e6 + 0.5) / 1e6)


def op6_multiset_fingerprints(spark, sf_dir):
    """Every document's fingerprint, in base64."""
    return multiset.fingerprints(table(spark, sf_dir, "documents")).withColumn("fingerprint", F.translate(F.base64("fingerprint"), "\r\n", ""))


def op7_near_duplicates(spark, sf_dir):
    """Every document that has a duplicate, with its group."""
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity_nnpu(spark, sf_dir):
    """The documents flagged as toxic, with their score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity") >= toxicity.THRESHOLD).select("doc_id", "toxicity")


def op9_source_mix(spark, sf_dir):
    """The documents chosen for the target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, tokens="n_tokens").select("doc_id", "source", "n_tokens")


def op10_url_filter(spark, sf_dir):
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_ppm_code_length, op3_license_scan, op4_wrapper_extraction, op5_quality_posterior, op6_multiset_fingerprints, op7_near_duplicates, op8_toxicity_nnpu, op9_source_mix, op10_url_filter)}
ORACLE_SQL = {"op6_multiset_fingerprints": multiset.oracle(), "op5_quality_posterior": quality.oracle(), "op10_url_filter": urls.oracle()}

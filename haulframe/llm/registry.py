"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from haulframe.llm import decontamination, html_extraction, langid, license_scan, ngram_join, quality_classifier, quality_rules, sentencepieces, substring_dedup, url_filter
from haulframe.llm.storage import small_batches


def _small_batches(run):
    @wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    every = {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_sentencepieces": sentencepieces.op2_sentencepieces,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_langid": langid.op4_langid,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_html_extraction": html_extraction.op7_html_extraction,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    }
    return {name: _small_batches(run) for name, run in every.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.OP3_SQL,
        "op5_decontamination": decontamination.OP5_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op9_ngram_join": ngram_join.OP9_SQL,
        "op10_substring_dedup": substring_dedup.OP10_SQL,
    }

"""Queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity
from .frames import read
from .store import shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def _rollup(spark: SparkSession) -> token_counts.Rollup:
    return token_counts.Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents through three batches: all are inserted with their words as tokens, all are revised to the
    tokenizer's counts, and those without a word are deleted. Each batch is committed twice, which must change nothing."""
    docs, rollup = read(spark, sf_dir, "documents"), _rollup(spark)
    old, new = (stored(token_counts.count(docs, version)) for version in (token_counts.WORDS, token_counts.VERSION))
    batches = {"load": token_counts.inserts(old), "revise": token_counts.revisions(old, new), "drop": token_counts.deletes(new.where("n_words = 0"))}
    for name, changes in [*batches.items(), *batches.items()]:
        rollup.commit(name, changes)
    return rollup.totals()


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with words as tokens, documents without a word deleted, its batches folded."""
    counted, rollup = stored(token_counts.count(read(spark, sf_dir, "documents"), token_counts.WORDS)), _rollup(spark)
    rollup.commit("load", token_counts.inserts(counted))
    rollup.commit("drop", token_counts.deletes(counted.where("n_words = 0")))
    rollup.compact()
    return rollup.totals()


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the license scan."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_ngram_join, op4_packing, op5_quality_rules, op6_decontamination, op7_language_id, op8_quality_classifier, op9_license_scan, op10_token_counts, word_counts, license_phrases)}
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.SQL, "op3_ngram_join": ngram_join.SQL, "op5_quality_rules": quality_rules.SQL, "word_counts": token_counts.SQL, "license_phrases": license_scan.SQL}

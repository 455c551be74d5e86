"""Tables to read: Parquet folders by name, and the languages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.languages import all_languages

LANGUAGES = (
    "code string, name string, case_map map<string,string>, fold_map map<string,string>, transliterate_map map<string,string>, precomposed_to_base_map map<string,string>,"
    " spacing_diacritics array<string>, needs_segmentation boolean, segment_rules array<string>, unigram_cjk boolean, has_one_to_one_folds boolean, has_one_to_one_transliterate boolean"
)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table, dealt over the cores if its files split into fewer parts: a file of one row group is one task otherwise.
    A table with as many parts as cores is read as it is, without a shuffle."""
    found = spark.read.parquet(f"{folder}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def languages(spark: SparkSession) -> DataFrame:
    rows = [
        (x.code, x.name, x.case_map, x.fold_map, x.transliterate_map, x.precomposed_to_base, list(x.spacing_diacritics), x.needs_segmentation, [r.value for r in x.segment_rules], x.unigram_cjk, x.has_one_to_one_folds, x.has_one_to_one_transliterate)
        for x in all_languages()
    ]
    return spark.createDataFrame(rows, LANGUAGES)

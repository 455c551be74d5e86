"""Stages and pipelines as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.languages import language
from ..plans.compose import in_batches
from ..plans.pipeline import REGISTRY, Pipeline


def register_languages(spark: SparkSession) -> None:
    """The view ``languages``."""
    from ..sources.tables import languages

    languages(spark).createOrReplaceTempView("languages")


def register_view(spark: SparkSession, name: str, table: str, pipeline: Pipeline, text: str = "text", out: str = "normalized") -> None:
    """A view of ``table`` with the normalized text as one more column, as native expressions."""
    spark.table(table).withColumn(out, pipeline.col(text)).createOrReplaceTempView(name)


def register_function(spark: SparkSession, name: str, stage: str, lang: str = "ENG") -> None:
    """A function of a text for SQL, for stages that run in Python (forms, HTML, Markdown)."""
    function = REGISTRY[stage].python(language(lang))
    if function is None:
        raise ValueError(f"{stage!r} is a native expression: use register_view")
    spark.udf.register(name, in_batches([function]))

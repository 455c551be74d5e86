"""Helpers shared by the operators: column selection, input size, bounded samples, held-out folds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import read as read


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that are used, by name; others, whatever they are called, don't matter."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(c) for c in more])


def private(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has, in whatever case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def fold(doc_id: str | Column = "doc_id", of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % of


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one scan, a sum per task)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])


def in_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, of: int = 5) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold, smallest id hashes first.

    The sample of labels is bounded by ``limit``, so it may be broadcast; texts stay on the executors. Of several rows with
    one doc_id the text with the smallest hash counts, so rows are bounded as well.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(of=of) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    found = id_text(docs).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), "y")


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What ``fit`` makes of a bounded sample, computed by one task of an executor; only the model comes to the driver."""
    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch.cast(schema) for batch in batches]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(rows, schema)))], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])

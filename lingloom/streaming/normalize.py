"""Pipelines over streams. Stages are stateless, so a stream needs no watermark and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline


def normalize_stream(source: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, text: str = "text", once: bool = True) -> StreamingQuery:
    """Normalizes ``text`` of a streaming frame and appends to Parquet at ``path``; exactly once, by ``checkpoint``.

    ``once`` takes what is there and stops; else the stream goes on.
    """
    if not source.isStreaming:
        raise ValueError("the source is no stream")
    writer = pipeline.transform(source, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

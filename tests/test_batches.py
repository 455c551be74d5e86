"""Stages in Python: memory of a worker, and texts of every size in one batch."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata

import pytest
from pyspark.sql import functions as F

from lingloom.operators.base import TextStage
from lingloom.plans.pipeline import Pipeline
from lingloom.plans.presets import preset


@pytest.mark.parametrize("gated", [False, True])
def test_strings_of_a_batch_are_not_held_at_once(spark, gated):
    """40 texts of 1 MB in one batch; each result holds the peak of Python's memory until then."""

    def peak(text: str) -> str:
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        reached = tracemalloc.get_traced_memory()[1]
        if "last" in text:
            tracemalloc.stop()
        return str(reached).zfill(len(text))

    class Gated(TextStage):
        def gate(self, lang):
            return (lambda col: F.length(col) > 0) if gated else None

    text = F.concat(F.repeat(F.lit("é"), 500_000), F.when(F.col("id") == 39, "last").otherwise("more"))
    frame = spark.range(0, 40, 1, 1).select("id", text.alias("text"))
    rows = Pipeline((Gated(peak),)).transform(frame).select("id", F.length("text").alias("n"), F.col("text").cast("decimal(38)").cast("long").alias("peak")).collect()
    assert [r["id"] for r in rows] == list(range(40)) and {r["n"] for r in rows} == {500_004}
    assert 0 < max(r["peak"] for r in rows) < 12e6


def test_texts_of_every_size(spark):
    rng = random.Random(5)
    texts = [None, "", "ﬁ", "é" * 1_500_000, None, *("Ａé\x01 " * rng.choice([0, 1, 100, 100_000]) for _ in range(60)), None, "", "ẛ̣" * 700_000, "a", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    once = F.concat("text", F.lit(""))  # not a plain column, so no text is kept from Python by a gate
    rows = frame.select("i", Pipeline.from_names(["nfkc"]).col("text").alias("gated"), Pipeline.from_names(["nfkc"]).col(once).alias("all"), preset("bert_like").col("text").alias("bert")).collect()
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [r["i"] for r in rows] == list(range(len(texts)))
    assert [r["gated"] for r in rows] == want and [r["all"] for r in rows] == want
    assert [r["bert"] for r in rows[:4]] == [None, "", "ﬁ", "e" * 1_500_000] and rows[-1]["bert"] is None


def test_no_rows(spark):
    frame = spark.range(0).select(F.lit("é").alias("text"))
    assert Pipeline.from_names(["nfd"]).transform(frame).collect() == []


def test_wide_letters_are_sent_back_chunk_by_chunk():
    """What nfkc_ascii sends: a batch gives several results, each of about a chunk, with the batch's rows in order."""
    import pyarrow as pa

    from lingloom.plans.compose import CHUNK, in_batches

    texts = [None, *("Ａ" * (1000 + k) for k in range(2000)), None]
    run = in_batches([lambda text: unicodedata.normalize("NFKC", text)]).func
    parts = list(run(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts).slice(5, 7)])))
    assert sum(map(len, parts)) == len(texts) + 7 and max(p.nbytes for p in parts) < CHUNK
    want = [None if t is None else "A" * len(t) for t in texts]
    assert [t for p in parts for t in p.to_pylist()] == want + want[5:12]

"""Size and shape of plans: many stages, gates, small tables, deep Markdown."""

from __future__ import annotations

import random
import time

import pytest

from lingloom.operators import markdown
from lingloom.plans.pipeline import REGISTRY, Pipeline
from lingloom.sources.tables import read

from .test_stages import _random, run

ALTERNATING = ["normalize_whitespace_full", "lowercase"] * 6


def references(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("text#")


@pytest.mark.parametrize("fuse", [True, False])
def test_references_are_linear(spark, fuse):
    frame = spark.createDataFrame([("a", )], "text string")
    size = {}
    for n in (4, 8, 12):
        began = time.perf_counter()
        size[n] = references(frame.select(Pipeline.from_names(ALTERNATING[:n]).col("text", fuse).alias("out")))
        assert time.perf_counter() - began < 10
    assert size[12] <= size[4] + 16 and size[12] - size[8] <= size[8] - size[4] + 4
    began = time.perf_counter()
    stages = Pipeline.from_names(ALTERNATING).transform(frame, "text", "out")
    stages._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 10 and references(stages) < 40


def test_many_stages(spark):
    texts = [*_random(70, 120), None, "", " A  b\x0bC ", "\x0b\x0bÉ   x"]
    for names in (ALTERNATING, ["nfkc", "lowercase", "strip_html", "normalize_whitespace_full", "nfc", "segment_words", "strip_markdown", "unify_width"]):
        pipeline = Pipeline.from_names(names, "ZHO")
        fused, apart = run(spark, pipeline, texts), run(spark, pipeline, texts, fuse=False)
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        projected = [r["out"] for r in pipeline.transform(frame, "text", "out").orderBy("i").collect()]
        assert fused == apart == projected


def test_transform_names(spark):
    frame = spark.createDataFrame([(" A ", 1)], "`a.b` string, n int")
    p = Pipeline.from_names(["lowercase", "trim_whitespace"])
    assert p.transform(frame, "a.b").first()["a.b"] == "a" and p.transform(frame, "a.b").columns == ["a.b", "n"]
    assert Pipeline().transform(frame, "a.b", "out").first()["out"] == " A "


def test_gates(spark):
    """A gate is false only where the stage changes nothing, and needs_apply is exact."""
    texts = _random(80, 300) + ["plain text", "a  b", " a", "a\t", "1 < 2", "&amp;", "&", "# x", "- a", "[a](b)", "a_b", "---", "\n1. a", "A", "é", "ı", "", "a　b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for code in ("ENG", "TUR", "ZHO"):
        names = [n for n, s in REGISTRY.items() if s.gate(Pipeline().lang(code).language) is not None]
        assert {"strip_html", "strip_markdown", "nfc", "lowercase", "segment_words", "normalize_whitespace_full"} <= set(names)
        pipelines = {n: Pipeline.from_names([n], code) for n in names}
        rows = frame.select("text", *[f.col("text").alias(f"{n}_out") for n, f in pipelines.items()], *[f.needs_apply("text").alias(f"{n}_needs") for n, f in pipelines.items()]).collect()
        gated = frame.select(*[REGISTRY[n].gate(p.language)(frame.text).alias(n) for n, p in pipelines.items()], "text").collect()
        by = {r["text"]: r for r in gated}
        for r in rows:
            for n in names:
                changed = r[f"{n}_out"] != r["text"]
                assert r[f"{n}_needs"] == changed and (by[r["text"]][n] or not changed), (n, r["text"])


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/many.parquet")
    assert read(spark, str(tmp_path), "one").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = read(spark, str(tmp_path), "many")
    assert "Exchange" not in many._jdf.queryExecution().executedPlan().toString() or many.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_deep_markdown():
    assert markdown.strip("> " * 100_000 + "x") == "x"
    assert markdown.strip("\n".join("  " * k + f"- a{k}" for k in range(300))) == "\n".join(f"a{k}" for k in range(300))
    assert markdown.strip("> - " * 1500 + "*x*") == "x" and markdown.strip("- " * 3000 + "**x**") == "x"
    rng = random.Random(2)
    pieces = ["> ", "- ", "1. ", "  ", "\n", "x", "*", "`", "# ", "[^1]: "]
    for _ in range(200):
        markdown.strip("".join(rng.choice(pieces) for _ in range(400)))

"""The corpus pipeline's stages on planted documents."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    docs = [(i, text(rng.randrange(30, 120))) for i in range(150)]
    insults = ["idiot", "moron"]
    labels = []
    for i in range(100):
        if i % 3 == 0:
            docs[i] = (i, docs[i][1] + f" You {insults[i % 2]} {text(4)}")
        labels.append((i, 1, int(i % 3 == 0)))
    item, passage = text(40), text(60)
    docs += [(200, docs[110][1]), (201, docs[111][1] + " extra"), (202, text(50) + " " + item + " " + text(50)), (203, text(40) + " " + passage), (204, text(45) + " " + passage), (205, text(60) + " what an i.d.i.o.t")]
    docs += [(300, None), (301, ""), (302, "ok")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(docs), passage


def test_stages(spark, folder, tmp_path):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = docs
    ids = {n: {r["doc_id"] for r in after[n].select("doc_id").collect()} for n in after}
    toxic = {i for i in range(100) if i % 3 == 0} | {205}
    assert ids["toxicity"] == set(texts) - toxic
    assert ids["ngram_join"] == ids["toxicity"] - {200, 201}
    assert ids["suffix_dedup"] == ids["ngram_join"]
    assert ids["decontamination"] == ids["suffix_dedup"] - {202}
    assert ids["packing"] == ids["decontamination"]
    cut = {r["doc_id"]: r["text"] for r in after["suffix_dedup"].collect()}
    assert passage in cut[203] and passage[:50] not in cut[204] and passage[-50:] not in cut[204]
    assert cut[120] == texts[120] and cut[300] is None and cut[302] == "ok"
    for n in list(after)[:-1]:
        assert after[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark, folder):
    path, *_ = folder
    assert corpus_pipeline.run(spark, path).count() > 100


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

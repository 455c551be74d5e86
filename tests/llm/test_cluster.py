"""Every query and every stage on two executors, where shuffled rows arrive in any order, against brute force or SQL."""

from __future__ import annotations

import os
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lingloom.llm import decontaminate, queries
from lingloom.llm.packing import encoder

from .test_dedup import brute_join, brute_suffix

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def results(tmp_path_factory):
    out = tmp_path_factory.mktemp("cluster")
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, str(ROOT / "tests/llm/cluster_job.py"), FOLDER, str(out)], env=env, capture_output=True, text=True, timeout=1500, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con, (lambda name: con.sql(f"SELECT * FROM '{out}/{name}/*.parquet'").to_arrow_table())


def rows(con):
    return con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(results, name):
    con, got = results
    want, have = con.sql(queries.ORACLE_SQL[name]).to_arrow_table(), got(name)
    columns = sorted(want.column_names)
    assert columns == sorted(have.column_names)
    assert sorted(map(repr, have.select(columns).to_pylist())) == sorted(map(repr, want.select(columns).to_pylist()))


def test_packing(results):
    con, got = results
    pieces = got("op4_packing").to_pylist()
    want = Counter()
    for d, t in rows(con):
        ids = np.array([*encoder(None).text_ids(t or ""), 1], "<u4")
        want.update((d, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    ends = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert max(ends.values()) <= 2048


def test_decontamination(results):
    con, got = results
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    index = decontaminate.Index([i for i, _ in items], [t for _, t in items])
    docs = rows(con)
    raw = [(t or "").encode() for _, t in docs]
    found = index.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = Counter((docs[d][0], items[i][0], n, changed) for d, i, n, changed in found)
    assert want and Counter((r["doc_id"], r["item_id"], r["matched_tokens"], r["reparameterised"]) for r in got("op6_decontamination").to_pylist()) == want


def test_token_counts(results):
    con, got = results
    want: dict = {}
    for text, source, lang in con.sql("SELECT text, source, lang FROM documents").fetchall():
        if (text or "").split():
            sums = want.setdefault((source, lang), [0, 0, 0, 0])
            for k, x in enumerate((1, len(encoder(None).text_ids(text)), len(text.split()), len(text.encode()))):
                sums[k] += x
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_words"], r["n_bytes"]] for r in got("op10_token_counts").to_pylist()} == want


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_language_id", "op8_quality_classifier", "op9_license_scan"])
def test_scores_do_not_depend_on_the_cluster(spark, results, name):
    """Trained and scored again in one process: the same rows."""
    key = lambda r: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()}
    again = [key(r.asDict(True)) for r in queries.QUERIES[name](spark, FOLDER).collect()]
    assert sorted(map(repr, again)) == sorted(repr(key(r)) for r in results[1](name).to_pylist())


def test_stages(spark, results):
    con, got = results
    stage = {n: got(f"stage_{n}") for n, _ in corpus_pipeline.STAGES}
    texts = {n: {r["doc_id"]: r["text"] for r in t.select(["doc_id", "text"]).to_pylist()} for n, t in list(stage.items())[:-1]}
    documents = dict(rows(con))

    scored = {r["doc_id"]: r["predicted"] for r in got("op2_toxicity").to_pylist()}
    assert texts["toxicity"] == {d: t for d, t in documents.items() if not scored[d]}

    linked = brute_join(sorted(texts["toxicity"].items()))
    assert texts["ngram_join"] == {d: texts["toxicity"][d] for d, _, c in linked if c == d}

    before = texts["ngram_join"]
    removed = {d: n for d, _, n, _, _ in brute_suffix(sorted(before.items()))}
    after = texts["suffix_dedup"]
    assert set(after) == set(before) and any(removed.values())
    for d, t in after.items():
        cut = len((before[d] or "").encode()) - len((t or "").encode())
        assert cut == removed[d] if (before[d] or "").isascii() else removed[d] - 6 * 200 <= cut <= removed[d]

    items = con.sql("SELECT text FROM benchmark").fetchall()
    index = decontaminate.Index(list(range(len(items))), [t for (t,) in items])
    ids = sorted(after)
    raw = [(after[d] or "").encode() for d in ids]
    leaks = {ids[x[0]] for x in index.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))}
    assert texts["decontamination"] == {d: t for d, t in after.items() if d not in leaks}

    packed = Counter()
    for r in stage["packing"].select(["doc_id", "length"]).to_pylist():
        packed[r["doc_id"]] += r["length"]
    assert packed == {d: len(encoder(None).text_ids(t or "")) + 1 for d, t in texts["decontamination"].items()}

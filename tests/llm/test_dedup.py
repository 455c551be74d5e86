"""Suffix-array dedup and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lingloom.llm import ngram_join, suffix_dedup
from lingloom.llm.components import components


def brute_suffix(rows):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                mask[i : i + 50] = True
        kept = bytes(x for x, m in zip(b, mask, strict=False) if not m)
        runs = int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if len(b) else 0
        out.append((d, len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_join(rows):
    def shingles(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def collect(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def chains(seed: int):
    """Texts that link only through each other, copies, and a line that most of them share."""
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(20))
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((rng.randrange(10**4), " ".join(words) + (" " + line if rng.random() < 0.5 else "")))
    return rows


def test_suffix_dedup(spark, corpus, odd_rows):
    assert collect(suffix_dedup.dedup(corpus(odd_rows))) == brute_suffix(odd_rows)


def test_suffix_dedup_small_groups(corpus, monkeypatch):
    monkeypatch.setattr("lingloom.llm.exchange.GROUP_BYTES", 1000)
    rows = chains(1) + [(5, "y" * 300), (6, "y" * 200 + "z" * 100), (7, "é" * 90)]
    assert collect(suffix_dedup.dedup(corpus(rows))) == brute_suffix(rows)


def test_suffix_sort():
    rng = random.Random(4)
    raw = bytes(rng.choice(b"ab") for _ in range(400)) * 2 + b"\0" * 60
    data = np.frombuffer(raw, np.uint8)
    at = np.array(rng.sample(range(len(raw) - 60), 300))
    size = np.array([100, 1, 199])
    got = suffix_dedup.Suffixes(data).sort(at, np.array([0, 100, 101]), size)
    for a, b in ((0, 100), (100, 101), (101, 300)):
        key = lambda i: raw[i : i + 50]
        assert [key(i) for i in got[a:b]] == sorted(map(key, at[a:b])) and sorted(got[a:b]) == sorted(at[a:b])


def test_strip(corpus, odd_rows):
    docs = corpus(odd_rows)
    out = suffix_dedup.strip(docs)
    assert out.schema == docs.schema and out.count() == len(odd_rows)
    by = {d: n for d, _, n, _, _ in brute_suffix(odd_rows) if d is not None}
    for r in out.collect():
        assert (r["text"] is None) == (r["n_chars"] is None) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    texts = {d: t for d, t in odd_rows if d is not None}
    for r in out.where("doc_id IS NOT NULL").collect():
        if texts[r["doc_id"]] is not None and texts[r["doc_id"]].isascii():
            assert len(r["text"]) == len(texts[r["doc_id"]]) - by[r["doc_id"]]


def test_whole_characters():
    data = np.frombuffer("aé世b".encode(), np.uint8)
    mask = np.array([0, 1, 0, 1, 1, 1, 1], bool)
    assert suffix_dedup.whole_characters(mask, data).tolist() == [False, False, False, True, True, True, True]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(corpus, seed):
    rows = chains(seed)
    assert collect(ngram_join.join(corpus(rows))) == brute_join(rows)


def test_ngram_join_odd(corpus, odd_rows):
    assert collect(ngram_join.join(corpus(odd_rows))) == brute_join(odd_rows)


def test_keep_one(corpus, odd_rows):
    docs = corpus(odd_rows)
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted({d for d, _, c in brute_join(odd_rows) if d is not None and c == d})
    assert kept.where("doc_id IS NULL").count() == 2


def test_empty(corpus):
    assert suffix_dedup.dedup(corpus([])).count() == ngram_join.join(corpus([])).count() == 0
    assert suffix_dedup.strip(corpus([])).count() == ngram_join.keep_one(corpus([])).count() == 0
    nulls = [(None, None), (None, None)]
    assert collect(ngram_join.join(corpus(nulls))) == brute_join(nulls)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(40)] + [(None, 1), (7, 7)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

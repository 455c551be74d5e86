"""Toxicity, language, quality: held-out accuracy, contracts and odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lingloom.llm import language_id, quality_classifier, quality_rules, toxicity

INSULTS = ["idiot", "moron", "scumbag"]
LABELS = "doc_id long, quality int, toxic int"


def fold(doc_id, of):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def texts(n: int, seed: int = 1):
    """(doc_id, text, quality, toxic, lang)."""
    rng = random.Random(seed)
    en, de = ["the", "and", "there", "thing", "with", "water", "other", "than", "this"], ["der", "und", "nicht", "schön", "über", "keit", "zeit", "auch", "ist"]
    out = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(en if lang == "en" else de) + rng.choice(["", "", "er", "en", "s"]) for _ in range(rng.randrange(20, 90))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((i, " ".join(words) + ".", int(good), int(toxic), lang))
    return out


@pytest.fixture(scope="module")
def labelled(spark, corpus):
    rows = texts(600)
    docs = corpus([(i, t) for i, t, *_ in rows])
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x, _ in rows if i % 3] + [(None, 1, 1), (1, None, None), (2, rows[2][2], rows[2][3])], LABELS)
    return rows, docs, labels


def test_toxicity(labelled):
    rows, docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[i]["predicted"], x) for i, _, _, x, _ in rows if fold(i, 5) == 0]
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    assert np.mean([p == y for p, y in held]) > 0.97
    assert toxicity.keep_clean(docs, labels).count() == sum(1 - r["predicted"] for r in got.values())


def test_toxicity_variants(labelled):
    rows, *_ = labelled
    model = toxicity.fit([t.encode() for _, t, *_ in rows], [x for *_, x, _ in rows])

    def score(text):
        raw = text.encode()
        return float(model.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])

    for text in ["the IDIOT there", "the i.d.i.o.t there", "the i d i o t there", "the id-iot there", "the ïdíot there", "the idiot!!! there", "idxiot", "mooron"]:
        assert score(text) > 0.5, text
    for text in ["", "the water there", "und nicht über", "### $$$", "thing " * 500]:
        assert score(text) < 0.5, text
    assert score("x" * 300 + "idiot" + "x" * 300) >= 0  # a long word is read in windows
    short, long = score("idiot"), score("the water " * 3000 + "idiot")
    assert short > 0.5 and long > 0.5


def test_toxicity_rare_marks():
    """Insults twenty times rarer than the commonest, and stems that clean texts hold now and then."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("abdefghilnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    common, rare, endings = ["idiot", "moron"], ["scumbag", "wretch"], ["ta", "ver", "lich", "zon", "keit", "pal", "unge", "mer"]

    def text(kind):
        words = [rng.choice(plain) for _ in range(rng.randrange(40, 120))]
        stem = lambda: "krotz" + rng.choice(endings) + rng.choice(endings)
        if kind == "stem":
            words[::16] = [stem() for _ in words[::16]]
        elif kind:
            words.insert(rng.randrange(len(words)), rng.choice(common if kind == "common" else rare))
        elif rng.random() < 0.05:
            words.insert(5, stem())
        return " ".join(words) + "."

    kinds = ["common"] * 400 + ["rare"] * 20 + ["stem"] * 40 + [None] * 2500
    model = toxicity.fit([text(k).encode() for k in kinds], [int(k is not None) for k in kinds])
    held = {k: [text(k).encode() for _ in range(100)] for k in ("common", "rare", "stem", None)}
    share = {k: float((model.score(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])) >= 0.5).mean()) for k, t in held.items()}
    assert share["common"] > 0.9 and share["rare"] > 0.9 and share["stem"] > 0.9 and share[None] < 0.05, share


def test_spelled_out_words():
    """Single letters are joined within each document, whatever stands beside it in the chunk."""
    parts = [b"you i d i o t", b"I see", b"i d i o t", b"m o r o n", b"a b"]
    alone = [toxicity.find_words(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in parts]
    both = toxicity.find_words(np.frombuffer(b"".join(p + b" " for p in parts), np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)]))
    words = lambda w, d: sorted(w.code[w.start[i] : w.stop[i]].tobytes() for i, doc in zip(w.which, w.doc, strict=True) if doc == d)
    assert [words(both, d) for d in range(len(parts))] == [words(w, 0) for w in alone]
    assert len(words(both, 0)) == 2 and len(words(both, 2)) == len(words(both, 3)) == 1


def test_subsequence_kernel():
    """Against the definition: weights of common gapped subsequences, cosine."""
    from itertools import combinations

    def phi(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                key = (word[i], word[j], word[k])
                out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    words = [b"\x00\x01\x02\x00\x01", b"\x00\x05\x01\x02", b"\x03\x03\x03\x03"]
    x = toxicity.vectors(words)
    for a, u in zip(words, x, strict=True):
        for b, v in zip(words, x, strict=True):
            p, q = phi(a), phi(b)
            want = sum(p[g] * q.get(g, 0) for g in p) / (sum(t * t for t in p.values()) * sum(t * t for t in q.values())) ** 0.5
            assert abs(float(u @ v) - want) < 1e-5


def test_quality(labelled):
    rows, docs, labels = labelled
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    assert all(r["held_out"] == (fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == q for i, _, q, *_ in rows if fold(i, 5) == 0]) > 0.97


def test_language(spark, labelled):
    rows, *_ = labelled
    docs = spark.createDataFrame([(i, t, x if i % 4 else None) for i, t, _, _, x in rows] + [(9000, None, "en"), (9001, "12 34!", "de"), (None, "und nicht auch", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(docs).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, _, _, x in rows if fold(i, 4) == 2]) > 0.98
    assert all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert got[9000]["lang_pred"] == got[9001]["lang_pred"] == "und" and got[None]["lang_pred"] == "de"


def test_rare_language(spark):
    """A language with one document in five hundred is sampled, and its other documents get it."""
    rng = random.Random(9)
    sounds = {"en": ["the", "and", "ing", "wh"], "de": ["der", "sch", "ung", "ein"], "fi": ["kää", "yö", "suo", "nki"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en"] * 2400 + ["de"] * 1600 + ["fi"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, limit=60).collect()}
    assert np.mean([got[i] == "fi" for i, _, lang in rows if lang == "fi"]) == 1 and np.mean([got[i] == lang for i, _, lang in rows]) > 0.98
    assert language_id.shares({"a": 5000, "b": 3, "c": 900}, 2000) == {"b": 3, "c": 900, "a": 1097}


def test_odd(spark, corpus, odd_rows, labelled):
    *_, labels = labelled
    docs = corpus(odd_rows)
    for frame in (toxicity.score(docs, labels), quality_classifier.score(docs, labels), language_id.predict(docs)):
        rows = frame.collect()
        assert len(rows) == len(odd_rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert {r["score"] for r in quality_classifier.score(docs, one).collect()} == {1.0}
    for frame in (toxicity.score(corpus([]), labels), quality_classifier.score(corpus([]), labels), language_id.predict(corpus([])), toxicity.keep_clean(corpus([]), none)):
        assert frame.count() == 0


def test_rules(spark, corpus, odd_rows):
    import duckdb

    rows = odd_rows + [(100 + i, "spam spam spam spam spam " * 8) for i in range(30)]
    docs = corpus(rows)
    got = quality_rules.judge(docs).toArrow()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(quality_rules.SQL).to_arrow_table()
    key = lambda t: sorted(map(repr, t.select(want.column_names).to_pylist()))
    assert key(got) == key(want)
    assert quality_rules.judge(corpus([])).count() == 0


def test_rules_repeats(spark):
    from pyspark.sql import functions as F

    def brute(w):
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)})

    rng = random.Random(2)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(60)]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = frame.select("i", quality_rules.repeat_words("w").alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == list(map(brute, lists))
    assert frame.select(F.sum(quality_rules.repeat_words("w"))).first()[0] == sum(map(brute, lists))


def test_hosts(spark):
    """A host whose documents fail goes; a host with one failing document is shrunk towards the others."""
    bad = [(i, "x y", "bad") for i in range(60)] + [(100 + i, " ".join(f"w{i}{k}" for k in range(30)), "bad") for i in range(2)]
    good = [(200 + i, " ".join(f"v{i}{k}" for k in range(30)), f"host{i % 8}") for i in range(160)] + [(900, "x y", "tiny"), (901, " ".join(f"u{k}" for k in range(30)), "host1")]
    docs = spark.createDataFrame(bad + good, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert got[100]["host_failed"] and not got[100]["kept"] and not got[100]["base_failed"]
    assert got[200]["kept"] and got[901]["kept"] and got[900]["base_failed"]

"""License scan, decontamination, packing, token counts: brute force and exact round trips."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lingloom.llm import decontaminate, license_scan, packing, token_counts
from lingloom.llm.packing import encoder

LICENSES = [
    (1, "Licensed under CC BY 4.0. ALL rights\nreserved"), (2, "GNU General Public License; cc by cc-by"), (3, "Released undre the MIT Licence."), (4, "all rights are reserved"),
    (5, None), (6, ""), (7, "Licensed under the Apache License, Version 2.0"), (8, "generally public license, accby"), (9, "cc by"), (10, "éall rights reserved"), (11, "x " * 4000 + "all rights reserved"),
    (12, "Released under"), (13, "the MIT License"), (None, "cc by"), (9, "cc by"),
]


def test_license(corpus):
    def brute(text):
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))

    got = license_scan.scan(corpus(LICENSES)).collect()
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(((d, *brute(t)) for d, t in LICENSES), key=key)
    by, texts = {r["doc_id"]: r for r in got}, dict(LICENSES)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in got)
    assert by[3]["labels"] == "mit" and 0.8 < by[3]["score"] < 1 and by[7]["labels"] == "apache-2.0" and by[12]["labels"] == by[13]["labels"] == ""
    for d, found in (("mit", by[3]), ("apache-2.0", by[7])):
        span = found["spans"][0]
        assert span["label"] == d and texts[found["doc_id"]][span["start"] : span["stop"]].lower().startswith(("released", "licensed"))
    assert license_scan.scan(corpus([])).count() == 0


def test_license_edits(corpus):
    """Every notice is found with as many edits as it allows, wherever they fall."""
    import random

    rng = random.Random(6)
    scanner = license_scan.Scanner()
    for notice, label in license_scan.NOTICES.items():
        for _ in range(5):
            text = list(notice)
            for _ in range(len(notice) // license_scan.EDIT_EVERY):
                text[rng.randrange(len(text))] = rng.choice("aeqz")
            raw = ("some words before " + "".join(text) + " and after").encode()
            _, _, fuzzy = scanner.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert label in {s[0] for s, _ in fuzzy[0]}, (notice, "".join(text))


ITEMS = [
    (0, "A farmer sells 12 apples at 3 dollars each and then buys 5 more baskets, how much money does Anna keep?"),
    (1, "The quick brown fox jumps over the lazy dog while seven calm owls watch from an old tree."),
    (2, "If 7 workers paint 7 walls in 7 hours, then how long do 9 workers need for the same number of walls?"),
    (3, None), (4, "too short"), (None, "an item without a number still counts when its many words appear in some text"),
]
TEXTS = [
    (1, "Before. " + ITEMS[0][1] + " After."),
    (2, ITEMS[1][1].upper()),
    (3, "a farmer sells 40 apples at 9 dollars each and then buys 8 more baskets, how much money does Peter keep?"),
    (4, "If 7 workers paint 8 walls in 7 hours, then how long do 9 workers need for the same number of walls?"),
    (5, "If 6 workers paint 6 walls in 6 hours, then how long do 8 workers need for the same number of walls?"),
    (6, "the quick brown fox is no dog and owls watch"), (7, None), (8, ""), (9, "too short"), (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    (11, "xyz " * 3000 + ITEMS[1][1]), (None, ITEMS[1][1]), (12, ITEMS[5][1]), (1, ITEMS[0][1]),
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 100])
def test_decontaminate(spark, corpus, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.matches(corpus(TEXTS), bench, block).collect()
    pairs = sorted({(r["doc_id"], r["item_id"]) for r in got}, key=repr)
    # Document 4 breaks slot consistency; its windows without a change are enough.
    assert pairs == sorted([(1, 0), (2, 1), (3, 0), (4, 2), (5, 2), (11, 1), (None, 1), (12, None)], key=repr)
    changed = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in got}
    assert changed[(3, 0)] and changed[(5, 2)] and not changed[(2, 1)] and all(r["contaminated"] for r in got)
    docs = corpus(TEXTS)
    clean = decontaminate.keep_clean(docs, bench, block)
    assert clean.schema == docs.schema and sorted(r["doc_id"] for r in clean.collect()) == [6, 7, 8, 9, 10]


def test_slots():
    """One value of the item stands for one value of the text."""
    item = "the box has 5 red pens and then 5 blue pens too and 5 green pens inside it"
    index = decontaminate.Index([0], [item])

    def found(text):
        raw = text.encode()
        return bool(index.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))

    assert found(item) and found(item.replace("5", "8")) and not found("the box has 3 red pens and then 6 blue pens too and 4 green pens inside it")


def found(items, text):
    raw = text.encode()
    return [x[1] for x in decontaminate.Index(list(range(len(items))), items).find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))]


def test_numbers_verbatim():
    """Items of numbers are found as verbatim copies, and only so."""
    table = "| 12 | 30 | 7 | 4 | 2 | 19 | 88 | 41 | 5 | 60 | 33 | 71 |"
    items = ["Compute 12 + 30 - 7 * 4 / 2", table, "0 0 0 " * 400]
    assert found(items, "First, compute 12 + 30 - 7 * 4 / 2 by hand.") == [0]
    assert found(items, "See here: " + table.replace("|", ";") + " and so on.") == [1]
    assert found(items, "Compute 13 + 30 - 7 * 4 / 2") == found(items, "| 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | 9 | 10 | 11 | 12 |") == []
    assert found(items, "x " + "0 " * 100_000) == [2]


def test_values_that_meet():
    """Two numbers of an item that become the same number are still one value each."""
    item = "Anna has 3 red pens and then she buys 5 blue pens"
    assert found([item], item.replace("3", "4").replace("5", "4")) == [0]


def test_unspaced_and_short():
    """Scripts without spaces and items of few words are found inside running text."""
    items = ["小明有十二个苹果，他又买了三个，请问一共有多少个？", "東京の人口は何人ですか", "เมืองหลวงของประเทศไทยคืออะไร", "Name seven metals", "什么是重力", "“Quoted” words—with marks… of “many” kinds"]
    for k, item in enumerate(items):
        assert found(items, item) == [k]
    assert found(items, "前面的文字" + items[0] + "后面的文字") == [0]
    assert found(items, "答えてください、" + items[1] + "。それから") == [1]
    assert found(items, "คำถาม" + items[2] + "ตอบ") == [2]
    assert found(items, "Now, name SEVEN metals, please.") == [3] and found(items, "问：什么是重力？") == [4]
    assert found(items, "so Quoted words – with marks, of many kinds") == [5]
    assert found(items, "ประเทศไทย และ 苹果 人口 seven metals 重力") == []


def test_decontaminate_empty(spark, corpus):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(corpus([]), bench).count() == decontaminate.matches(corpus(TEXTS), none).count() == 0
    assert decontaminate.keep_clean(corpus(TEXTS), none).count() == len(TEXTS)


def test_encoder(odd_rows):
    import random

    import pyarrow as pa

    from lingloom.llm.textbuf import chunks

    rng = random.Random(1)
    alphabet = "ab'éÑ×̸́ .3#<|İßσΣ \n\tZ’中ﬁ"
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]
    enc, got = encoder(None), []
    for _, data, offsets in chunks(pa.table({"text": texts})):
        flat, counts = enc.encode(data, offsets)
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert enc.encode(data, offsets, ids=False)[1].tolist() == counts.tolist()
    assert got == [enc.text_ids(t) for t in texts]


def test_packing(corpus, odd_rows):
    got = packing.pack(corpus(odd_rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, t in odd_rows:
        ids = np.array([*encoder(None).text_ids(t or ""), 1], "<u4")
        want[d] += [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items()}
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(corpus([])).count() == 0


def test_patterns():
    import random

    rng = random.Random(8)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 2049), 700)}
    packs = packing.patterns(histogram)
    placed = defaultdict(int)
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 2048
        for n in lengths:
            placed[n] += count
    assert placed == histogram
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(c * (2048 - sum(x)) for c, x in packs) < 0.03 * tokens
    assert packing.patterns({}) == []


def test_token_counts(spark, corpus, odd_rows, tmp_path):
    docs = corpus(odd_rows, clash=False)
    counted = token_counts.count(docs)
    assert sorted((r["n_tokens"] for r in counted.collect())) == sorted(len(encoder(None).text_ids(t or "")) for _, t in odd_rows)
    rollup = token_counts.Rollup(spark, str(tmp_path / "ledger"))
    assert rollup.totals().count() == 0 and rollup.committed() == []
    assert rollup.commit("load", token_counts.inserts(counted)) and not rollup.commit("load", token_counts.inserts(counted))
    total = lambda: {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    before = total()
    assert sum(n for n, _ in before.values()) == len(odd_rows)
    some = counted.where("doc_id < 10")
    from pyspark.sql import functions as F

    new = some.withColumn("version", F.lit("other/2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    assert rollup.commit("revise", token_counts.revisions(some, new)) and rollup.commit("delete", token_counts.deletes(new))
    assert not rollup.commit("revise", token_counts.revisions(some, new))
    left = counted.where("doc_id >= 10 OR doc_id IS NULL").groupBy("source", "lang", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert total() == {(r["source"], r["lang"], r["version"]): (r["n"], r["t"]) for r in left}
    assert rollup.committed() == ["delete", "load", "revise"]
    with pytest.raises(ValueError):
        rollup.commit("a/b", new)

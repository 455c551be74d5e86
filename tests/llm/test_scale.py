"""What holds at any size: hot shingles, hot letters, layouts, strings that collide, names that clash."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lingloom.llm import decontaminate, exchange, ngram_join, packing, suffix_dedup, textbuf, token_counts
from lingloom.llm.packing import encoder

from .test_dedup import brute_join, brute_suffix, chains, collect


def boilerplate(n: int, seed: int, words: int = 14):
    """Documents that share most shingles and have words of their own."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 2, 2, 2, 3]))]
        cut = rng.choice([0, 0, 0, 1])
        rows.append((i, " ".join(common[cut:] + own)))
    return rows


@pytest.mark.parametrize("many", [3, 64])
def test_hot_shingles(corpus, many):
    rows = boilerplate(120, many) + [(1000 + i, f"{t} tail") for i, (_, t) in enumerate(boilerplate(30, 9))] + [(d + 5000, t) for d, t in chains(many)]
    assert collect(ngram_join.join(corpus(rows), many)) == brute_join(rows)


def test_boilerplate_is_one_node():
    """Sets that share hot shingles and nothing else make one node, however many they are."""
    common = np.arange(10, 20, dtype=np.uint64)
    rows = [ngram_join.candidate(np.array([1000 + i, 2000 + i, *common], np.uint64), np.array([0, 0, *[200] * 10])) for i in range(50)]
    assert {(r[0], r[5], r[6], r[7]) for r in rows} == {(12, *ngram_join.fingerprint(common), 10)} and all(not r[2] for r in rows)
    # Cold shingles go to the prefix, all of them if a hot one is in it.
    row = ngram_join.candidate(np.array([5, 6, *common], np.uint64), np.array([9, 9, *[200] * 10]))
    assert [x["h"] for x in row[2]] == [5, 6] and [x["h"] for x in row[8]] == [10]


def test_keep_one_by_text(corpus):
    same = "one text of some words that two rows with an id have"
    rows = [(1, same), (1, same), (1, "quite another text under the same id with its own words"), (2, same), (2, "a third text that no other row has at all, really"), (3, None), (3, ""), (3, None), (4, same.upper() + " ")]
    from pyspark.sql import functions as F

    docs = corpus(rows).withColumns({c: F.lit(c) for c in ("kept_id", "key_ID", "Key_text", "KEY_TIMES", "salt")}).drop("rank", "g").withColumns({"Rank": F.lit(1), "G": F.lit(2)})
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, same), (1, rows[2][1]), (2, rows[4][1]), (3, None), (3, "")])
    stripped = suffix_dedup.strip(docs)
    assert stripped.schema == docs.schema and stripped.count() == len(rows)
    bench = docs.sparkSession.createDataFrame([(7, rows[4][1])], "item_id long, text string")
    clean = decontaminate.keep_clean(docs.withColumnRenamed("salt", "KEY"), bench)
    assert clean.columns == docs.withColumnRenamed("salt", "KEY").columns and clean.count() == len(rows) - 1


def test_wide_tables(corpus, odd_rows):
    """Columns named as the operators' own, in other cases."""
    from pyspark.sql import functions as F

    docs = corpus(odd_rows).withColumns({c: F.lit(c) for c in ("version", "sign", "n_docs", "n_tokens", "sequence_id", "start", "digest", "item", "token", "hits")})
    counted = token_counts.count(docs)
    assert token_counts.totals(token_counts.inserts(counted)).agg(F.sum("n_docs")).first()[0] == len(odd_rows)
    assert packing.pack(docs).select("doc_id").distinct().count() == len({d for d, _ in odd_rows})


def test_packing_parts(corpus, tmp_path):
    """Parts with rows, and so files, follow the buckets and not the shuffle's partitions; ranks go on from batch to batch."""
    rows = [(i % 590, "w " * (i % 97)) for i in range(600)]
    docs = corpus(rows)
    conf = docs.sparkSession.conf
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        packing.pack(docs).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            conf.set(k, v)
    assert len(list((tmp_path / "out").glob("part-*"))) <= 16
    got = docs.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert sorted(at) == list(range(len(at))) and max(at.values()) <= 2048
    assert sum(at.values()) == sum(len(encoder(None).text_ids(t)) + 1 for _, t in rows)


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") & 1 for i in range(n)]


def test_colliding_strings():
    """Two strings that every polynomial modulo 2**64 takes for one."""
    bits = thue_morse(1 << 11)
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    data = np.frombuffer((a + b).encode(), np.uint8)
    at, to = np.array([0, len(a)]), np.array([len(a), len(a) + len(b)])
    assert len(set(textbuf.Hashes(data).of(at, to).tolist())) == 1 and len(set(textbuf.span_hashes(data, at, to).tolist())) == 2
    flat, counts = encoder(None).encode(data, np.array([0, len(a), len(a) + len(b)]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [encoder(None).text_ids(a), encoder(None).text_ids(b)]
    x, y = ngram_join.shingle_sets(data, np.array([0, len(a), len(a) + len(b)]))
    assert x.tolist() != y.tolist()
    index = decontaminate.Index([0], [f"{a} is the word that was asked"])
    raw = f"{b} is the word that was asked".encode()
    assert index.find(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])) == []


def test_layouts():
    """Blobs, tasks and groups' text stay in proportion at any size."""
    for power in range(20, 49):
        layout = exchange.Layout(1 << power)
        assert 1 << layout.direct <= 4096 and 1 << layout.more <= 4096 and layout.partitions <= exchange.TASKS
        assert (1 << power) / layout.groups <= exchange.MOST_BYTES and 1 << layout.bits >= layout.groups
        # A group sends at most 4096 blobs, a relay as many, and there are about as many relays as groups.
        relays = -(-layout.groups // (1 << layout.direct)) << layout.direct if layout.more else 0
        assert relays <= 2 * layout.groups


@pytest.mark.parametrize("direct", [12, 3])
def test_replies(spark, monkeypatch, direct):
    """Corpus-wide counts, with and without relays."""
    monkeypatch.setattr(exchange, "DIRECT_BITS", direct)
    monkeypatch.setattr(exchange, "GROUP_BYTES", 100)
    layout = exchange.Layout(5000)
    assert layout.groups == 50 and bool(layout.more) == (direct == 3)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 300, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    groups = {g: np.unique(rng.choice(pool, 40)) for g in range(50)}
    groups[7] = groups[7][:0]
    total = Counter(x for h in groups.values() for x in h.tolist())

    def send(table: pa.Table) -> pa.Table:
        h = np.array(sorted(groups[table.column("g")[0].as_py()].tolist()), np.uint64)
        return exchange.send(table.column("g")[0].as_py(), h, np.ones(len(h), int), layout)

    asked = spark.range(50).selectExpr("CAST(id AS INT) AS g").groupBy("g").applyInArrow(send, exchange.MAIL)
    assert asked.count() <= 50 * min(40, 1 << layout.direct)
    mail = exchange.replies(asked, layout, lambda n: np.minimum(n, 255)).toArrow()
    for g, h in groups.items():
        own = mail.filter(pa.compute.equal(mail["g"], g))
        assert exchange.read_replies(own, h, layout).tolist() == [total[x] for x in h.tolist()]


def test_suffix_dedup_relayed(corpus, monkeypatch):
    monkeypatch.setattr(exchange, "GROUP_BYTES", 1500)
    monkeypatch.setattr(exchange, "DIRECT_BITS", 2)
    passage = " ".join(f"passage{i}" for i in range(12))
    rows = chains(3) + [(20000 + i, f"start {i} {passage} end {i}") for i in range(60)] + [(20000, passage), (20001, f"x {passage}"), (None, passage)]
    assert collect(suffix_dedup.dedup(corpus(rows))) == brute_suffix(rows)


def test_license_inserted_and_deleted():
    """Notices with characters put in or left out, and with words run together or torn apart."""
    from lingloom.llm import license_scan

    rng = random.Random(6)
    scanner = license_scan.Scanner()
    for notice, label in license_scan.NOTICES.items():
        for how in ("insert", "delete", "join", "tear"):
            text = list(notice)
            for _ in range(len(notice) // license_scan.EDIT_EVERY if how != "tear" else 1):
                k = rng.randrange(1, len(text) - 1)
                if how == "insert":
                    text.insert(k, "q")
                elif how == "delete":
                    del text[k]
                elif how == "tear":
                    text.insert(k, " ")
                elif " " in text:
                    text.remove(" ")
            raw = ("some words before " + "".join(text) + " and after").encode()
            _, _, fuzzy = scanner.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert label in {s[0] for s, _ in fuzzy[0]}, (how, notice, "".join(text))


def test_ledger(spark, tmp_path):
    """Two writers of one batch, a writer that was lost, and folds."""
    rows = [(1, "s", "en", "v", 3, 2, 9), (2, "s", "en", "v", 4, 3, 9)]
    changes = token_counts.inserts(spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, n_tokens long, n_words long, n_bytes long"))
    one, two = (token_counts.Rollup(spark, str(tmp_path / "ledger")) for _ in range(2))
    assert one.commit("a", changes) and not two.commit("a", changes)
    assert not two._enter("batch-a", {"data": "x"})
    (tmp_path / "ledger" / "batch-b").write_text("")  # made and never filled
    assert one.committed() == ["a"] and one.totals().first()["n_docs"] == 2
    assert one.commit("b", changes) and one.totals().first()["n_tokens"] == 14
    assert one.compact() and two.totals().first()["n_tokens"] == 14 and not two.commit("b", changes)
    assert two.commit("c", token_counts.deletes(changes.drop("sign"))) and one.totals().first()["n_docs"] == 2
    assert one.compact() and one.totals().first()["n_tokens"] == 7 and one.committed() == ["a", "b", "c"]

"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Each document is the set of its 5-word shingles; two documents link when the Jaccard similarity of their sets is at
least ``PERCENT`` / 100. Equal sets form a class, and only each class's smallest document takes part further.
Shingles are ordered by corpus-wide document frequency, rarest first; linked sets share a shingle among their first
n - ceil(0.8 n) + 1, so the join is on these prefixes, where shingles of one class alone can be left out.

Shingles of HOT classes or more are joined in a second way, so that boilerplate pairs nobody up. A prefix holds a hot shingle
only if the set has less than 0.2 n others, and then holds all of these. So linked sets that share a cold shingle share one
in their prefixes, and need cold keys only; linked sets that share none have enough hot shingles in common. Those are nodes of
their own: all sets with the same hot shingles and the same size are one, since each of them links through hot shingles
with whatever any of them does. A node is expanded to its sets, a link each, if it links at all.

The join never pairs up all members of a shingle. Every member is first paired with the shingle's most central
member (the one with the fewest rarer shingles), and links give components. Where members still lie in different
components, those outside the shingle's largest component meet single members of it first (ROUNDS times), and then all
others: a link within a component changes nothing, so no link that matters is lost. Pairs pass length, positional and
suffix filters, are made distinct, and are verified on the whole sets once. The suffix filter bounds the difference of what
two sets have beyond their lone shingles from below, by parities: each range of hashes of which one set has an odd and the
other an even number differs. Joins on hot shingles are dealt by node as well (SALTS), so no shingle has one task.

Null or empty text and text without words: the empty set, linked with nothing. A null doc_id takes part in nothing and
gets a null component. Rows with one doc_id and different texts are one node. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .components import components
from .exchange import Layout, grouped, layout_of
from .frames import id_text, in_arrow, private
from .store import gathered
from .textbuf import U64, chunks, lower_table, mix64, span_hashes, words

WORDS, PERCENT = 5, 80
#: Bits of the suffix filter's parities, in longs.
BITS, LONGS = 512, 8
#: Rounds in which members outside a shingle's largest component meet other members of it, one each.
ROUNDS = 1
#: Classes from which on a shingle is hot; steps of the logarithm, base two, in which groups are told; parts of a hot shingle's joins.
HOT, STEP, SALTS = 64, 6, 32
HEAD, KEYS = "array<struct<h:long,pos:int,rest:int>>", "doc_id long, f1 long, f2 long"
CANDIDATES = f"{KEYS}, n int, size int, head {HEAD}, parity array<long>, shingles binary, h1 long, h2 long, hot_size int, hot_head {HEAD}, hot_parity array<long>, hot binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of each document."""
    low = lower_table()[data]
    start, stop = words(low, offsets)
    word = span_hashes(low, start, stop)
    first = np.searchsorted(start, offsets)
    many = max(0, len(word) - WORDS + 1)
    h = np.zeros(many, U64)
    for k in range(WORDS):
        h = h * U64(0x9E3779B97F4A7C15) + word[k : k + many]
    h = mix64(h + U64(WORDS))
    sets = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= WORDS:
            s = np.sort(h[a : b - WORDS + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = U64(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    x = x * U64(0x9E3779B97F4A7C15) + w
                sets.append(mix64(np.array([x + U64(b - a)], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix64(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)), int(mix64(s + U64(0x14057B7EF767814F)).sum(dtype=U64).astype(np.int64))


def sets(docs: DataFrame, layout: Layout) -> DataFrame:
    """(g, doc_id, digest, n_shingles, f1, f2) of every row; the digest is of the text."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            all_ = shingle_sets(data, offsets)
            prints = [fingerprint(s) for s in all_]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("g", "doc_id", "digest")], pa.array([len(s) for s in all_], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())], ["g", "doc_id", "digest", "n_shingles", "f1", "f2"])

    dealt = id_text(docs).select(exchange.group_of(layout).alias("g"), "doc_id", _digest("text").alias("digest"), "text")
    return in_arrow(dealt, rows, "g int, doc_id long, digest binary, n_shingles long, f1 long, f2 long")


def _digest(text: str) -> Column:
    """128 bits of a text; none of a null."""
    return F.coalesce(F.unhex(F.md5(F.col(text).cast("string").cast("binary"))), F.lit(b""))


def need(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * PERCENT // 100)


def _representatives(table: pa.Table, ids: np.ndarray) -> tuple[list[tuple[int, int, int]], list[np.ndarray]]:
    """The group's class representatives, each class once: (id, fingerprint) and shingle sets."""
    wanted, found, seen = set(ids.tolist()), ([], []), set()
    for part, data, offsets in chunks(table):
        doc_ids = part.column("doc_id").to_pylist()
        keep = [i for i, d in enumerate(doc_ids) if d in wanted]
        if not keep:
            continue
        lengths = np.diff(offsets)[keep]
        own = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in keep])
        for i, s in zip(keep, shingle_sets(own, np.concatenate([[0], np.cumsum(lengths)])), strict=True):
            if len(s) and (key := (doc_ids[i], *fingerprint(s))) not in seen:
                seen.add(key)
                found[0].append(key)
                found[1].append(s)
    return found


def _ids(table: pa.Table) -> np.ndarray:
    parts = [np.array(x, np.int64) for x in table.column("ids").to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _parity(s: np.ndarray) -> list[int]:
    odd = np.bincount((s >> U64(64 - 9)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _head(order: np.ndarray, size: int) -> list[dict]:
    """The first shingles of an order, each with the number of those before it and, of ``size`` in all, behind it."""
    return [{"h": int(x), "pos": k, "rest": size - k - 1} for k, x in enumerate(order.astype(np.int64).tolist())]


def candidate(s: np.ndarray, f: np.ndarray, many: int = HOT) -> list | None:
    """What a set with frequencies ``f`` (0: alone) takes to the join: of its cold shingles, and of its hot ones."""
    n, edge = len(s), round(np.log2(many) * STEP)
    prefix = n - int(need(np.array(n))) + 1
    alone, cold = int((f == 0).sum()), int((f < edge).sum())
    if alone >= prefix:
        return None
    order = s[np.lexsort((s, f))]
    row = [n, n - alone, _head(order[alone : min(cold, prefix)], n - alone)]
    row += [_parity(order[alone:]), s.tobytes()] if row[2] else [None, None]
    if cold >= prefix:
        return row + [None] * 6
    hot = order[cold:]
    return [*row, *fingerprint(hot), len(hot), _head(hot[: prefix - cold], len(hot)), _parity(hot), np.sort(hot).tobytes()]


def candidates(docs: DataFrame, reps: DataFrame, layout: Layout, many: int = HOT) -> DataFrame:
    """Representatives whose prefix has a shingle of another class (``candidate``)."""
    texts = grouped(docs, layout)
    by_group = reps.groupBy("g").agg(F.collect_list("doc_id").alias("ids"))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        _, found = _representatives(left, _ids(right))
        if not found:
            return exchange.mail([], [], [])
        h, counts = np.unique(np.concatenate(found), return_counts=True)
        return exchange.send(left.column("g")[0].as_py(), h, counts, layout)

    sent = texts.groupBy("g").cogroup(by_group.groupBy("g")).applyInArrow(send, exchange.MAIL)
    # One class alone: 0; else the logarithm of the number of classes, in steps that a byte can hold.
    answered = exchange.replies(sent, layout, lambda total: np.where(total < 2, 0, np.clip(np.round(np.log2(np.maximum(total, 2)) * STEP), 1, 255)))
    mail = answered.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(by_group.select("g", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "ids"))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, found = _representatives(left, _ids(right))
        rows = []
        if found:
            h = np.unique(np.concatenate(found))
            frequency = exchange.read_replies(right, h, layout)
            rows = [[*key, *row] for key, s in zip(keys, found, strict=True) if (row := candidate(s, frequency[np.searchsorted(h, s)], many))]
        head = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("rest", pa.int32())]))
        long, integer, parity, raw = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()
        types = [long, long, long, integer, integer, head, parity, raw, long, long, integer, head, parity, raw]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in CANDIDATES.split(", ")])

    return texts.groupBy("g").cogroup(mail.groupBy("g")).applyInArrow(choose, CANDIDATES)


def length(x: str, y: str) -> Column:
    """Length filter: sets of such sizes can link."""
    return 100 * F.least(F.col(x), F.col(y)) >= PERCENT * F.greatest(F.col(x), F.col(y))


def enough(most: Column, total: Column) -> Column:
    """Whether an overlap of at most ``most`` can link two sets of ``total`` members together."""
    return (100 + PERCENT) * most >= PERCENT * total


def near(p: str, r: str, n: str, q: str, t: str, m: str) -> Column:
    """Positional filter for a shingle with p and q before it and r and t behind it: all of the fewer may be shared."""
    return length(n, m) & enough(F.least(p, q) + 1 + F.least(r, t), F.col(n) + F.col(m))


def alike(size: str, x: str, n: str, other: str, y: str, m: str) -> Column:
    """Suffix filter: twice the overlap is the sum of the sizes without lone shingles less the difference, which the
    parities bound."""
    apart = reduce(lambda s, t: s + t, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(LONGS)])
    return (100 + PERCENT) * (F.col(size) + F.col(other) - apart) >= 2 * PERCENT * (F.col(n) + F.col(m))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b): suffix filter, then the intersection of whole sets.

    Each pair's sets are laid side by side by two shuffles; a popular document's set is sent to where its pairs are.
    """
    light = nodes.select("node", "n", "size", "parity")
    sizes = pairs.join(light.toDF("a", "n_a", "s_a", "p_a").hint("merge"), "a").join(light.toDF("b", "n_b", "s_b", "p_b").hint("merge"), "b")
    passed = sizes.where(length("n_a", "n_b") & alike("s_a", "p_a", "n_a", "s_b", "p_b", "n_b")).select("a", "b", "n_a", "n_b").distinct()
    whole = nodes.select("node", "shingles")
    side = passed.join(whole.toDF("a", "s_a").hint("merge"), "a").join(whole.toDF("b", "s_b").hint("merge"), "b")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shared = []
        for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(x, U64), np.frombuffer(y, U64)]))
            shared.append(int((both[1:] == both[:-1]).sum()))
        total = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
        yield batch.select(["a", "b"]).filter(pa.array((100 + PERCENT) * np.array(shared, np.int64) >= PERCENT * total))

    return in_arrow(side, rows, "a long, b long").distinct()


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _by_shingle(many: DataFrame, few: DataFrame) -> DataFrame:
    """A join on ``h`` in which the left rows of a hot shingle are dealt over SALTS parts and the right ones go to each.

    ``hot`` says on both sides whether the shingle is; the result has the left one's.
    """
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0))
    return left.join(few.withColumn("salt", F.explode(parts)).drop("hot").hint("merge"), ["h", "salt"]).drop("salt")


def links(nodes: DataFrame) -> DataFrame:
    """Links between nodes that, closed, give the components of all links. Nodes below zero are hot ones."""
    heads = nodes.select("node", "n", (F.col("node") < 0).alias("hot"), F.explode("head").alias("t")).select("node", "n", "hot", "t.h", "t.pos", "t.rest")
    # Central is what has the fewest rarer shingles, lone ones included.
    place = F.col("n") - F.col("rest")
    least = heads.groupBy("h").agg(F.min(F.struct(place.alias("o"), "n", "node", "pos", "rest")).alias("c"), F.first("hot").alias("hot"))
    center = least.select("h", "hot", F.col("c.node").alias("x"), F.col("c.n").alias("m"), F.col("c.pos").alias("q"), F.col("c.rest").alias("t"), F.col("c.o").alias("o"))
    stars = _by_shingle(heads, center).where("node <> x").where(near("pos", "rest", "n", "q", "t", "m"))
    # Of its shingles' central members a document meets the most central one and another.
    met = stars.groupBy("node").agg(F.min(F.struct("o", "m", "x")).alias("u"), F.min(F.struct(F.xxhash64("x"), "x")).alias("v"))
    tried = gathered(met.select("node", F.explode(F.array("u.x", "v.x")).alias("x")).select(*_pair("node", "x")).distinct())
    linked = gathered(verified(tried, nodes))

    for k in range(ROUNDS):
        rest = _open(heads, linked)
        heads = rest.select("node", "n", "hot", "h", "pos", "rest")  # a shingle of one component stays so
        # Of the largest component a member by a hash of shingle and round, so that a document meets many; of the others
        # the most central one. Of these, a document meets one of each component.
        member = F.struct(F.xxhash64("h", "node", F.lit(k)).alias("o"), "node", "n", "pos", "rest", "c")
        central = F.struct(place.cast("long").alias("o"), "node", "n", "pos", "rest", "c")
        chosen = rest.groupBy("h").agg(F.first("hot").alias("hot"), F.min(F.when(F.col("c") == F.col("top"), member)).alias("u"), F.min(F.when(F.col("c") != F.col("top"), central)).alias("v"))
        meet = _by_shingle(rest.where("c <> top"), chosen).select("node", "n", "pos", "rest", "c", F.explode(F.array("u", "v")).alias("w"))
        meet = meet.select("node", "n", "pos", "rest", "c", F.col("w.node").alias("x"), F.col("w.n").alias("m"), F.col("w.pos").alias("q"), F.col("w.rest").alias("t"), F.col("w.c").alias("d"))
        one = meet.where(F.col("c") != F.col("d")).where(near("pos", "rest", "n", "q", "t", "m")).groupBy("node", "d").agg(F.min(F.struct(F.xxhash64("x", "node"), "x")).alias("w"))
        pairs = gathered(one.select(*_pair("node", "w.x")).distinct().join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tried, linked = tried.unionAll(pairs), gathered(linked.unionAll(verified(pairs, nodes)))

    rest = _open(heads, linked).join(nodes.select("node", "size", "parity"), "node")
    outside = rest.where("c <> top").select("h", "hot", *[F.col(a).alias(b) for a, b in zip(("node", "n", "pos", "rest", "c", "size", "parity"), ("x", "m", "q", "t", "d", "other", "y"), strict=True)])
    # Between two outsiders each pair comes once.
    once = (F.col("c") != F.col("d")) & ((F.col("c") == F.col("top")) | (F.col("node") < F.col("x")))
    met = _by_shingle(rest, outside).where(once & near("pos", "rest", "n", "q", "t", "m") & alike("size", "parity", "n", "other", "y", "m"))
    # Nothing before a pair's first shared shingle is shared, so what is behind it bounds the overlap.
    first = met.groupBy(*_pair("node", "x")).agg(F.max(F.col("n") + F.col("m")).alias("total"), F.max(F.least("rest", "t") + 1).alias("most"))
    last = first.where(enough(F.col("most"), F.col("total"))).select("a", "b").join(tried, ["a", "b"], "left_anti")
    return linked.unionAll(verified(last, nodes))


def _open(heads: DataFrame, linked: DataFrame) -> DataFrame:
    """Prefix entries of shingles whose members lie in several components: with the own and the largest component."""
    label = components(linked).toDF("node", "component")
    named = heads.join(label, "node", "left").select("node", "n", "hot", "h", "pos", "rest", F.coalesce("component", "node").alias("c"))
    sizes = named.groupBy("h", "hot", "c").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("h", "hot").agg(F.max(F.struct("size", "c")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "hot", F.col("top.c").alias("top"))
    return gathered(_by_shingle(named, several))


def _closed(docs: DataFrame, many: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of every row (doc_id, digest, n_shingles, f1, f2); of each class of equal sets its smallest document (rep); links
    (a, b) of nodes that, closed, give the components of classes; and the nodes' (node, doc_id, f1, f2)."""
    layout = layout_of(docs)
    own = gathered(sets(docs, layout))
    classes = own.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "g")).alias("r"))
    reps = gathered(classes.select("f1", "f2", "n_shingles", F.col("r.doc_id").alias("rep"), F.col("r.g").alias("g")))
    # A class is a number from here on, a hot node one below zero; numbers are stored, so all readers see the same.
    base = gathered(candidates(docs, reps.select("g", F.col("rep").alias("doc_id")), layout, many).withColumn("node", F.monotonically_increasing_id()))
    cold = base.where(F.size("head") > 0).select("node", "n", "size", "head", "parity", "shingles")
    hot = base.where("hot IS NOT NULL")
    leads = hot.groupBy("h1", "h2", "hot_size", "n").agg(F.min("node").alias("lead"))
    first = leads.select(F.col("lead").alias("node")).join(hot, "node").select(F.expr("-1 - node").alias("node"), "n", F.col("hot_size").alias("size"), F.col("hot_head").alias("head"), F.col("hot_parity").alias("parity"), F.col("hot").alias("shingles"))
    found = gathered(links(gathered(cold.unionAll(first))))
    # A hot node's sets link with each other if it is linked, or if its hot shingles are enough by themselves.
    linked = found.where("a < 0").select(F.explode(F.array("a", "b")).alias("x")).distinct().withColumn("linked", F.lit(True))
    members = hot.select("node", "h1", "h2", "hot_size", "n").join(leads, ["h1", "h2", "hot_size", "n"]).select("node", "n", "hot_size", F.expr("-1 - lead").alias("x"))
    inside = members.join(linked, "x", "left").where(F.coalesce("linked", F.lit(False)) | ((100 + PERCENT) * F.col("hot_size") >= 2 * PERCENT * F.col("n"))).select(F.col("node").alias("a"), F.col("x").alias("b"))
    named = base.select("node", "doc_id", "f1", "f2")
    return own, reps, found.unionAll(inside), named


def join(docs: DataFrame, many: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the result doesn't depend on from how ``many`` classes on a shingle is hot."""
    own, reps, found, named = _closed(docs, many)
    # A hot node has the name of its first set, which is linked where the node is.
    ids = named.select("node", "doc_id").unionAll(named.select(F.expr("-1 - node"), "doc_id"))
    pairs = found.join(ids.toDF("a", "u"), "a").join(ids.toDF("b", "v"), "b").select("u", "v")
    # Members of a class are linked with its representative; a doc_id with several texts joins their classes.
    several = own.join(reps.drop("g"), ["f1", "f2", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    names = components(pairs.unionAll(several), "u", "v")
    return own.join(names, own.doc_id == names.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, many: int = HOT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of linked texts the smallest document's stays.

    Rows count by id and text: rows with one id and texts that are not linked all stay; of rows equal in both one stays, and so do
    rows without words. Rows without an id all stay.
    """
    own, reps, found, named = _closed(docs, many)
    parts = named.join(components(found), "node")
    least = parts.groupBy("component").agg(F.min(F.struct("doc_id", "f1", "f2")).alias("least"))
    gone = parts.join(least, "component").where(F.struct("doc_id", "f1", "f2") != F.col("least")).select("doc_id", "f1", "f2")
    rows = own.where("doc_id IS NOT NULL").groupBy("doc_id", "n_shingles", "f1", "f2", "digest").agg(F.count(F.lit(1)).alias("times"))
    with_words = rows.where("n_shingles > 0").groupBy("doc_id", "n_shingles", "f1", "f2").agg(F.min(F.struct("digest", "times")).alias("t"))
    first = with_words.join(reps.drop("g"), ["f1", "f2", "n_shingles"]).where("doc_id = rep").join(gone, ["doc_id", "f1", "f2"], "left_anti").select("doc_id", "t.digest", "t.times")
    kept = first.unionAll(rows.where("n_shingles = 0").select("doc_id", "digest", "times"))

    key = [private(docs.columns, c) for c in ("key_id", "key_text", "key_times")]
    keyed = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: _digest("text")})
    chosen = keyed.join(kept.toDF(*key), key[:2])
    alone, again = chosen.where(F.col(key[2]) == 1), chosen.where(F.col(key[2]) > 1).dropDuplicates(key[:2])
    return alone.unionAll(again).drop(*key).unionAll(docs.where(F.col("doc_id").cast("long").isNull()))


#: The same components in SQL, over the view ``documents``.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, md5_number(unnest(g)) AS h FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y USING (h)
  WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id),
p AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u),
c AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.v = s.doc_id
"""

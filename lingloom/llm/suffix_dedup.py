"""Suffix-array dedup: removes bytes of ``LENGTH``-byte strings that also start in a document with a smaller id.

Which windows of ``LENGTH`` bytes could be equal is settled by anchors: the anchor of a window is its smallest hashed
``SEED``-byte string, so equal windows have equal anchors at equal places. Consecutive windows with one anchor form a
stretch of text. Only stretches whose anchor occurs in several documents of the corpus go on, to buckets of anchor hashes.
There the suffixes at all windows of the stretches are sorted: two suffixes are compared by binary search over prefix
polynomial hashes for their common extension (a logarithmic number of hash comparisons) and then by one byte, in
a bottom-up mergesort whose merges are all done at once, level by level. Neighbours with a common extension of ``LENGTH``
bytes are equal; their bytes are compared as well, so that a hash collision removes nothing. Of each distinct string the
smallest document keeps it.

Equal stretches are merged before the shuffle, by the relays of a large input, and again in a bucket, so a passage shared
by any number of documents is sorted once; a group of documents sends it at most once.

Bytes are named by their places in a group's texts, laid end to end in the order of id and text, which every pass restores
for itself: a shuffle may deliver rows in another order each time it is read.

Null text is the empty text: nothing removed. A null doc_id is no smaller document and loses nothing. Rows with one doc_id
are one document's texts and don't remove from each other. Matches never cross rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .exchange import Layout, grouped, layout_of
from .frames import private
from .textbuf import U64, Hashes, chunks, mix64, per_doc, spans

LENGTH, SEED = 50, 24
NO_ID = np.iinfo(np.int64).max
#: Text that is hashed, and that is sorted, at a time (more if one document or one anchor has more).
HASH_BYTES = SORT_BYTES = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Stretches:
    """Runs of windows with one anchor: windows start[i] .. last[i] of the buffer, of document doc[i] with id ids[i]."""

    start: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray  # hash of the stretch's text
    doc: np.ndarray
    ids: np.ndarray


def stretches(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Stretches:
    n = len(data) - SEED + 1
    if n < LENGTH - SEED + 1:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none.astype(U64), none.astype(U64), none, none)
    hashes = Hashes(data)
    at = np.arange(n)
    seed = mix64(hashes.of(at, at + SEED))
    bits = U64(32)  # the same everywhere, so that equal windows choose alike
    key = (seed >> bits << bits) | at.astype(U64)  # the smallest upper half, and of equal ones the first
    width, have = LENGTH - SEED + 1, 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    place = (key & ((U64(1) << bits) - U64(1))).astype(np.int64)
    ok = np.zeros(len(place), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    edge = np.ones(len(place), bool)
    edge[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    start = np.flatnonzero(edge & ok)
    stop = np.ones(len(place) + 1, bool)
    stop[:-1] = edge | ~ok
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, start, "right")] - 1
    doc = np.searchsorted(offsets, start, "right") - 1
    whole = mix64(hashes.of(start, last + LENGTH) + (last - start).astype(U64))
    # Smallest hashes are all small: mixed once more, anchors fill the buckets evenly.
    return Stretches(start, last, mix64(seed[place[start]]), whole, doc, ids[doc])


class Suffixes:
    """A buffer of text with prefix hashes; sorts suffixes of ``LENGTH`` bytes within groups."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.hashes = data, Hashes(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at i and j, at most LENGTH, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), LENGTH, np.int64)
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(i, i + middle) == self.hashes.of(j, j + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at i sorts before the one at j; ``ties`` where they are equal."""
        n = self.common(i, j)
        equal = n == LENGTH
        k = np.minimum(n, LENGTH - 1)
        return np.where(equal, ties, self.data[i + k] < self.data[j + k])

    def sort(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``at``, sorted within the groups [first, first + size): all merges of a level at once."""
        at = at.copy()
        run = 1
        while (wide := np.flatnonzero(size > run)).size:
            n = size[wide]
            q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # place within the group
            group, total = np.repeat(first[wide], n), np.repeat(n, n)
            mine = at[group + q]
            odd = (q // run) & 1
            sibling = (q // run ^ 1) * run
            low = np.minimum(sibling, total)
            base, high = low.copy(), np.minimum(sibling + run, total)
            while (busy := np.flatnonzero(low < high)).size:
                middle = (low[busy] + high[busy]) >> 1
                # Equal suffixes keep their order: those of the left run come first.
                before = self.less(at[group[busy] + middle], mine[busy], odd[busy].astype(bool))
                low[busy], high[busy] = np.where(before, middle + 1, low[busy]), np.where(before, high[busy], middle)
            to = (q // (2 * run)) * (2 * run) + q % run + (low - base)
            at[group + to] = mine
            run *= 2
        return at

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the LENGTH bytes at i and j are the same, byte for byte."""
        same = np.ones(len(i), bool)
        for k in range(LENGTH):
            same &= self.data[i + k] == self.data[j + k]
        return same


def _firsts(keys: tuple[np.ndarray, ...], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the smallest id of each distinct key, number of each row's key)."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _same_text(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``start`` and ``other`` have the same bytes."""
    same = np.ones(len(start), bool)
    for k in range(int(length.max(initial=0))):
        on = length > k
        same &= ~on | (data[np.minimum(start + k, len(data) - 1)] == data[np.minimum(other + k, len(data) - 1)])
    return same


def covered(data: np.ndarray, start: np.ndarray, last: np.ndarray, anchor: np.ndarray, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last window) of runs of windows whose string also starts in a smaller document.

    ``place`` is a stretch's first window relative to its anchor's group: equal windows have equal anchors and offsets.
    """
    text = Suffixes(data)
    size = last - start + 1
    stretch = np.repeat(np.arange(len(start)), size)
    shift = np.arange(len(stretch)) - np.repeat(np.cumsum(size) - size, size)
    at, offset = start[stretch] + shift, place[stretch] + shift
    # Equal windows have equal hashes, anchors and offsets: what has no partner in all three needs no sorting.
    _, number, times = np.unique(mix64(text.hashes.of(at, at + LENGTH)) + mix64(anchor[stretch] + offset.astype(U64)), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[number] > 1)
    if not len(some):
        return some, some, some
    some = some[np.lexsort((offset[some], anchor[stretch[some]]))]
    at, stretch, offset = at[some], stretch[some], offset[some]
    a = anchor[stretch]
    of = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (offset[1:] != offset[:-1])])) - 1
    # Sort numbers of suffixes by way of their places: the place tells the suffix.
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    count = np.diff(np.append(edge, len(at)))
    owner = stretch[np.argsort(at, kind="stable")]
    sorted_at = text.sort(at, edge, count)
    stretch = owner[np.searchsorted(np.sort(at), sorted_at)]
    same = np.zeros(len(sorted_at), bool)
    pair = np.flatnonzero(of[1:] == of[:-1]) + 1
    long = pair[text.common(sorted_at[pair], sorted_at[pair - 1]) == LENGTH]
    same[long] = text.equal(sorted_at[long], sorted_at[long - 1])
    string = np.cumsum(~same) - 1
    least = np.full(string[-1] + 1, NO_ID)
    np.minimum.at(least, string, ids[stretch])
    hit = np.flatnonzero(ids[stretch] > least[string])
    which, window = stretch[hit], sorted_at[hit] - start[stretch[hit]]
    order = np.lexsort((window, which))
    which, window = which[order], window[order]
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)])) if len(which) else np.zeros(0, np.int64)
    stop = np.append(new[1:], len(which)) - 1
    return which[new], window[new], window[stop] if len(which) else which


class Group:
    """The texts of one group of documents, end to end, with their stretches. ``table`` has the rows in their order."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table = exchange.in_order(table)
        parts, size = [], 0
        texts, offsets, doc_ids, ends = [], [np.zeros(1, np.int64)], [], 0
        for part, data, at in chunks(table, limit=HASH_BYTES):
            raw = part.column("doc_id")
            ids = raw.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            s = stretches(data, at, ids)
            parts.append(Stretches(s.start + size, s.last + size, s.anchor, s.whole, s.doc + ends, s.ids))
            texts.append(data)
            offsets.append(at[1:] + size)
            doc_ids += raw.to_pylist()
            size, ends = size + len(data), ends + part.num_rows
        self.data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.offsets, self.doc_ids = np.concatenate(offsets), doc_ids
        join = lambda name: np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0, np.int64)
        self.s = Stretches(*[join(f) for f in ("start", "last", "anchor", "whole", "doc", "ids")])

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether one document or more of the group have them (1 or 2)."""
        order = np.argsort(self.s.anchor, kind="stable")
        a, ids = self.s.anchor[order], self.s.ids[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        if not len(first):
            return a.astype(U64), first
        return a[first], 1 + (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first))

    def shared(self, mail: pa.Table, layout: Layout) -> np.ndarray:
        """Stretches whose anchor several documents of the corpus have."""
        known = np.unique(self.s.anchor)
        if not len(known):
            return np.zeros(0, np.int64)
        ok = exchange.read_replies(mail, known, layout) > 0
        return np.flatnonzero(ok[np.searchsorted(known, self.s.anchor)])

    def merge(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct text the smallest document's first stretch, to be sent; stretches of larger documents that equal
        one of these, which go; further stretches of the same document that equal one, and the ones that they equal."""
        s = self.s
        if not len(some):
            return some, some, some, some
        length = s.last[some] - s.start[some] + LENGTH
        firsts, number = _firsts((s.whole[some], length), s.ids[some])
        lead = some[firsts][number]
        alike = _same_text(self.data, s.start[some], length, s.start[lead])
        gone = alike & (s.ids[some] > s.ids[lead])
        again = alike & ~gone & (some != lead)
        # A hash collision leaves a stretch that is sent for itself.
        return np.union1d(some[firsts], some[~alike]), some[gone], some[again], lead[again]


@dataclass
class Letters:
    """Stretches on their way to a bucket: anchor, document id, place in the owner's texts, length, owner; and their bytes."""

    head: np.ndarray  # the five as rows
    text: np.ndarray
    start: np.ndarray  # in text

    @classmethod
    def read(cls, blobs: list[bytes]) -> Letters:
        heads, texts = [np.zeros((5, 0), np.int64)], [np.zeros(0, np.uint8)]
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            raw = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8)
            heads.append(np.ascontiguousarray(raw[: 40 * n].reshape(5, 8, n).transpose(0, 2, 1)).view("<i8").reshape(5, n))
            texts.append(raw[40 * n :])
        head = np.concatenate(heads, 1)
        return cls(head, np.concatenate(texts), np.cumsum(head[3]) - head[3])

    def take(self, some: np.ndarray) -> Letters:
        """Some of them, with only their bytes, end to end."""
        size = self.head[3][some]
        start = np.cumsum(size) - size
        return Letters(self.head[:, some], self.text[np.repeat(self.start[some] - start, size) + np.arange(size.sum())], start)

    def mail(self, g: int, bits: int) -> pa.Table:
        """By bucket, one blob each, its anchors in order."""
        order = np.argsort(self.head[0].view(U64), kind="stable")
        buckets, edges = exchange.cuts(self.head[0].view(U64)[order], bits)
        blobs = []
        for a, b in zip(edges, edges[1:], strict=False):
            part = self.take(order[a:b])
            head = np.concatenate([x.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel() for x in part.head])
            blobs.append((b - a).item().to_bytes(4, "little") + zstandard.compress(head.tobytes() + part.text.tobytes(), 3))
        return exchange.mail([g] * len(buckets), buckets.tolist(), blobs)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct stretch the first of the smallest document; those that equal one of a smaller document; further
        ones of the same document, and the ones that they equal. A hash collision leaves a stretch that stands for itself."""
        anchor, ids, _, size, _ = self.head
        start = self.start
        whole = mix64(Hashes(self.text).of(start, start + size) + size.astype(U64)) if len(size) else anchor
        firsts, number = _firsts((anchor, whole, size), ids)
        lead = firsts[number] if len(firsts) else firsts
        alike = _same_text(self.text, start, size, start[lead])
        gone = alike & (ids > ids[lead])
        again = alike & (ids == ids[lead]) & (lead != np.arange(len(lead)))
        return np.union1d(firsts, np.flatnonzero(~alike)), np.flatnonzero(gone), np.flatnonzero(again), lead[again]


def _letters(group: Group, g: int, some: np.ndarray, layout: Layout) -> pa.Table:
    """The group's stretches by bucket."""
    s = group.s
    size = s.last[some] - s.start[some] + LENGTH
    return Letters(np.stack([s.anchor[some].view(np.int64), s.ids[some], s.start[some], size, np.full(len(some), g)]), group.data, s.start[some]).mail(g, layout.direct)


def _runs(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Runs of bytes a .. b that go, by group."""
    order = np.lexsort((a, g))
    g, a, b = g[order], a[order], b[order]
    edges = np.flatnonzero(np.diff(g, prepend=-1, append=-1))
    blobs = [zstandard.compress(np.concatenate([a[x:y], b[x:y]]).astype("<i8").tobytes(), 1) for x, y in zip(edges, edges[1:], strict=False)]
    return g[edges[:-1]].tolist(), blobs


def _relayed(table: pa.Table, layout: Layout) -> pa.Table:
    """Merges what several groups send for a range of buckets and sends it on; replies, named by buckets below zero, for
    stretches that a smaller document has as a whole."""
    letters = Letters.read(table.column("blob").to_pylist())
    left, gone, again, _ = letters.merge()
    out = letters.take(np.union1d(left, again)).mail(0, layout.bits)
    _, _, home, size, owner = letters.head[:, gone]
    g, blobs = _runs(owner, home, home + size)
    return pa.concat_tables([out, exchange.mail(g, [-1 - x for x in g], blobs)])


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Sorts a bucket's suffixes, some anchors at a time; replies (g, first byte, stop byte) runs to each group."""
    if table.column("bucket")[0].as_py() < 0:
        return exchange.mail(table.column("g").to_pylist(), [-1] * table.num_rows, table.column("blob").to_pylist())
    letters = Letters.read(table.column("blob").to_pylist())
    anchor, size = letters.head[0].view(U64), letters.head[3]
    order = np.argsort(anchor, kind="stable")
    border = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
    block = np.maximum.accumulate(np.where(border, (np.cumsum(size[order]) - size[order]) // SORT_BYTES, 0))
    found = []
    for some in np.split(order, np.flatnonzero(np.diff(block)) + 1):
        part = letters.take(some)
        which, first, stop = _sorted(part)
        home, owner = part.head[2][which], part.head[4][which]
        found.append((owner, home + first, home + stop + LENGTH))
    g, blobs = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return exchange.mail(g, [-1] * len(blobs), blobs)


def _sorted(letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last window) of the runs of windows that go."""
    data, start = letters.text, letters.start
    anchor, ids, size = letters.head[0].view(U64), letters.head[1], letters.head[3]
    last = start + size - LENGTH
    left, gone, again, lead = letters.merge()
    order = left[np.argsort(anchor[left], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]]))
    several = np.diff(edges)
    order = order[np.repeat(several, several) > 1]
    runs = [(gone, np.zeros(len(gone), np.int64), last[gone] - start[gone])]
    if len(order):
        place = _anchor_place(data, start[order], last[order], anchor[order])
        which, first, stop = covered(data, start[order], last[order], anchor[order], -place, ids[order])
        which = order[which]
        at, first_, stop_ = _repeats(which, first, stop, lead)
        runs += [(which, first, stop), (again[at], first_, stop_)]
    which, first, stop = (np.concatenate(x) for x in zip(*runs, strict=True))
    return which, first, stop


def _repeats(which: np.ndarray, first: np.ndarray, stop: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``lead``, first, stop): for each stretch in ``lead``, the runs whose ``which`` it is."""
    order = np.argsort(which, kind="stable")
    low, high = np.searchsorted(which[order], lead, "left"), np.searchsorted(which[order], lead, "right")
    n = high - low
    pick = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return np.repeat(np.arange(len(lead)), n), first[pick], stop[pick]


def _anchor_place(data: np.ndarray, start: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The anchor's place in each stretch. All its windows hold it, so it starts between the last window's start and the
    end of the first; there it is the first seed with its hash."""
    hashes = Hashes(data)
    at = np.zeros(len(start), np.int64)
    for k in range(LENGTH - SEED, -1, -1):
        p = last + k
        on = np.flatnonzero(p <= start + LENGTH - SEED)
        p = p[on]
        found = mix64(mix64(hashes.of(p, p + SEED))) == anchor[on]
        at[on[found]] = p[found]
    return at - start


def removed(group: Group, mail: pa.Table, layout: Layout) -> np.ndarray:
    """Mask of the group's bytes that are removed."""
    s = group.s
    _, local, again, lead = group.merge(group.shared(mail, layout))
    change = np.zeros(len(group.data) + 1, np.int32)
    np.add.at(change, s.start[local], 1)
    np.add.at(change, s.last[local] + LENGTH, -1)
    for bucket, blob in zip(mail.column("bucket").to_pylist(), mail.column("blob").to_pylist(), strict=True):
        if bucket is not None and bucket < 0:
            a, b = np.frombuffer(zstandard.decompress(blob), "<i8").reshape(2, -1)
            at, first, stop = _repeats(np.searchsorted(s.start, a, "right") - 1, a, b, lead)
            move = s.start[again[at]] - s.start[lead[at]]
            np.add.at(change, np.concatenate([a, first + move]), 1)
            np.add.at(change, np.concatenate([b, stop + move]), -1)
    mask = np.cumsum(change[:-1]) > 0
    null = [i for i, d in enumerate(group.doc_ids) if d is None]
    for i in null:
        mask[group.offsets[i] : group.offsets[i + 1]] = False
    return mask


def _passes(texts: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """Of texts by group: the texts, and all mail for the groups: which anchors are shared, and which bytes go."""

    def send(table: pa.Table) -> pa.Table:
        group = Group(table)
        return exchange.send(table.column("g")[0].as_py(), *group.fingerprints(), layout)

    shared = exchange.replies(texts.groupBy("g").applyInArrow(send, exchange.MAIL), layout, lambda total: (total > 1).astype(np.uint8))

    def post(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return exchange.mail([], [], [])
        group = Group(left)
        lead = group.merge(group.shared(right, layout))[0]
        return _letters(group, left.column("g")[0].as_py(), lead[group.s.ids[lead] != NO_ID], layout)

    posted = texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(post, exchange.MAIL)
    if layout.more:
        posted = posted.withColumn("relay", layout.relay()).repartition(layout.partitions, "relay").groupBy("relay").applyInArrow(lambda table: _relayed(table, layout), exchange.MAIL)
    runs = exchange.by_bucket(posted, layout.bits).applyInArrow(_sorted_bucket, exchange.MAIL)
    return texts, shared.unionAll(runs)


def whole_characters(mask: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The mask without UTF-8 characters that it holds only in part."""
    if not len(data):
        return mask
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts) or starts[0]:
        starts = np.concatenate([[0], starts])
    return np.repeat(np.logical_and.reduceat(mask, starts), np.diff(np.append(starts, len(data))))


def strip(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated passages cut from ``text``, at whole characters; ``n_chars`` follows if present.

    A text that is all repeats becomes empty; a null text stays null.
    """
    layout, columns = layout_of(docs), docs.columns
    key = private(columns, "g")
    rows = docs.withColumn(key, exchange.group_of(layout)).repartition(layout.partitions, key)
    texts = rows.select(F.col(key).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, mail = _passes(texts, layout)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left)
        left = group.table
        mask = whole_characters(removed(group, right, layout), group.data)
        at, old = group.offsets, left.column("text").to_pylist()
        new = [None if t is None else group.data[a:b][~mask[a:b]].tobytes().decode("utf-8", "replace") if mask[a:b].any() else t for t, a, b in zip(old, at[:-1], at[1:], strict=True)]
        out = {c: left.column(c) for c in columns} | {"text": pa.array(new, pa.string())}
        if "n_chars" in out:
            out["n_chars"] = pa.array([x if t == u else len(u) for x, t, u in zip(out["n_chars"].to_pylist(), old, new, strict=True)], left.column("n_chars").type)
        return pa.table(out)

    return rows.groupBy(key).cogroup(mail.groupBy("g")).applyInArrow(finish, docs.schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, and the hash of what is left."""
    layout = layout_of(docs)
    texts, mail = _passes(grouped(docs, layout), layout)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left)
        mask = removed(group, right, layout)
        at = group.offsets
        run, _ = spans(mask, at)
        count = np.bincount(np.searchsorted(at, run, "right") - 1, minlength=len(at) - 1)
        sums = [hashlib.sha256(group.data[a:b][~mask[a:b]].tobytes()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"doc_id": pa.array(group.doc_ids, pa.int64()), "n_bytes": np.diff(at), "n_removed": per_doc(mask, at), "n_spans": count, "kept_sha256": pa.array(sums, pa.string())})

    return texts.groupBy("g").cogroup(mail.groupBy("g")).applyInArrow(finish, RESULT)


#: The same result in SQL, over the view ``documents``.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, len(h) // 2 AS n, unnest(range(0, len(h) // 2)) AS i, unnest(regexp_extract_all(h, '..')) AS byte FROM d),
w AS (SELECT r, doc_id, i, s FROM (SELECT r, doc_id, unnest(range(0, len(h) // 2 - 49)) AS i,
    unnest(list_transform(range(0, len(h) // 2 - 49), lambda k: substr(h, 2 * k + 1, 100))) AS s FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
x AS (SELECT r, i FROM w JOIN f USING (s) WHERE doc_id > m),
c AS (SELECT b.r, b.i, byte, max(x.i) OVER (PARTITION BY b.r ORDER BY b.i) AS last FROM b LEFT JOIN x ON b.r = x.r AND b.i = x.i),
z AS (SELECT r, i, byte, coalesce(i - last < 50, false) AS gone FROM c),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM z),
k AS (SELECT r, sum(gone::INT) AS n_removed, sum(begins::INT) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM y GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

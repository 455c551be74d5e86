"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become tokens (runs of letters and digits, lower case; each character of Chinese, Japanese, Thai
and other scripts without spaces is a token, and ``SCALE`` of them weigh as much as a word). In a template, numbers and units
become typed placeholders and so do names (capitalised words inside a sentence); in a second form names stay words, for
texts whose case was changed. Windows of ``WINDOW`` template tokens (whole items if shorter) are joined by hash.
Matched windows line an item up with a document; the values that fill a placeholder must then be consistent: one
value of the item always stands for the same value of the document (different ones may meet in one, as small numbers do);
else only windows without any change count. An item is found if its matched tokens number ``ENOUGH``, or half of the item if
that is less, so re-parameterised copies count.

Documents are scanned once. Two bits for each window hash of the benchmark, in ``BLOCK`` bytes at most, tell which of a
document's windows can match at all; these go to the join with their tokens, dealt over SALTS parts, so that a window that
very many documents share has no task of its own. False positives of the bits find no partner there. What a (document,
item) pair has in common is then verified. Neither the benchmark nor documents are ever gathered in one place.

Items with fewer than ``LEAST`` tokens match by their whole literal sequence, those with fewer than ``SHORT`` say too little
and match nothing. Windows with fewer than half of their tokens literal say too little through placeholders; they match
verbatim only.

Null text matches nothing; a null doc_id or item_id is kept as null; repeated rows give repeated results; empty tables
give an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import id_text, in_arrow, private
from .store import written
from .textbuf import U64, chunks, lower_table, mix64, span_hashes, spans

WINDOW, LEAST, ENOUGH = 8, 5, 13
#: Items of this many tokens up to LEAST match as a whole; fewer say nothing.
SHORT = 3
#: Classes of characters from U+0080 on: of a word, a border, a token of its own (by characters to a word).
WORD, BORDER, HAN, THAI = range(4)
SCALE = {HAN: 2, THAI: 4}
#: Bytes of the bits that tell which windows the benchmark has, at most; parts of a window's join.
BLOCK, SALTS = 16 << 20, 8
TEMPLATE, EXACT = 0, 1
NUMBER, UNIT, NAME = 1, 2, 3
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm m km g kg mg lb lbs oz l ml s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds dollar dollars cent cents euro euros percent degrees".split()
SCHEMA = "doc_id long, item_id long, matched_tokens int, item_tokens int, reparameterised boolean, contaminated boolean"


class Tokens:
    """Tokens of a chunk: spans, literal hashes, placeholder kinds and documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = lower_table()[data]
        capital = np.zeros(len(data), bool)
        if len(data) > 1:
            second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            low[second] += 32  # accented capitals
            capital[second - 1] = True
        capital |= (data >= 65) & (data <= 90)
        word, single, cuts = _characters(data)
        self.start, self.stop = spans(word, np.union1d(offsets, cuts) if len(cuts) else offsets)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.single = single[self.start]
        self.literal = span_hashes(low, self.start, self.stop)
        kind = np.zeros(len(self.start), np.uint8)
        if len(kind):
            # A sentence's first word is capitalised anyway: after a full stop, a line's end or a document's start.
            ends = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data == 46) | (data == 33) | (data == 63) | (data == 10), out=ends[1:])
            inner = np.zeros(len(kind), bool)
            inner[1:] = (self.doc[1:] == self.doc[:-1]) & (ends[self.start[1:]] == ends[self.stop[:-1]])
            kind[inner & capital[self.start]] = NAME
            first = data[self.start]
            kind[(first >= 48) & (first <= 57)] = NUMBER
        numbers, units = _lexicon()
        kind[np.isin(self.literal, numbers)] = NUMBER
        kind[np.isin(self.literal, units)] = UNIT
        self.kind = kind
        typed = np.array([0, 0x1F3D5B79, 0x2F4D6B89, 0x3F5D7B99], U64)
        slot = kind > 0
        self.full = np.where(slot, typed[kind], self.literal)
        self.plain = np.where(slot & (kind != NAME), typed[kind], self.literal)

    def windows(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(first token, hash) of the windows of ``n`` tokens, for both forms of the template."""
        if len(self.start) < n:
            return []
        m = len(self.start) - n + 1
        inside = self.doc[:m] == self.doc[n - 1 :]
        found = []
        for form, slots in ((self.full, self.kind > 0), (self.plain, (self.kind > 0) & (self.kind != NAME))):
            h = np.zeros(m, U64)
            for k in range(n):
                h = h * U64(0x9E3779B97F4A7C15) + form[k : k + m]
            count = np.concatenate([[0], np.cumsum(slots)])
            at = np.flatnonzero(inside & (2 * (count[n:] - count[:m]) <= n))
            found.append((at, mix64(h[at] + U64(n))))
        return found

    def exact(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of the windows of ``n`` literal tokens that have too many slots for ``windows``, or are short."""
        m = max(0, len(self.start) - n + 1)
        count = np.concatenate([[0], np.cumsum((self.kind > 0) & (self.kind != NAME))])
        at = np.flatnonzero((self.doc[:m] == self.doc[n - 1 :][:m]) & ((n < LEAST) | (2 * (count[n:] - count[: len(count) - n])[:m] > n))) if m else np.zeros(0, np.int64)
        h = np.zeros(len(at), U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + self.literal[at + k]
        return at, mix64(h + U64(n) + U64(1 << 32))


@lru_cache(1)
def _word_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


@lru_cache(1)
def _classes() -> np.ndarray:
    """Classes of the code points below U+20000; the two planes above are ideographs."""
    table = np.full(1 << 17, WORD, np.uint8)
    for kind, ranges in ((HAN, "2E80-2FDF 3005-3007 3021-3029 3031-3035 3041-30FF 3100-312F 31A0-31FF 3400-4DBF 4E00-9FFF F900-FAFF FF66-FF9D 1B000-1B16F"),
                         (THAI, "0E00-0EFF 1000-109F 1780-17FF 1950-19DF 1B00-1B7F A980-A9FF AA60-AA7F")):
        for a, b in (r.split("-") for r in ranges.split()):
            table[int(a, 16) : int(b, 16) + 1] = kind
    for c in range(128, len(table)):
        if unicodedata.category(chr(c))[0] in "PSZ" or c < 160 or c in (0x200B, 0x2060, 0xFEFF):
            table[c] = BORDER
    return table


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of words, class of the characters that begin at a byte, borders of the characters that are tokens)."""
    word, single = _word_bytes()[data], np.zeros(len(data), np.uint8)
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return word, single, lead
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
    kind = np.where(point < 1 << 17, _classes()[np.minimum(point, (1 << 17) - 1)], np.where(point < 1 << 18, HAN, WORD))
    for k in range(4):
        word[np.minimum(lead[(kind == BORDER) & (size > k)] + k, len(data) - 1)] = False
    own = kind >= HAN
    single[lead[own]] = kind[own]
    return word, single, np.union1d(lead[own], np.minimum(lead[own] + size[own], len(data)))


@lru_cache(1)
def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    def hashes(words: list[str]) -> np.ndarray:
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        return span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)

    return hashes(NUMBERS), hashes(UNITS)


@dataclass
class Windows:
    """Windows of ``n`` tokens from ``at`` on, joined by hash; the hash holds n and the kind."""

    kind: int
    n: int
    at: np.ndarray
    hash: np.ndarray

    def take(self, some: np.ndarray) -> Windows:
        return Windows(self.kind, self.n, self.at[some], self.hash[some])


def found_windows(t: Tokens, lengths: list[tuple[int, int]], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[Windows]:
    """The windows of each (kind, length) whose hashes are wanted, each place and hash once."""
    for kind, n in lengths:
        parts = [t.exact(n)] if kind == EXACT else t.windows(n)
        if wanted is not None:
            parts = [(at[ok], h[ok]) for at, h in parts for ok in [wanted(h)]]
        at, h = (np.concatenate(x) for x in zip(*(parts or [(np.zeros(0, np.int64), np.zeros(0, U64))]), strict=True))
        order = np.lexsort((h, at))
        at, h = at[order], h[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1])
        yield Windows(kind, n, at[new], h[new])


class Items:
    """The windows of some items, by the length that suits each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.tokens = t = Tokens(data, offsets)
        many = len(offsets) - 1
        self.first = np.searchsorted(t.doc, np.arange(many + 1))
        self.size = np.diff(self.first)
        # An item of unspaced characters needs as much text as one of words.
        self.scale = np.ones(many, np.int64)
        counts = {k: np.bincount(t.doc[t.single == k], minlength=many) for k in SCALE}
        for k, scale in SCALE.items():
            self.scale[(2 * sum(counts.values()) > self.size) & (counts[k] >= np.maximum(*counts.values()))] = scale
        window = np.minimum(self.size, WINDOW * self.scale)
        lengths = sorted({int(n) for n in window if n >= SHORT})
        self.windows = []
        for w in found_windows(t, [(k, n) for n in lengths for k in (TEMPLATE, EXACT) if k == EXACT or n >= LEAST]):
            self.windows.append(w.take(window[t.doc[w.at]] == w.n))

    def enough(self, item: int) -> int:
        """Tokens that have to match."""
        return min(ENOUGH * int(self.scale[item]), -(-int(self.size[item]) // 2))


def once_each(w: Windows, t: Tokens) -> Windows:
    """Of verbatim windows that a document repeats the first; templates stay, as they tell alignments."""
    if w.kind == TEMPLATE:
        return w
    _, first = np.unique(mix64(w.hash + t.doc[w.at].astype(U64)), return_index=True)
    return w.take(np.sort(first))


@dataclass
class Hit:
    """A window that a document (tokens from ``token``) and an item (from ``place``) share, with the tokens of both."""

    kind: int
    token: int
    place: int
    theirs: np.ndarray  # literal hashes
    their_kinds: np.ndarray
    own: np.ndarray
    own_kinds: np.ndarray


def verify(hits: list[Hit]) -> tuple[set[int], bool]:
    """Item tokens that match, and whether a slot's value differs: of verbatim windows, and of all alignments, longest
    first. Literal tokens are compared again. Where the slots of an alignment are inconsistent, only its windows without
    any change count."""
    shifts: dict[int, list[Hit]] = defaultdict(list)
    matched: set[int] = set()
    changed = False
    for hit in hits:
        if hit.kind == TEMPLATE:
            shifts[hit.token - hit.place].append(hit)
        elif (hit.own == hit.theirs).all():
            matched.update(range(hit.place, hit.place + len(hit.own)))
    for _, windows in sorted(shifts.items(), key=lambda x: (-len(x[1]), x[0])):
        tokens: dict[int, tuple[int, int, int, int]] = {}
        for hit in windows:
            for k, values in enumerate(zip(hit.own.tolist(), hit.theirs.tolist(), hit.own_kinds.tolist(), hit.their_kinds.tolist(), strict=True)):
                tokens[hit.place + k] = values
        consistent, differs = _consistent([tokens[k] for k in sorted(tokens)])
        changed |= consistent and differs
        matched |= set(tokens) if consistent else {hit.place + k for hit in windows if (hit.own == hit.theirs).all() for k in range(len(hit.own))}
    return matched, changed


def _consistent(tokens: list[tuple[int, int, int, int]]) -> tuple[bool, bool]:
    """(whether each value of the item has one value and literals agree, whether any value differs)."""
    to: dict[tuple[int, int], int] = {}
    differs = False
    for x, y, kind, other in tokens:
        if kind != other and x != y or not kind and x != y:
            return False, False
        if kind and to.setdefault((kind, x), y) != y:
            return False, False
        differs |= x != y
    return True, differs


class Index:
    """Items in memory, to look a few texts up without Spark: the same windows, joined by search in sorted hashes."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        raw = [(t or "").encode() for t in texts]
        self.ids, self.items = ids, Items(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.windows = [w.take(np.argsort(w.hash, kind="stable")) for w in self.items.windows]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(document, item, matched tokens, whether a slot's value differs)."""
        t, own = Tokens(data, offsets), self.items.tokens
        by: dict[tuple[int, int], list[Hit]] = defaultdict(list)
        every = np.unique(np.concatenate([w.hash for w in self.windows])) if self.windows else np.zeros(0, U64)
        wanted = lambda h: every[np.minimum(np.searchsorted(every, h), len(every) - 1)] == h if len(every) else np.zeros(len(h), bool)
        for keys, w in zip(self.windows, found_windows(t, [(w.kind, w.n) for w in self.windows], wanted), strict=True):
            w = once_each(w, t)
            low, high = np.searchsorted(keys.hash, w.hash, "left"), np.searchsorted(keys.hash, w.hash, "right")
            for token, a, b in zip(w.at.tolist(), low.tolist(), high.tolist(), strict=True):
                for j in keys.at[a:b].tolist():
                    item = int(own.doc[j])
                    x, y = slice(token, token + w.n), slice(j, j + w.n)
                    by[int(t.doc[token]), item].append(Hit(w.kind, token, j - int(self.items.first[item]), t.literal[x], t.kind[x], own.literal[y], own.kind[y]))
        found = []
        for (doc, item), hits in sorted(by.items()):
            matched, changed = verify(hits)
            if matched and len(matched) >= self.items.enough(item):
                found.append((doc, item, len(matched), changed))
        return found


def _blobs(values: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    raw = np.ascontiguousarray(values)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def _columns(w: Windows, t: Tokens) -> dict[str, pa.Array]:
    """Windows as columns: hash, kind, length, literals and kinds of their tokens."""
    at = w.at[:, None] + np.arange(w.n)
    return {"h": pa.array(w.hash.view(np.int64)), "kind": pa.array(np.full(len(w.at), w.kind, np.int32)), "n": pa.array(np.full(len(w.at), w.n, np.int32)), "literals": _blobs(t.literal[at]), "kinds": _blobs(t.kind[at])}


WINDOWS = "h long, kind int, n int, literals binary, kinds binary"


def _benchmark(benchmark: DataFrame) -> DataFrame:
    """The windows of all items: (item, item_id, size, enough, place) and the window. An item is a row of the benchmark."""
    numbered = benchmark.selectExpr("monotonically_increasing_id() AS item", "CAST(item_id AS LONG) AS item_id", "CAST(text AS STRING) AS text")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batch):
            items = Items(data, offsets)
            enough = np.array([items.enough(i) for i in range(part.num_rows)], np.int32)
            for w in items.windows:
                item = items.tokens.doc[w.at]
                columns = {c: part.column(c).take(pa.array(item)) for c in ("item", "item_id")} | {"size": pa.array(items.size[item].astype(np.int32)), "enough": pa.array(enough[item]), "place": pa.array((w.at - items.first[item]).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns | _columns(w, items.tokens))

    return written(in_arrow(numbered, rows, f"item long, item_id long, size int, enough int, place int, {WINDOWS}"))


def _bits(windows: DataFrame, limit: int) -> np.ndarray:
    """Two bits for each hash, by its upper and by its lower part, among 128 for a window but ``limit`` bytes at most; blocks
    of them are made by the executors."""
    many = windows.count()
    bits = min(max(13, (128 * max(many, 1)).bit_length()), max(13, (8 * limit).bit_length() - 1))
    block = min(bits, 16)
    slot = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND((1 << bits) - 1)))

    def one(table: pa.Table) -> pa.Table:
        mask = np.zeros(1 << block, bool)
        mask[table.column("slot").to_numpy() & ((1 << block) - 1)] = True
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(mask).tobytes()], pa.binary())})

    slots = windows.select(slot.alias("slot")).select(F.shiftright("slot", block).alias("block"), "slot").distinct()
    got = slots.groupBy("block").applyInArrow(one, "block long, bits binary").toArrow()  # ``limit`` bytes at most
    out = np.zeros((1 << (bits - block), 1 << (block - 3)), np.uint8)
    for k, blob in zip(got["block"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[k] = np.frombuffer(blob, np.uint8)
    return out.ravel()


def _set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7))) & 1 == 1


def _key() -> Column:
    """128 bits of a document's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def _found(docs: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    """(key, doc_id, item_id, matched_tokens, item_tokens, reparameterised, times): documents are one if id and text are equal."""
    spark = docs.sparkSession
    windows = _benchmark(benchmark)
    lengths = sorted((r["kind"], r["n"]) for r in windows.select("kind", "n").distinct().collect())  # a few lengths
    bits = spark.sparkContext.broadcast(_bits(windows, limit))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = bits.value
        size = len(known).bit_length() + 2

        def wanted(h: np.ndarray) -> np.ndarray:
            maybe = np.flatnonzero(_set(known, (h >> U64(64 - size)).astype(np.int64)))
            out = np.zeros(len(h), bool)
            out[maybe] = _set(known, (h[maybe] & U64((1 << size) - 1)).astype(np.int64))
            return out

        for part, data, offsets in chunks(batch):
            t = Tokens(data, offsets)
            first = np.searchsorted(t.doc, np.arange(part.num_rows + 1))
            for w in found_windows(t, lengths, wanted):
                w = once_each(w, t)
                doc = t.doc[w.at]
                columns = {c: part.column(c).take(pa.array(doc)) for c in ("key", "doc_id")} | {"token": pa.array(w.at - first[doc])}
                yield pa.RecordBatch.from_pydict(columns | _columns(w, t))

    keyed = id_text(docs).select(_key().alias("key"), "doc_id", "text")
    candidates = in_arrow(keyed, rows, f"key binary, doc_id long, token long, {WINDOWS}")
    # Equal rows are counted before anything is joined.
    counted = candidates.groupBy("key", "doc_id", "token", "h", "kind", "n", "literals", "kinds").agg(F.count(F.lit(1)).alias("times"))
    dealt = counted.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).toDF("key", "doc_id", "token", "h", "kind", "n", "theirs", "their_kinds", "times", "salt")
    each = windows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    pairs = dealt.join(each, ["h", "kind", "n", "salt"]).groupBy("key", "doc_id", "item", "item_id", "size", "enough").agg(F.max("times").alias("times"), F.collect_list(F.struct("kind", "token", "place", "theirs", "their_kinds", "literals", "kinds")).alias("hits"))

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, matched, changed = [], [], []
        for i, (hits, enough) in enumerate(zip(batch.column("hits"), batch.column("enough").to_pylist(), strict=True)):
            tokens, differs = verify([_hit(x) for x in hits.as_py()])
            if tokens and len(tokens) >= enough:
                keep.append(i)
                matched.append(len(tokens))
                changed.append(differs)
        got = batch.select(["key", "doc_id", "item_id", "size", "times"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*got.columns, pa.array(matched, pa.int32()), pa.array(changed, pa.bool_())], [*got.schema.names, "matched_tokens", "reparameterised"])

    return in_arrow(pairs, check, "key binary, doc_id long, item_id long, size int, times long, matched_tokens int, reparameterised boolean")


def _hit(x: dict) -> Hit:
    literal, kind = (lambda b: np.frombuffer(b, U64)), (lambda b: np.frombuffer(b, np.uint8))
    return Hit(x["kind"], x["token"], x["place"], literal(x["theirs"]), kind(x["their_kinds"]), literal(x["literals"]), kind(x["kinds"]))


def matches(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK) -> DataFrame:
    """One row per (document, item) found; ``contaminated`` is always true. ``limit`` bounds the bits that documents are tested by."""
    each = _found(docs, benchmark, limit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select("doc_id", "item_id", "matched_tokens", F.col("size").alias("item_tokens"), "reparameterised", F.lit(True).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no item is found.

    The documents found are written down first, so that their size is known: few are broadcast, many are joined.
    """
    key = private(docs.columns, "key")
    found = written(_found(docs, benchmark, limit).select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, _key()).join(found, key, "left_anti").drop(key)

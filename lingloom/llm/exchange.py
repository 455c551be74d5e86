"""Exchange and reply: corpus-wide counts of fingerprints, one entry per group of documents and fingerprint.

Documents are dealt into groups by a hash, a few megabytes of text each. A group sends its distinct fingerprints with
their local counts to buckets of the fingerprint space, a packed run of bytes per (group, bucket). A bucket sums the
counts and replies a byte for each fingerprint, in the order in which it was sent. However frequent a fingerprint is, a
group sends it once, so what a bucket holds is bounded by its share of the space and not by the size of any key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from .frames import id_text, text_bytes
from .textbuf import U64

#: Text of a group: at least and at most; between them it grows with the square root of the input.
GROUP_BYTES, MOST_BYTES, FROM_BYTES = 4 << 20, 16 << 20, 1 << 30
#: Bits of the buckets that a group sends to directly. Where there are more buckets, relays stand between (see ``Layout``).
DIRECT_BITS = 12
#: Tasks of a shuffle at most; a task takes several groups or buckets, one after the other.
TASKS = 1 << 15
MAIL = "g int, bucket int, blob binary"


class Layout:
    """How many groups and buckets an input of so many bytes gets.

    A group sends at most 2 ** ``direct`` blobs, so blobs grow with the groups and not with their square. ``bits`` beyond
    that are settled by relays: one for each range of buckets and each 2 ** ``direct`` groups, so as many as there are groups.
    A relay merges what these groups send for its range, counts it as one, and sends it on to the 2 ** ``more`` buckets there.
    """

    def __init__(self, size: int) -> None:
        each = min(max(GROUP_BYTES, int(GROUP_BYTES * (size / FROM_BYTES) ** 0.5)), max(GROUP_BYTES, MOST_BYTES))
        self.groups = max(12, -(-size // each))
        self.bits = max(4, int(self.groups - 1).bit_length())
        self.direct = min(self.bits, DIRECT_BITS)
        self.more = self.bits - self.direct

    @property
    def partitions(self) -> int:
        return min(self.groups, TASKS)

    def relay(self) -> Column:
        """The relay of a piece of mail."""
        return F.shiftleft(F.shiftright("g", self.direct), self.direct) + F.col("bucket")


def group_of(layout: Layout) -> Column:
    """The group of a row: a hash of id and text, so equal ids or texts alone don't gather."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(layout.groups)).cast("int")


def grouped(docs: DataFrame, layout: Layout) -> DataFrame:
    """(g, doc_id, text), each group in one partition; every later pass over groups reuses this exchange."""
    return id_text(docs).select(group_of(layout).alias("g"), "doc_id", "text").repartition(layout.partitions, "g")


def in_order(table: pa.Table, text: str = "text") -> pa.Table:
    """A group's rows by id and text. A shuffle delivers rows in any order, so whatever counts places in a group has to
    sort first; rows that tie are the same document."""
    keys = pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "text": table.column(text).cast(pa.large_string())})
    return table.take(pc.sort_indices(keys, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Ascending integers of ``width`` bytes as compressed differences, the bytes of equal weight together."""
    steps = np.diff(values.astype(f"<u{width}"), prepend=np.zeros(1, f"<u{width}"))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpack(blob: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    steps = np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.cumsum(steps, dtype=f"<u{width}")


def cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets by the upper ``bits`` that occur in ascending hashes, and their borders; no work for those that don't."""
    bucket = (hashes >> U64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    return bucket[edges[:-1]], edges


def letters(g: int, hashes: np.ndarray, counts: np.ndarray, bits: int, width: int = 4) -> pa.Table:
    """What a group sends: for each bucket the next ``8 * width`` bits of its ascending distinct hashes, and their counts (1-255)."""
    if not len(hashes):
        return mail([], [], [])
    some, at = cuts(hashes, bits)
    low = (hashes << U64(bits)) >> U64(64 - 8 * width)
    blobs = []
    for a, b in zip(at, at[1:], strict=False):
        head = pack(low[a:b], width)
        blobs.append(len(head).to_bytes(4, "little") + head + zstandard.compress(np.minimum(counts[a:b], 255).astype(np.uint8).tobytes(), 1))
    return mail([g] * len(some), some.tolist(), blobs)


def send(g: int, hashes: np.ndarray, counts: np.ndarray, layout: Layout) -> pa.Table:
    """``letters`` to the buckets, or to the relays where there are any."""
    return letters(g, hashes, counts, layout.direct, 8 if layout.more else 4)


def _open(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    return unpack(blob[4 : 4 + n], width), np.frombuffer(zstandard.decompress(blob[4 + n :]), np.uint8)


def mail(g: list[int], bucket: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table({"g": pa.array(g, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def by_bucket(sent: DataFrame, bits: int) -> GroupedData:
    """Mail by bucket, in as many partitions as there are buckets: their number follows the input, not a setting."""
    return sent.repartition(min(1 << bits, TASKS), "bucket").groupBy("bucket")


def _merged(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys, their counts, the number of each entry's key, the blobs' ends in entries)."""
    parts = [_open(b, width) for b in blobs]
    distinct, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([c for _, c in parts]), minlength=len(distinct)).astype(np.int64)
    return distinct, total, inverse, np.cumsum([len(k) for k, _ in parts]).tolist()


def replies(sent: DataFrame, layout: Layout, answer: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(g, bucket, blob): for each fingerprint sent, ``answer`` of its corpus-wide count, a byte each."""
    width, inner = (8, 4) if layout.more else (4, 4)

    def reply(table: pa.Table, width: int) -> pa.Table:
        _, total, inverse, ends = _merged(table.column("blob").to_pylist(), width)
        parts = np.split(answer(total)[inverse].astype(np.uint8), ends[:-1])
        return mail(table.column("g").to_pylist(), table.column("bucket").to_pylist(), [zstandard.compress(r.tobytes(), 1) for r in parts])

    if not layout.more:
        return by_bucket(sent, layout.direct).applyInArrow(lambda table: reply(table, width), MAIL)

    # A relay's name holds its range of buckets, so that buckets of different ranges stay apart.
    relayed = sent.withColumn("relay", layout.relay()).repartition(layout.partitions, "relay")

    def ask(table: pa.Table) -> pa.Table:
        distinct, total, _, _ = _merged(table.column("blob").to_pylist(), width)
        out = letters(table.column("relay")[0].as_py(), distinct.astype(U64), total, layout.more, inner)
        range_ = table.column("bucket")[0].as_py() << layout.more
        return mail(out.column("g").to_pylist(), [range_ + b for b in out.column("bucket").to_pylist()], out.column("blob").to_pylist())

    answered = by_bucket(relayed.groupBy("relay").applyInArrow(ask, MAIL), layout.bits).applyInArrow(lambda table: reply(table, inner), MAIL)

    def hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return mail([], [], [])
        distinct, _, inverse, ends = _merged(left.column("blob").to_pylist(), width)
        got = _read(right, distinct.astype(U64), layout.more, left.column("bucket")[0].as_py() << layout.more)[inverse]
        return mail(left.column("g").to_pylist(), left.column("bucket").to_pylist(), [zstandard.compress(r.tobytes(), 1) for r in np.split(got, ends[:-1])])

    return relayed.groupBy("relay").cogroup(answered.groupBy("g")).applyInArrow(hand_back, MAIL)


def _read(table: pa.Table, hashes: np.ndarray, bits: int, first: int = 0) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint8)
    if len(hashes):
        some, at = cuts(hashes, bits)
        for b, blob in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if b is not None and b >= 0:
                i = int(np.searchsorted(some, b - first))
                out[at[i] : at[i + 1]] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return out


def read_replies(table: pa.Table, hashes: np.ndarray, layout: Layout) -> np.ndarray:
    """The reply byte of each of the group's ascending hashes."""
    return _read(table, hashes, layout.direct)


def layout_of(docs: DataFrame) -> Layout:
    return Layout(text_bytes(id_text(docs)))

"""Vectorised views of whole texts: Arrow batches as byte buffers, prefix hashes, word spans.

Null text is the empty text everywhere. A chunk holds whole documents, about ``CHUNK`` bytes of them (a longer
document is a chunk of its own), so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15
#: Polynomials modulo 2**64 have strings that collide for every base, from some hundred letters on; longer spans are
#: digested instead.
PLAIN_LENGTH = 64
U64 = np.uint64


def chunks(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole documents by ``limit`` bytes: (rows, bytes, offsets), where document i is bytes[offsets[i]:offsets[i+1]]."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        if not part.num_rows:
            continue
        col = part.column(text).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(col):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield part.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, U64), np.full(n + 1, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Polynomial prefix hashes modulo 2**64 of a byte buffer: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, down = _powers(max(CHUNK, 1 << max(0, len(data) - 1).bit_length()))
        self.prefix = np.zeros(len(data) + 1, U64)
        values = _byte_values()[data]
        values *= down[: len(data)]
        np.cumsum(values, out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal substrings have equal hashes, wherever they stand."""
        return (self.prefix[stop] - self.prefix[start]) * self.up[start]


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that stand for their bytes, whatever the spans hold."""
    out = mix64(Hashes(data).of(start, stop) + (stop - start).astype(U64))
    for i in np.flatnonzero(stop - start > PLAIN_LENGTH):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of ``mask``, none of which crosses a document's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(mask) + 1, bool)
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    edge[0], edge[-1] = mask[0], mask[-1]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(mask))])
    both = inner[mask[inner] & mask[inner - 1]]
    points = np.flatnonzero(edge)
    if len(both):
        points = np.sort(np.concatenate([points, both, both]))
    return points[0::2], points[1::2]


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-item) array by document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@lru_cache(8)
def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE = b" \t\n\x0b\x0c\r"


@lru_cache(1)
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+`` of each document."""
    return spans(~byte_set(SPACE)[data], offsets)

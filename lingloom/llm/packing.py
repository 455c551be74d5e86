"""Packing: shortest-pack-first over the length histogram.

Every document is tokenized and cut into pieces of at most ``size`` ids. Only the histogram of piece lengths goes to the
driver: at most ``size`` numbers, whatever the corpus. Lengths are placed longest first, each into the packs that are
shortest so far; packs are kept as counted patterns, so a step moves many packs at once. The patterns then come back to
the pieces by rank: piece number r of a length belongs to the pattern slot whose range of ranks holds r. Ranks are
numbered within hash buckets and shifted by the buckets' running totals, so no length is numbered in one task. Only as
many parts as there are buckets get rows, however many partitions a shuffle has.

Null text is the empty text (one closing id). Rows are packed as they are: repeated rows give pieces of their own; a null
doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import Encoder
from .frames import id_text, in_arrow
from .store import stored
from .textbuf import chunks

SIZE = 2048
CLOSING = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(1)
def encoder(path: str | None) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """Pieces of each document: ids [start, start + length) and their checksum."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part, data, offsets in chunks(batch):
            flat, counts = enc.encode(data, offsets)
            out: list[list[int]] = [[], [], [], [], []]
            at = 0
            for i, n in enumerate(counts.tolist()):
                raw = np.append(flat[at : at + n], np.uint32(CLOSING)).astype("<u4").tobytes()
                at += n
                for start in range(0, n + 1, size):
                    length = min(size, n + 1 - start)
                    for column, x in zip(out, (i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n + 1), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(out[0], pa.int64())), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_arrow(id_text(docs), rows, PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs: longest lengths first, each into the shortest packs that are open."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                open_.setdefault(size - length, []).append((left, (length,)))
                break
            count, lengths = open_[room].pop()
            take = min(count, left)
            left -= take
            if count > take:
                open_[room].append((count - take, lengths))
            elif not open_[room]:
                del open_[room]
            open_.setdefault(room - length, []).append((take, (*lengths, length)))
    return [x for room in sorted(open_) for x in open_[room]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) of the pattern slots, by rank."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = stored(cut(docs, size, path))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(16, sum(histogram.values()) // 200_000)
    place = slots(patterns(histogram, size))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    totals = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    heads = totals.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # A head stands before a bucket's pieces of a length, so one sort, which may spill, takes the place of a window and a join.
    mixed = bucketed.withColumn("before", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    ordered = mixed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "length", F.col("before").asc_nulls_last(), "doc_id", "start", "ids_crc32", "doc_tokens")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = 0  # the next row's rank, if that row isn't a head
        for batch in batches:
            if not batch.num_rows:
                continue
            before = batch.column("before")
            head, row = before.is_valid().to_numpy(zero_copy_only=False), np.arange(batch.num_rows)
            last = np.maximum.accumulate(np.where(head, row, -1))
            rank = np.where(last < 0, following + row, before.fill_null(0).to_numpy()[last] + row - last - 1)
            following = int(rank[-1]) + 1
            batch, rank = batch.filter(pa.array(~head)), rank[~head]
            length = batch.column("length").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                at, table = order[a:b], place[int(length[order[a]])]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ordered.mapInArrow(rows, PIECES + ", sequence_id long, offset long")

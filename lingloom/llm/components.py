"""Connected components of a table of links: within tasks, then in one task if few links are left, else by alternating large
and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import gathered

#: Links (16 bytes each) that one task closes.
LINKS = 1 << 18


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")  # as many as links, some twice


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _names(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and of each the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (u, v) = np.arange(len(nodes)), np.split(at, 2)
    while len(u):
        # A root takes the smallest root that it has a link with: roots of open links halve in two rounds at most.
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, up := root[root]):
            root = up
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def _closed(links: DataFrame, limit: int, roots: bool) -> DataFrame:
    """Of each part's links, ``limit`` at a time, every node with the smallest one that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            node, name = _names(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            keep = np.full(len(node), True) if roots else node != name
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(name[keep])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if sum(len(x[0]) for x in held) + batch.num_rows > limit and held:
                yield close()
                held = []
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if held:
            yield close()

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b", limit: int = LINKS) -> DataFrame:
    """(node, component) of every node with a link; a component is named by its smallest node.

    Links are pairs of longs; a null end or a link of a node with itself says nothing. Tasks first close their own links, so
    that a node has one link in each task. ``limit`` links and fewer are then closed by one task. Beyond that minima are
    combined before the shuffle and joined back, so a node with very many links needs no task of its own. Each round is stored.
    The joins of the rounds are merges at any size: a broadcast would have the driver gather a table in each round.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = gathered(_closed(ends, limit, False))
    if edges.count() <= limit:
        return gathered(_closed(edges.coalesce(1), limit, True)).toDF("node", "component")
    state = None
    while True:
        edges = gathered(_small(_large(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

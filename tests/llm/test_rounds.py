"""Rounds on small tables: their tasks follow the rows, not the shuffle's partitions; components beyond one task."""

from __future__ import annotations

import random

import pytest

from lingloom.llm import components, ngram_join, store

from .test_dedup import brute_join, collect
from .test_scale import boilerplate


@pytest.fixture
def wide(spark):
    """64 shuffle partitions that nothing merges; the result counts the tasks of what is run."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext

    def tasks(run):
        group = f"rounds-{random.random()}"
        context.setJobGroup(group, "")
        got = run()
        known = context.statusTracker()
        stages = {s for j in known.getJobIdsForGroup(group) for s in known.getJobInfo(j).stageIds}
        return got, sum(x.numCompletedTasks for s in stages if (x := known.getStageInfo(s)))

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield tasks
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def linked(seed: int):
    """Links with nodes of many links, chains, pairs met twice; and the smallest node that each one reaches."""
    rng = random.Random(seed)
    edges = [(rng.randrange(-300, 300), rng.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(400, 460)] + [(600, 600 + i) for i in range(1, 80)] + [(799, 600 + i) for i in range(1, 9)]
    edges += [(b, a) for a, b in edges[::3]] + [(None, 1), (7, None), (999, 999)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    least: dict[int, int] = {}
    for x in sorted(near):
        todo = [x] if x not in least else []
        while todo:
            if (y := todo.pop()) not in least:
                least[y] = x
                todo += near[y]
    return edges, least


@pytest.mark.parametrize("limit", [1, 50, components.LINKS])
def test_components_by_limit(spark, limit):
    """Stars where links are many for one task, one task else: the same names, each node once."""
    edges, least = linked(limit)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5), limit=limit).collect()
    assert len(got) == len(least) and {r["node"]: r["component"] for r in got} == least


def test_tasks_of_components(spark, wide):
    edges, least = linked(5)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(64, "a")
    got, tasks = wide(lambda: {r["node"]: r["component"] for r in components.components(frame).collect()})
    assert got == least and tasks < 200


def test_tasks_of_ngram_join(corpus, wide):
    rows = boilerplate(120, 3) + [(1000 + i, t) for i, t in boilerplate(20, 4)]
    got, tasks = wide(lambda: collect(ngram_join.join(corpus(rows))))
    assert got == brute_join(rows) and tasks < 3000


def test_gathered(spark, monkeypatch):
    """A stored table keeps its rows, and its parts where these are large enough; it is never one part of several."""
    rows = spark.range(0, 5000, 1, 20)
    assert store.gathered(rows).rdd.getNumPartitions() == 2
    monkeypatch.setattr(store, "PART", 1 << 13)
    some = store.gathered(rows)
    assert 2 < some.rdd.getNumPartitions() <= 20 and sorted(r["id"] for r in some.collect()) == list(range(5000))
    monkeypatch.setattr(store, "PART", 1)
    assert store.gathered(rows).rdd.getNumPartitions() == 20

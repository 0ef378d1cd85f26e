"""Components against a plain search: tables of every shape, batches cut anywhere, and few steps for large groups."""

import numpy as np
import pyarrow as pa
import pytest

from zephyrlake.llm import graph


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


def shapes():
    rng = np.random.default_rng(5)
    path = rng.permutation(3000).tolist()
    loose = rng.integers(0, 4000, (2500, 2)).tolist()
    star = [(7000, x) for x in range(7001, 9000)] + [(x, 6999) for x in range(8000, 8100)]
    return {"path": list(zip(path, path[1:], strict=False)), "loose": loose, "star": star, "twice": [(1, 2), (2, 1), (1, 2), (2, 3), (4, 4)], "negative": [(-5, 3), (3, -9), (-2, -1)]}


@pytest.mark.parametrize("shape", shapes())
def test_every_shape(spark, shape):
    edges = shapes()[shape]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = graph.components(df).collect()
    assert len(rows) == len({r.id for r in rows})
    assert {r.id: r.component for r in rows} == plain(edges)


def test_small_batches_and_contraction_give_the_same(monkeypatch):
    monkeypatch.setattr(graph, "AT_ONCE", 40)
    edges = shapes()["loose"]
    batches = [pa.RecordBatch.from_pydict({"a": [min(e) for e in edges[i : i + 13]], "b": [max(e) for e in edges[i : i + 13]]}) for i in range(0, len(edges), 13)]
    out = [(a, b) for x in graph.contracted(iter(batches)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert len(out) <= len(edges) and plain(out) == plain(edges)
    both = sorted({(u, v) for a, b in out for u, v in ((a, b), (b, a))})
    want = None
    for n in (1, 3, len(both)):
        cut = [pa.RecordBatch.from_pydict({"u": [x[0] for x in both[i : i + n]], "v": [x[1] for x in both[i : i + n]]}) for i in range(0, len(both), n)]
        rows = {r for x in graph.moved(iter(cut)) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        assert plain([r[:2] for r in rows]) == plain(edges)
        assert want is None or {r[:2] for r in rows} == want
        want = {r[:2] for r in rows}


def test_a_large_group_takes_few_steps(spark, monkeypatch):
    """Links of a group's members, dealt over many tasks, were joined round after round: ten steps and more, five shuffles each."""
    steps = []
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or df.localCheckpoint())
    rng = np.random.default_rng(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rng.integers(0, 5000, (20000, 2)).tolist(), "a long, b long").repartition(16)
        assert {r.component for r in graph.components(df).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(steps) <= 4

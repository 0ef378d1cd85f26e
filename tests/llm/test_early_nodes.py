"""Links of a large group: once a node's sets are known to be connected, they are not linked again in every other node they share."""

import numpy as np

from tests.llm.test_components import plain
from zephyrlake.llm import graph, jaccard


def test_rows_of_a_class_are_linked_once():
    r = np.random.default_rng(2)
    sketches = np.repeat(r.integers(0, 256, (3, 64), np.uint8), 4, axis=0)
    sketches[8:, :60] = sketches[0, :60]  # the third lot is near the first
    key, classes = np.zeros(12, np.int64), np.array([5, 5, 9, 9, 7, 7, 7, 7, 3, 3, 3, 3])
    a, b = jaccard.likely_edges(key, classes, sketches, 0.8)
    assert sorted(zip(a, b, strict=True)) == [(3, 5), (3, 9)]
    assert jaccard.likely_edges(key, np.full(12, 4), sketches, 0.8) == ([], [])
    assert jaccard.likely_edges(key[:0], classes[:0], sketches[:0], 0.8) == ([], [])


def test_few_edges_for_a_large_group(spark, monkeypatch):
    """Each of its sets had an edge in each of its nodes: 20 times as many rows as sets."""
    r = np.random.default_rng(3)
    base = r.integers(0, 256, (4, 64), np.uint8)
    base[3] = base[2]
    base[3, :20] ^= 1  # near none of the others, but in their nodes
    group = np.where(np.arange(400) < 300, 0, np.where(np.arange(400) < 350, 1, np.where(np.arange(400) < 380, 2, 3)))
    sketches = base[group]
    sketches[np.arange(400), r.integers(0, 64, 400)] ^= 7
    nodes = [[int(x) for x in (g if g < 3 else 2) * 1000 + np.arange(20)] + ([9000] if i % 50 == 0 else []) for i, g in enumerate(group.tolist())]
    sets = spark.createDataFrame([(i, n, bytearray(x.tobytes())) for i, (n, x) in enumerate(zip(nodes, sketches, strict=True))], "set_id long, nodes array<long>, sketch binary")
    made, counted = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: made.append(edges.count()) or counted(edges))
    got = {x.id: x.component for x in jaccard.candidate_classes(sets, 0.8, 3, small=16).collect()}
    like = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2) >= jaccard.least_agreement(0.8)
    want = plain([(int(i), int(j)) for i, j in zip(*np.nonzero(like), strict=True) if i < j])
    assert got == want
    assert made[0] < 8 * 400 and all(n < 2 * 400 for n in made[1:])

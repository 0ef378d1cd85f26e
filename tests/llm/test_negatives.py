"""Hard negatives against all products, zone maps and the curve."""

import os

import numpy as np
import pandas as pd
import pytest

from zephyrlake.llm import negatives, queries

SF = "/root/testdata/sf0.01"


def expected(rows, every=100, positives=5, count=10):
    """All products of every anchor; rows: (vec_id, label, vector)."""
    good = [(i, l, np.floor(256 * np.array(v, float)).astype(int).tolist()) for i, l, v in rows if None not in (i, l, v) and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for a, label, v in {i: (i, l, v) for i, l, v in sorted(good, reverse=True) if i % every == 0}.values():
        score = lambda w, v=v: sum(x * y for x, y in zip(v, w, strict=True))
        other = [(-score(w), i, l) for i, l, w in good if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in other if x[2] == label)[:positives]:
            fits = sorted(x for x in other if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:count]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fits)]
    return sorted(out)


def test_the_curve_visits_neighbours():
    """All cells of a grid once, each beside the one before."""
    for n, bits in ((2, 2), (3, 2), (2, 4), (4, 1)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        keys = negatives.hilbert_keys(grid, bits)
        path = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert len(set(keys)) == len(grid) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    v, a = r.integers(-50, 50, (64, 8)), r.integers(-90, 90, (5, 8))
    least, most = negatives.bounds(a, v.min(0)[None], v.max(0)[None])
    s = a @ v.T
    assert (least[:, 0] <= s.min(1)).all() and (most[:, 0] >= s.max(1)).all()
    centres = np.eye(8, dtype=np.int64)[[0, 1]] * 200
    zones = pd.DataFrame({"block": [10, 11], "dims": 8, "label": [1, 1], "n": 9, "lo": [(c - 5).astype("<i8").tobytes() for c in centres], "hi": [(c + 5).astype("<i8").tobytes() for c in centres]})
    asks = pd.DataFrame({"grp": [0], "anchor_id": 0, "dims": 8, "label": 1, "v": [centres[0].astype("<i8").tobytes()], "asks": [[{"ask": 0, "low": int(negatives.LOWEST), "high": int(negatives.HIGHEST)}]]})
    assert negatives.chosen(zones, asks, 5, True)["block"].tolist() == [10]
    assert negatives.chosen(zones, asks, 5, False)["block"].tolist() == []


@pytest.mark.parametrize(("block", "cell", "group"), [(256, 4096, 1024), (7, 20, 3)])
def test_all_rows_of_a_clustered_table(spark, monkeypatch, block, cell, group):
    for name, value in (("BLOCK_ROWS", block), ("CELL_ROWS", cell), ("GROUP_ANCHORS", group), ("ZONES", 16 if block == 7 else 4096)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(7)
    centres = r.normal(size=(4, 6))
    rows = [(i, int(r.integers(4)), (centres[i % 4] + 0.3 * r.normal(size=6)).tolist()) for i in range(400)]
    rows += [(1000 + i, 3, rows[40][2]) for i in range(60)]  # ties
    rows += [(20, 1, None), (40, None, [1.0] * 6), (None, 1, [1.0] * 6), (60, 1, [float("nan")] * 6), (80, 1, [None, *[1.0] * 5]), (2000, 2, [1.0, 2.0]), (2001, 2, [1.5, 2.0]), (2002, 1, [0.5, 1.0]), (2020, 0, [0.0] * 6), (2040, 2, [])]
    df = spark.createDataFrame([(i, l, v, "y") for i, l, v in rows], "vec_id long, label int, embedding array<double>, rank string")
    got = sorted(tuple(x) for x in negatives.hard_negatives(df, every=20).collect())
    assert got == expected(rows, 20) and len(got) > 500


def test_empty_and_large_values(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    rows = [(i, i % 2, [float(2**20 + i), float(i)]) for i in range(30)]  # products beyond 2**53
    got = sorted(tuple(x) for x in negatives.hard_negatives(spark.createDataFrame(rows, kind), every=10, shares=(30, 90)).collect())
    assert got == expected(rows, 10)
    spread = [(i, i % 2, [float(2**17 * (1 + i)), 1.0]) for i in range(30)]
    got = sorted(tuple(x) for x in negatives.hard_negatives(spark.createDataFrame(spread, kind), every=10).collect())
    assert got == expected(spread, 10) and len(got) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_equals_its_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = queries.op13_hard_negatives(spark, SF)
    got, want = sorted(tuple(x) for x in df.collect()), duckdb.sql(queries.OP13_SQL)
    assert want.columns == df.columns and got == sorted(want.fetchall()) and len(got) > 100

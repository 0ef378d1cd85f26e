"""Line dedup, near duplicates, top products and components against brute force."""

import random

import numpy as np
import pytest

from zephyrlake.llm import graph, jaccard, lines, topk


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, r, most):
    x = list(text)
    for _ in range(r.randrange(most + 1)):
        i, kind = r.randrange(len(x) + 1), r.randrange(3)
        if kind == 0:
            x.insert(i, r.choice("abc"))
        elif i < len(x):
            x[i : i + 1] = [] if kind == 1 else [r.choice("abc")]
    return "".join(x)


def test_banded_distance():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(90)))
        b = changed(a, r, 6) if r.random() < 0.7 else "".join(r.choice("ab") for _ in range(r.randrange(90)))
        most = r.randrange(1, 5)
        assert lines.banded(a, b, most) == min(edit(a, b), most + 1)
        assert lines.close(a, b, most) == (edit(a, b) <= most)


def test_close_lines_share_a_key():
    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choice("abcd ") for _ in range(r.randrange(16, 60)))
        b = changed(a, r, 2)
        if edit(a, b) <= 2 and len(b) >= 16:
            keys, owners = lines.keys_of([a, b], 2)
            mine, index = set(keys[owners >> 1 == 0].tolist()), set(keys[(owners & 1) == 1].tolist())
            assert mine & set(keys[owners >> 1 == 1].tolist()) & index


@pytest.fixture(scope="module")
def line_docs():
    r = random.Random(4)
    base = ["".join(r.choice("abc ") for _ in range(r.randrange(10, 60))) for _ in range(60)]
    docs = [(i, "\n".join(changed(r.choice(base), r, 3) for _ in range(r.randrange(0, 10)))) for i in range(80)]
    return [*docs, (900, None), (901, ""), (None, base[0]), docs[5]]


def test_repeated_lines(spark, line_docs):
    df = spark.createDataFrame(line_docs, "doc_id long, text string")
    got = {x.doc_id: x.drop for x in lines.repeated_lines(df).collect()}
    occurrences = [(d, n, x) for d, t in sorted(set(line_docs), key=lambda z: (z[0] is None, z[0] or 0)) for n, x in enumerate(lines.lines_of(t or "")) if len(x) >= lines.MIN_CHARS]
    distinct = sorted({x for _, _, x in occurrences})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2:
                root[find(a)] = find(b)
    seen, want = set(), {d: [] for d, _ in line_docs}
    for d, n, x in occurrences:
        if find(x) in seen:
            want[d].append(n)
        seen.add(find(x))
    assert got == want
    kept = {x.doc_id: x.text for x in lines.without_repeats(df).collect()}
    for d, t in line_docs:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d])
        assert kept[d] == left if not want[d] or (left or "").strip() else d not in kept
    assert lines.repeated_lines(df.limit(0)).count() == 0 and lines.without_repeats(df.limit(0)).count() == 0


def similar(a, b):
    return len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))


@pytest.mark.parametrize("sizes", [{}, {"small": 8, "cell": 8, "leaders": 3}])
def test_near_duplicates(spark, sizes):
    """Classes equal brute force, also where buckets are split and components meet leaders; a set has a link where one is near, and no more than there are."""
    r = random.Random(1)
    docs = []
    for g in range(25):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(30, 200))]
        for k in range(r.choice([1, 1, 2, 5, 60 if g == 0 else 3])):
            x = list(base)
            for _ in range(r.randrange(0, 4)):
                x[r.randrange(len(x))] = f"z{r.randrange(999)}"
            docs.append((g * 100 + k, " ".join(x)))
    docs += [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (None, docs[0][1]), docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {}
    for x in jaccard.near_duplicates(df, **sizes).collect():
        got.setdefault(x.doc_id, []).append((x.class_id, x.n_links))
    sets = [jaccard.Shingles().of(t or "") for _, t in docs]
    distinct = {s.tobytes(): s for s in sets if len(s)}
    names = list(distinct)
    near = {a: [b for b in names if b != a and similar(distinct[a], distinct[b])] for a in names}
    group = {a: a for a in names}
    for _ in names:
        for a in names:
            group[a] = min([group[a], *(group[b] for b in near[a])])
    classes = {}
    for (d, _), s in zip(docs, sets, strict=True):
        for class_id, links in got[d]:
            assert (class_id is None) == (not len(s))
            most = len(near[s.tobytes()]) if len(s) else 0
            assert min(1, most) <= links <= most
            if len(s):
                assert classes.setdefault(group[s.tobytes()], class_id) == class_id
    assert len(set(classes.values())) == len(classes)
    if sizes:
        return
    kept = jaccard.one_of_each(df).collect()
    assert len(kept) == len(classes) + 2
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert 1 - (1 - jaccard.survival(3)) ** jaccard.runs_for(0.999, 3) >= 0.999


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(500 + r.randrange(50), 500 + r.randrange(50)) for _ in range(40)] + [(900, 901)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {x.id: x.component for x in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_top_products(spark, scale):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        rows.append((i, [float(x) for x in r.normal(size=8) * scale * (1 + i % 7)]))
    rows[60] = (60, rows[50][1])
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [0.0] * 8), (1200, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_products(df).collect())
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    want = []
    for i, v in good:
        if i % 50 == 0:
            scores, other = m @ v, ids != i
            order = np.lexsort((ids[other], -scores[other]))[:5]
            want += [(i, n + 1, int(ids[other][k]), int(scores[other][k])) for n, k in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_products(df.limit(0)).count() == 0

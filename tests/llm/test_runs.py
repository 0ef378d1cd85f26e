"""Periodic runs against comparison of all words at all distances."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from zephyrlake.llm import queries, runs


def brute(w):
    """All stretches that keep a distance, the smallest distance first."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, z - a, q) for (a, z), q in out.items())


def series(r):
    k = r.choice([1, 2, 3, 4])
    w = [r.randrange(k) for _ in range(r.randrange(60))]
    for _ in range(r.randrange(4)):
        at = r.randrange(len(w) + 1)
        w[at:at] = [r.randrange(k) for _ in range(r.randrange(1, 20))] * r.randrange(1, 8)
    return w


def test_runs_equal_comparison_at_all_distances():
    r, seen = random.Random(5), 0
    for _ in range(600):
        w = series(r)
        got = [tuple(x) for x in runs.found_runs(np.array(w, np.int64)).tolist()]
        assert got == brute(w)
        seen += len(got)
    assert seen > 500


def test_sums_of_squared_differences_are_zero_at_equal_blocks_only():
    words = np.random.default_rng(3).integers(0, 3, 400)
    for b in (1, 2, 8, 32):
        starts = np.arange(0, 400 - 3 * b, b)
        hit = runs.matches(words, starts, b)
        for i, s in enumerate(starts):
            assert hit[i].tolist() == [bool((words[s : s + b] == words[s + d : s + d + b]).all()) for d in range(b, 2 * b)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    docs = [(i, r.choice([" ", "\n", "\t \x0b"]).join(f"é{x}" for x in series(r)), "a") for i in range(300)]
    docs += [(301, None, None), (302, "", "a"), (None, "x " * 20, "a"), (303, "\x1c    " * 9, "a"), (7, docs[7][1], "a"), (304, "ha " * 30_000 + "end", "a"), (305, "y" * 1_000_000, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    small = [d for d in docs if len(d[1] or "") < 50_000]
    assert sorted((x for x in got if x[0] not in (304, 305)), key=repr) == sorted((expected(d, t) for d, t, _ in small), key=repr)
    long = {x[0]: x for x in got}
    assert long[304][1:5] == (1, 0, 30_000, 1) and long[305][1] == 0


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "x")], "doc_id long, body string, collapsed string")
    row = runs.periodic_runs(df, "body").first()
    assert row.asDict(True) == {"doc_id": 1, "n_words": 7, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "a b"}
    assert runs.periodic_runs(df.limit(0), "body").count() == 0
    assert runs.periodic_runs(df.withColumn("body", F.lit(None).cast("string")), "body").first().collapsed == ""

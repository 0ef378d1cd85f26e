"""Numbers of links of near duplicates are those of all pairs, in classes that fit a cell and in larger ones."""

import random

import pytest

from tests.llm.test_pairs import similar
from zephyrlake.llm import jaccard


@pytest.mark.parametrize("sizes", [{}, {"small": 8, "cell": 8, "leaders": 3}])
def test_every_link_counts(spark, sizes):
    r = random.Random(5)
    docs = []
    for g, copies in enumerate((40, 12, 2, 1)):
        base = [f"w{r.randrange(900)}" for _ in range(120)]
        for k in range(copies):
            x = list(base)
            for _ in range(r.randrange(0, 3)):
                x[r.randrange(len(x))] = f"z{r.randrange(999)}"
            docs.append((g * 100 + k, " ".join(x)))
    docs += [(900, docs[0][1]), (901, None), (902, "one two")]
    sets = {d: jaccard.Shingles().of(t or "") for d, t in docs}
    distinct = {s.tobytes(): s for s in sets.values() if len(s)}
    want = {d: sum(similar(s, o) for k, o in distinct.items() if k != s.tobytes()) if len(s) else 0 for d, s in sets.items()}
    assert max(want.values()) > 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in jaccard.near_duplicates(df, **sizes).collect()} == want

"""Line dedup keeps one row a line, whatever the number of keys it stands under; keys know their number of lines."""

import hashlib

import numpy as np
import pandas as pd

from zephyrlake.llm import lines


def test_one_row_a_line_is_kept(spark, monkeypatch):
    """Lines of a large group of near copies were written and joined once for each of their keys."""
    seen = []
    real = lines.cut
    monkeypatch.setattr(lines, "cut", lambda df: seen.append(out := real(df)) or out)
    base = "a long line of which there are many copies with one or two letters changed, no more"
    texts = [base[:i] + "xyz"[j] + base[i + 1 :] for i in range(10, 60) for j in range(3)]
    classes = lines.line_classes(spark.createDataFrame([(x,) for x in texts], "text string"), share=0.1, most=4, cell=16, meet=32).collect()
    assert len(classes) == len(set(texts)) and len({r.component for r in classes}) == 1
    kept = [x for x in seen if "line" in x.columns]
    assert [x.count() for x in kept] == [len(set(texts))]


def test_groups_know_their_lines():
    batch = pd.DataFrame({"key": [1, 1, 1, 2, 2, 3, 3], "id": [2, 3, 4, 2, 4, 6, 8]})
    out = lines.by_lines(batch, batch["key"].to_numpy())
    assert out["n"].tolist() == [2] * 7
    assert len(set(out["key"][:5])) == 1 and out["key"][5] != out["key"][0]
    assert lines.by_lines(batch[:0], np.zeros(0, np.int64)).columns.tolist() == ["key", "id", "n"]


def test_keys_end_in_empty_bytes(spark, monkeypatch):
    """Rows of keys are most of what line dedup shuffles: of each key only so many bits go there, and no pair is lost."""
    monkeypatch.setattr(lines, "KEY_BITS", 12)
    base = [hashlib.sha256(str(n).encode()).hexdigest() for n in range(40)]
    texts = base + [x[:20] + "#" + x[21:] for x in base]
    classes = {r.id: r.component for r in lines.line_classes(spark.createDataFrame([(x,) for x in texts], "text string"), share=0.1, most=4).collect()}
    # Keys that agree by chance bring candidates, which are compared.
    signed = lambda x: (i := lines.line_id(x)) - (1 << 64) * (i >> 63)
    assert len(classes) == 80 and len(set(classes.values())) == 40
    assert all(classes[signed(x)] == classes[signed(y)] for x, y in zip(base, texts[40:], strict=True))

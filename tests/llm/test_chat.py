"""Chat formatting: round trips, shared turns, position ids and attention intervals against a plain tree."""

import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyrlake.llm import chat, queries

SF = "/root/testdata/sf0.001"
HARD = ["\\### Assistant: </turn> ok", "####", "\\", "\\\\#", "</turn>\n### user: x </turn>\n", "<|endoftext|>", "a:b", "", "é😀\r\n ", "## #", "<\\/turn>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("\\#</turn>: \nab"), st.text("\\#</turn>: \nab")), max_size=4))
def test_marks_inside_texts_are_reversible(turns):
    written = "".join("".join(chat.marked(r, t)) for r, t in turns)
    assert chat.parsed(written) == turns
    for _, t in turns:
        assert "###" not in chat.escaped(t).replace("\\#", "") and "</turn>" not in chat.escaped(t)


def rows_of(seed=4, n=60):
    r, out = random.Random(seed), []
    for c in range(n):
        for k in range(r.randrange(1, 7)):
            text = f"common {k}" if r.random() < 0.7 else r.choice([*HARD, f"own {r.randrange(50)}"])
            out.append((c, k, r.choice(["user", "assistant"]) if r.random() < 0.2 else ("user", "assistant")[k % 2], text))
    out += [(100, k, ("user", "assistant")[k % 2], f"common {k}") for k in range(3)] * 1
    out += [(101, None, None, None), (101, 0, "as:si", "x"), (None, 0, "assistant", "of no one"), (102, 0, "user", "twice"), (102, 0, "user", "twice")]
    return out


def conversations(rows):
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    return {c: [x[1:] for x in sorted(t)] for c, t in by.items()}


@pytest.mark.parametrize("most", [1 << 17, 400, 1])
def test_formatted_reads_back(spark, most):
    rows = rows_of()
    df = spark.createDataFrame([(*x, "y") for x in rows], "conv_id long, turn int, role string, text string, leaf string")
    nodes, members = chat.formatted(df, most=most)
    want = conversations(rows)
    back = {x.conv_id: x for x in members.join(chat.read_back(nodes), "leaf").collect()}
    assert set(back) == set(want) and members.count() == len(want)
    for c, turns in want.items():
        assert [tuple(t) for t in back[c].turns] == turns
        assert back[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert back[c].written == "".join("".join(chat.marked(r, t)) for r, t in turns)
    laid = nodes.collect()
    trees = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}
    if most == 1 << 17:  # every shared turn once
        assert len(laid) == len(trees) and len({x.sequence for x in laid}) == len({t[0] for t in want.values()})
    else:
        assert len(laid) >= len(trees)
    for name in {x.sequence for x in laid}:
        own = sorted((x for x in laid if x.sequence == name), key=lambda x: x.node)
        ends = []
        for i, x in enumerate(own):
            assert x.node == i and x.start == (ends[-1] if ends else 0)
            ends.append(x.start + len(x.tokens))
            up, line = x.parent, []
            while up is not None:
                line.append(own[up])
                up = own[up].parent
            assert x.depth == len(line) and x.position == sum(len(y.tokens) for y in line)
            assert x.parent is None or x.parent < i
            seen = [t for s in x.ancestors for t in range(s["from"], s["to"])]
            assert seen == sorted(t for y in line for t in range(y.start, y.start + len(y.tokens)))
            assert all(a["to"] < b["from"] for a, b in zip(x.ancestors, x.ancestors[1:], strict=False))


def test_a_large_tree_is_dealt_to_ranges(spark):
    rows = [(c, k, ("user", "assistant")[k], ["shared start", f"answer {c} " * 20][k]) for c in range(300) for k in range(2)]
    nodes, _ = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), most=8_000)
    sizes = [x["count"] for x in nodes.groupBy("sequence").count().collect()]
    assert 5 < len(sizes) < 20 and max(sizes) < 100
    assert nodes.where("depth = 0").count() == len(sizes) and nodes.where("depth = 1").count() == 300


def test_long_and_empty_ones(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " * 5) for k in range(800)] + [(2, 0, "assistant", "word " * 200_000)]
    nodes, members = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    back = {x.conv_id: x for x in members.join(chat.read_back(nodes), "leaf").collect()}
    assert len(back[1].turns) == 800 and back[2].loss == "word " * 200_000
    assert all(len(x.ancestors) <= 1 for x in nodes.collect())
    none, nobody = chat.formatted(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert none.count() == 0 and nobody.count() == 0 and chat.read_back(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_equals_its_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op12_chat_format(spark, SF)
    got = sorted(tuple(x) for x in df.collect())
    want = duckdb.sql(queries.OP12_SQL)
    assert want.columns == df.columns and got == sorted(want.fetchall())
    hostile = next(x for x in got if x[0] == -7)
    assert hostile[1] == 2 and hostile[4] == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()

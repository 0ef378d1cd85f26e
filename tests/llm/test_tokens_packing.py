"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from zephyrlake.llm import packing, tokens
from zephyrlake.llm.pretokens import vocabulary, vocabulary_path

PARTS = ["a", "é ", " the", "  ", "\n", "<|endoftext|>", "１2", " don't", "😀", " Word", "aaaa", "\x1c", " ", "࢏", "ß"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(200))) for _ in range(n)] + ["a" * 3000, "ab" * 2000, " " * 2000, "x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_familiar_characters_are_cut_as_the_library_does(library):
    for c in [*range(0x501), *range(0x1E00, 0x2070), *range(0x3000, 0x3100), 0x88F, 0x1255C]:
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} {chr(c)} x"
        assert vocabulary().words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_counts_match_the_library(spark, library):
    docs = [(i, t, "other") for i, t in enumerate(texts(300))] + [(900, None, None), (901, "", None), (None, "x", "y"), (3, texts(300)[3], "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string")
    rows = tokens.token_counts(df, limit=5).collect()
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 5) for d, t, _ in docs)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    v = vocabulary()
    assert tokens.merged_lengths([b"aaa", b"", b"b"], v).tolist()[1:] == [0, 1]


def test_packing_keeps_every_piece_in_place(spark, library):
    docs = [(i, t) for i, t in enumerate(texts(120, 2))] + [(900, None), (901, ""), (None, "x y"), (3, "again")]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect()
    want = Counter()
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at, size, piece = 0, (len(ids) - 1) % 64 + 1, 0
        while at < len(ids):
            want[d, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, size, piece = at + size, 64, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 30, 1000, 20000])
def test_plans_are_whole_and_near_the_bound(n):
    r = random.Random(n)
    counts = Counter(r.randrange(1, 1025) for _ in range(n))
    plan = packing.completion_plan(dict(counts), 1024)
    held = Counter()
    for items, times in plan:
        assert sum(items) <= 1024
        for s in items:
            held[s] += times
    assert held == counts
    bins, floor = sum(t for _, t in plan), packing.least_bins(counts, 1024)
    assert floor <= bins <= floor * 1.01 + 1


def test_branching_improves_on_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}
    assert sum(t for _, t in packing.completion_plan(counts, 13)) <= sum(t for _, t in packing.best_fit(counts, 13))

"""Line dedup with a threshold that grows with length, and exact repeats of any length, against brute force."""

import random

import numpy as np

from test_pairs import edit
from zephyrlake.llm import lines


def test_wide_bands():
    r = random.Random(12)
    for _ in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randrange(60, 400)))
        b = list(a)
        for _ in range(r.randrange(60)):
            b[r.randrange(len(b))] = r.choice("abc")
        b, most = "".join(b), r.randrange(20, 70)
        assert lines.banded(a, b, most) == min(edit(a, b), most + 1)
        assert not lines.few_changes(a, b, most) or edit(a, b) <= most


def test_lines_with_a_run_in_common_share_a_seed():
    r = random.Random(13)
    for run in (19, 31):
        for _ in range(200):
            common, a, b = ("".join(r.choice("ab ") for _ in range(n)) for n in (run, r.randrange(40), r.randrange(40)))
            seeds, owner, place = lines.seeds_of([a + common, common + b, "x"], run)
            one, two = ({(s, p) for s, o, p in zip(seeds.tolist(), owner.tolist(), place.tolist(), strict=True) if o == i} for i in (0, 1))
            assert {(s, p - len(a)) for s, p in one} & two


def test_changed_words_and_short_lines(spark):
    """Lines with changed words (one for each 40 characters at most) and short exact repeats; 2 edits and 16 characters found hardly any."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (2, 3, 4, 5, 6, 8, 10, 12, 14, 18, 25, 40, 60, 120, 250) for _ in range(3)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(5):
            words = r.choice(base).split()
            for _ in range(r.randrange(1 + max(1, len(words) // 9)) if len(words) > 3 else 0):
                words[r.randrange(len(words))] = word()
            out.append(" ".join(words))
        docs.append((i, "\n".join([*out, "", r.choice(["-", "Menu", "1.", f"only {i}"])])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.drop for x in lines.repeated_lines(df, share=0.1).collect()}
    occurrences = [(d, n, x) for d, t in docs for n, x in enumerate(lines.lines_of(t)) if x]
    distinct = sorted({x for _, _, x in occurrences})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wide = 0
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            most = min(len(a), len(b)) // 10
            if min(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= most and np.intersect1d(list(a), list(b)).size and (away := lines.banded(a, b, most)) <= most:
                wide += away > 2
                root[find(a)] = find(b)
    seen, want = set(), {d: [] for d, _ in docs}
    for d, n, x in occurrences:
        if find(x) in seen:
            want[d].append(n)
        seen.add(find(x))
    assert got == want and wide > 50


def test_large_groups_of_a_seed(spark):
    """Lines of one passage with different ends, among them near copies: with small parts the classes are those of one part."""
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8)))
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(40):
        start, end = [word() for _ in range(r.randrange(12))], [word() for _ in range(20)]
        docs.append(" ".join([*start, *passage, *end]))
        if r.random() < 0.5:
            end[r.randrange(20)] = word()
            docs.append(" ".join([*start, *passage, *end]))
    hot = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(hot)
        for _ in range(r.randrange(6)):
            copy[r.randrange(60)] = word()
        docs.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    members = lambda **sizes: sorted(map(sorted, classes_of(lines.line_classes(df, share=0.1, **sizes).collect())))

    def classes_of(rows):
        out = {}
        for row in rows:
            out.setdefault(row.component, []).append(row.id)
        return out.values()

    whole = members(cell=4096)
    assert len(whole) > 10 and max(map(len, whole)) > 40
    assert members(cell=8, meet=16) == whole
    assert members(cell=5, meet=7) == whole


def test_covered_keys_go(spark):
    """A key of many lines goes if another has them all and indexes them; of equal ones the least stays, small ones all do."""
    rows = [(k, i, 1) for k, n in ((7, 9), (3, 9), (5, 6), (6, 2)) for i in range(n)] + [(8, i, 1) for i in range(5, 12)] + [(1, i, 0) for i in range(20, 30)] + [(2, i, 1) for i in range(20, 25)]
    df = spark.createDataFrame(rows, "key long, id long, indexed int")
    assert {x.key for x in lines.without_covered(df, 4).select("key").distinct().collect()} == {3, 6, 8, 1, 2}


def spread(a, edits, r):
    """A copy with so many edits, spread evenly along the line."""
    b = list(a)
    for k in range(edits, 0, -1):
        at = k * len(a) // (edits + 1)
        b[at : at + r.choice((0, 1))] = r.choice(("#", "#%", "")) or []
    return "".join(b)


def test_no_pair_within_the_threshold_is_missed():
    """Edits anywhere, also evenly spread, on lines about every edge of bands and thresholds: the shorter one's index meets the other's keys."""
    r, pairs = random.Random(16), 0
    for n in (16, 19, 20, 24, 25, 29, 30, 36, 37, 39, 40, 49, 50, 60, 61, 76, 77, 96, 128, 150, 200, 233, 600, 1500):
        for _ in range(60):
            a = "".join(r.choice("abcdefg ") for _ in range(n))
            b = spread(a, r.randrange(1, 5), r)
            if r.random() < 0.5:
                a, b = b, a
            most = min(4, lines.allowed(min(len(a), len(b)), 0.1))
            if min(len(a), len(b)) < lines.MIN_CHARS or a == b or lines.banded(a, b, most) > most:
                continue
            pairs += 1
            keys, owner = lines.keys_of([a, b], 4, 0.1, (lines.MIN_CHARS, 1 << 62))
            of = lambda i, odd=None: {k for k, o in zip(keys.tolist(), owner.tolist(), strict=True) if o >> 1 == i and (odd is None or o & 1)}
            short = int(len(b) < len(a))
            assert of(short, 1) & of(1 - short)
    assert pairs > 600


def test_evenly_edited_lines_are_repeats(spark):
    """Classes equal brute force at production's threshold; lines of 60 to 600 characters with evenly spread edits among them."""
    r, docs = random.Random(17), []
    for n in (18, 33, 45, 60, 100, 128, 200, 300, 600):
        for _ in range(4):
            a = "".join(r.choice("abcdefghij ") for _ in range(n)).strip()
            docs += [a, *(spread(a, k, r).strip() for k in (1, 3, 4, 5, 9))]
    docs += ["", "-", "-"]
    r.shuffle(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    distinct = sorted({x for x in docs if x})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            most = min(4, lines.allowed(min(len(a), len(b)), 0.1))
            if min(len(a), len(b)) >= lines.MIN_CHARS and lines.banded(a, b, most) <= most:
                root[find(a)] = find(b)
    seen, want = set(), {}
    for i, x in enumerate(docs):
        want[i] = [0] if x and find(x) in seen else []
        seen |= {find(x)} if x else set()
    assert sum(map(len, want.values())) > 80
    for sizes in ({}, {"cell": 4, "meet": 6}):
        got = lines.line_classes(df, share=0.1, most=4, **sizes).collect()
        classes = {}
        for x in got:
            classes.setdefault(x.component, set()).add(x.id)
        by_text = {}
        for x in distinct:
            i = lines.line_id(x)
            by_text.setdefault(find(x), set()).add(i - (1 << 64) if i >> 63 else i)
        assert sorted(map(sorted, classes.values())) == sorted(sorted(x) for x in by_text.values() if len(x) > 1)
    assert {x.doc_id: x.drop for x in lines.repeated_lines(df, share=0.1, most=4).collect()} == want

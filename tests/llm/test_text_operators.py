"""Personal data, licences, mixing, fingerprints and toxicity against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from zephyrlake.llm import licenses, mixing, pii, spotsigs, toxicity

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return True


def spans(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if sound(k, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_base_spans_match_plain_search(spark):
    r = random.Random(5)
    bits = ["1", "2", "55", "4111 1111 1111 1111", "+1 (212) 555-1234", "a@b.c", "a@b.c_d@e.f", "x", "1.2.3.4", "300.1.1.1", ".", "-", " ", "@", "é", "😀", "+", "000.0.0.0001", "79927398713", "4539 1488 0343 6467", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(12)))) for i in range(800)] + [(9001, None), (9002, ""), (9003, "1" * 5000), (9004, "a" * 5000 + "@"), (None, "4111111111111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.b for x in pii.personal_data(df).select("doc_id", pii.written(F.col("base")).alias("b")).collect()}
    assert got == {d: spans(t or "") for d, t in rows}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    good = ["4111111111111111", "4539148803436467", "4012888888881881", "5555555555554444"]
    rows = [(i, f"some words here card number: {c} and more") for i, c in enumerate(good)] + [(9, "your card number: 4111111111111112 is off"), (10, "about 4111111111111112 things"), (9, "your card number: 4111111111111112 is off")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.doc_id, x.f) for x in pii.personal_data(df).select("doc_id", pii.written(F.col("found")).alias("f")).collect()]
    assert sorted(got) == sorted([(i, "") for i in range(4)] + [(9, "card:18:34"), (9, "card:18:34"), (10, "")])


def test_license_passages(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "words\nReleased under the MIT License.\nmore"), (2, "Intro. " + mit.replace("restriction", "limits")), (3, "all about software and public things"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3."), (1, "words\nReleased under the MIT License.\nmore")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = [(x.doc_id, sorted({y.license for y in x.licenses})) for x in licenses.license_scan(df).collect()]
    assert sorted(got) == sorted([(1, ["MIT notice"]), (2, ["MIT"]), (3, []), (4, []), (5, []), (6, ["GPL-3.0 notice"]), (1, ["MIT notice"])])


def test_telling_words_miss_nothing():
    """Any passage that reaches the threshold holds a telling word: without these words too few bigrams are left."""
    words = set(licenses.telling(licenses.TEMPLATES, licenses.THRESHOLD))
    for text in licenses.TEMPLATES.values():
        grams = licenses.bigrams(licenses.plain_words(text))
        free = sum(not words & set(g.split()) for g in grams)
        assert 2 * free / (len(grams) + free) < licenses.THRESHOLD


@pytest.fixture(scope="module")
def mix_rows():
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(0, 60))), r.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    return [*rows, (5000, None, "a"), (5001, "", "b"), (None, "one two", "c"), rows[0]]


def test_mix_meets_targets(spark, mix_rows):
    df = spark.createDataFrame(mix_rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).collect()
    assert len(got) == len(mix_rows)
    sizes = {}
    for _, t, s in mix_rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, rest, target = set(order), sum(sizes.values()), {}
    while new := {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}:
        for s in new:
            target[s] = 3 * sizes[s]
            rest -= target[s]
        open_ -= new
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        own = [x for x in got if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]}
        assert abs(own[0].target - target[s]) < 1e-6
        assert target[s] - 1 < sum(x.taken for x in own) <= target[s] + 1e-9
    assert all(x.taken <= 3 * x.size for x in got)
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(df).collect()), key=str) and key
    corpus = mixing.mixed_corpus(df).collect()
    assert sum(len((x.text or "").split()) for x in corpus) == sum(x.taken for x in got)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_edited_texts_and_fingerprints(spark):
    r = random.Random(7)
    vocabulary = ["the", "of", "and", "der", "la", "river", "stone", "äpfel", "cloud", "light", "😀sun"]
    rows = [(i * 3, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 80)))) for i in range(60)] + [(7, None), (8, ""), (1000, "ab"), (1001, "the the the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in spotsigs.edited_fingerprints(df).withColumn("fp", spotsigs.fingerprint(F.col("own"))).withColumn("near", spotsigs.likeness(F.col("own"), F.col("next_own"))).collect()}
    order = sorted(rows, key=lambda x: -x[0])
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)]
        k = len(t) // 3
        assert got[d].edited == t[: len(t) - k] + (following[1] or "")[:k]
        assert got[d].next_own == got[following[0]].own
    assert spotsigs.edited_fingerprints(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a stone of the light and cloud"), (2, "a stone of the light and cloud")], "doc_id long, text string")
    assert len({x.fp for x in spotsigs.edited_fingerprints(same).select(spotsigs.fingerprint(F.col("own")).alias("fp")).collect()}) == 1


def test_signatures_are_anchors_with_chains(spark):
    df = spark.createDataFrame([("The quick brown fox of the river stone fell by old mills",)], "text string")
    got = spotsigs.with_signatures(df, {"sig": "text"}).first().sig
    chains = [("the", "quick", "brown"), ("of", "river", "stone"), ("the", "river", "stone"), ("by", "old", "mills")]
    want = df.select(*[F.hash(F.lit(f"{spotsigs.MARK}{a} {b} {c}")) for a, b, c in chains]).first()
    assert got == sorted(want)


def test_near_pairs_match_brute_force(spark):
    r = random.Random(9)
    base = [[r.choice(["the", "of", "a"]) if i % 3 == 0 else f"w{r.randrange(400)}" for i in range(90)] for _ in range(12)]
    rows = []
    for i in range(60):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(90)] = f"x{r.randrange(99)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {x.doc_id: tuple(x.sig) for x in spotsigs.with_signatures(df, {"sig": "text"}).collect()}
    first = {}
    for d in sorted(sigs):
        first.setdefault(sigs[d], d)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(set(sigs[a]) & set(sigs[b])) >= 0.8 * len(set(sigs[a]) | set(sigs[b]))}
    assert {(x.a, x.b) for x in spotsigs.near_pairs(df).collect()} == want and want


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(11)
    words = ["stone", "river", "cloud", "light", "apple", "window", "garden", "paper"]
    docs, labels = [], []
    for i in range(600):
        bad = r.random() < 0.2
        text = [r.choice(words) for _ in range(r.randrange(5, 40))] + (["dreadful"] if bad else [])
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "x" * 5000), docs[0]], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (903, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = toxicity.scored(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    held = [x for x in got if x.held and x.doc_id in truth]
    assert held and all(x.predicted == truth[x.doc_id] for x in held)
    assert all(0 <= x.score <= 1 for x in got) and len(got) == 604
    assert {x.score for x in got if x.doc_id in (900, 901)} == {got[600].score}
    assert toxicity.fit(df, lab.limit(0)).bias == 0.0


def test_held_out_remainder(spark):
    import zlib

    ids = [*range(50), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", toxicity.held_out(F.col("doc_id")))
    assert {x.doc_id: x.h for x in df.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_empty_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

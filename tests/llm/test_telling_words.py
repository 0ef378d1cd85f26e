"""Telling words: what any passage that reaches a template holds is no word of every text."""

from zephyrlake.llm import licenses


def test_common_words_tell_nothing():
    """With "by" among them, four of ten texts were split and compared."""
    words = set(licenses.telling(licenses.TEMPLATES, licenses.THRESHOLD))
    assert not words & licenses.COMMON
    for text in licenses.TEMPLATES.values():
        grams = licenses.bigrams(licenses.plain_words(text))
        free = [g for g in grams if not words & set(g.split())]
        # What is free of telling words shares too few bigrams even if it has no others.
        assert 2 * len(free) / (len(free) + len(grams)) < licenses.THRESHOLD


def test_common_words_tell_where_there_are_no_others():
    assert set(licenses.telling({"x": "by the by and by"}, 0.8)) <= licenses.COMMON
    assert licenses.telling({"x": "by the by and by"}, 0.8)


def test_changed_notices_are_found(spark):
    notice = licenses.TEMPLATES["CC-BY-NC-4.0 notice"]
    words = notice.rstrip(".").split()
    texts = [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))] + [notice, "Sent by the office, under a new roof, for any of you."]
    grams = {n: set(licenses.bigrams(licenses.plain_words(t))) for n, t in licenses.TEMPLATES.items()}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    want = [max(dice(g, set(licenses.bigrams(licenses.plain_words(t)))) for g in grams.values()) >= 0.8 - 1e-9 for t in texts]
    rows = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [bool(r.licenses) for r in sorted(rows)] == want
    assert any(want) and not all(want)

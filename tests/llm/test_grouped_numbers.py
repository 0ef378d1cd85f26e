"""Phones and cards written in groups are learnt from and found by their contexts."""

from pyspark.sql import functions as F

from zephyrlake.llm import pii


def test_contexts_of_grouped_numbers(spark):
    rows = [(i, f"for more please call +1 ({740 + i}) 555-382{i} any day") for i in range(4)]
    rows += [(i + 10, f"pay with visa card {c} at once") for i, c in enumerate(["4111 1111 1111 1111", "4539 1488 0343 6467", "4012 8888 8888 1881", "5555 5555 5555 4444"])]
    unseen = {20: ("please call (743) 555-3824 now", "(743) 555-3824", "phone"), 21: ("please call 0171 555 1234 now", "0171 555 1234", "phone"), 22: ("use visa card 4111 1111 1111 1112 now", "4111 1111 1111 1112", "card"), 23: ("about (743) 555-3824 things", None, None)}
    df = spark.createDataFrame(rows + [(d, t) for d, (t, _, _) in unseen.items()], "doc_id long, text string")
    got = {x.doc_id: x.f for x in pii.personal_data(df).select("doc_id", pii.written(F.col("found")).alias("f")).collect()}
    want = {d: "" for d, _ in rows} | {d: f"{k}:{t.index(s)}:{t.index(s) + len(s)}" if s else "" for d, (t, s, k) in unseen.items()}
    assert got == want


def test_found_strings_are_seeds_of_further_contexts(spark):
    """Strings found behind one context teach another, behind which no base span stands."""
    texts = [f"mail address u{i}@site{i}.org" for i in range(12)] + [f"mail address bob{i}@intranet" for i in range(6)] + [f"contact handle bob{i}@intranet" for i in range(6)] + [f"contact handle new{i}@intranet" for i in range(3)] + [f"the road to x{i}@nowhere" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = lambda rounds: {x.doc_id for x in pii.personal_data(df, rounds=rounds).where(F.size("found") > 0).collect()}
    assert n(1) == set(range(12, 18)) and n(3) == set(range(12, 27))

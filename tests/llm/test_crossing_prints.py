"""Likeness of texts of which only one has few signatures, and key ranges under stretched keys."""

from pyspark.sql import functions as F

from zephyrlake.llm import mixing, spotsigs


def test_few_signatures_on_one_side(spark):
    """Two thirds of the text are the same: likeness shows it, though the edited text has few signatures and the text itself has enough."""
    plain = "stone river cloud light mountain forest harbour window garden bridge "
    text = plain * 3 + "the quick brown fox of the river stone fell by old mills in a large green valley"
    df = spark.createDataFrame([(2, text), (1, plain * 4), (0, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in spotsigs.edited_fingerprints(df).collect()}
    assert got[2].near_edited > 0.3 and 0 < got[2].near_next < 1
    assert got[1].near_edited < 1 and got[1].near_next == 0


def test_ranges_hold_few_rows_under_low_weights(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    key = -F.log(mixing.uniform(F.col("doc_id"), 17)) / 0.05
    largest = rows.select(F.floor(F.log2(key) * mixing.RANGES).alias("r")).groupBy("r").count().agg(F.max("count")).first()[0]
    assert largest < 60
    mix = mixing.mixed(rows, weight=F.lit(0.05))
    assert mix.agg(F.sum("taken")).first()[0] == 40_000


def test_likenesses_are_those_of_the_prints(spark):
    """Of every row of a table the likenesses are the Jaccard of the printed fingerprints."""
    import os

    import pytest

    from zephyrlake.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    rows = {x.doc_id: x for x in queries.op6_fingerprints(spark, sf).collect()}
    order = sorted(rows, reverse=True)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    of = lambda text: set(text.split())
    for i, d in enumerate(order):
        x, after = rows[d], rows[order[(i + 1) % len(order)]]
        assert abs(x.near_edited - jaccard(of(x.fingerprint), of(x.edited_fingerprint))) < 1e-12
        assert abs(x.near_next - jaccard(of(x.fingerprint), of(after.fingerprint))) < 1e-12
    assert sum(x.near_edited > x.near_next for x in rows.values()) > 0.95 * len(rows)

"""Attributions against Shapley values over all subsets; trained models, gates and folds."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrlake.operators import explain, models

NAMES = list("abcdef")


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select("id", *[F.rand(i).alias(c) for i, c in enumerate(NAMES)])
    y = 3 * F.col("a") + F.col("b") * F.col("c") * 4 - F.when(F.col("d") > 0.5, F.col("e")).otherwise(0.2)
    df = df.withColumns({"y": y, "y6": y * 2 + F.rand(9), "few": F.when(F.col("id") < 40, y)})
    split = F.when(F.col("id") < 600, "train").when(F.col("id") < 750, "validation").otherwise("test")
    return df.withColumn("split", split).withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a"))).cache()


def by_subsets(nodes, tree, x, m):
    """Shapley values of one tree: features outside a subset go both ways by their training rows."""

    def value(at, known):
        n = nodes[tree, at]
        if n.feature < 0:
            return n.value
        if n.feature in known:
            return value(n.left if x[n.feature] <= n.threshold else n.right, known)
        return sum(nodes[tree, c].rows / n.rows * value(c, known) for c in (n.left, n.right))

    out = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for k in range(m):
            for s in combinations(rest, k):
                out[i] += factorial(k) * factorial(m - k - 1) / factorial(m) * (value(0, {*s, i}) - value(0, set(s)))
    return out


@pytest.mark.parametrize("kind", ["random_forest", "gbt"])
def test_contributions_are_shapley_values(spark, rows, kind):
    model = models.trained(rows, NAMES, "y", kind)
    got = explain.contributions(rows.where("split = 'test'").select("id", *NAMES), model, NAMES).orderBy("id").collect()
    assert len(got) == 150
    for x in got:
        assert abs(x.base + sum(c.contribution for c in x.contributions) - x.p) < 1e-6
        assert [c.feature for c in x.contributions] == NAMES
    trees = model.stages[-1]
    table = {(n.tree, n.id): n for n in explain.node_table(spark, trees).collect()}
    weights = trees.treeWeights if kind == "gbt" else [1 / trees.getNumTrees] * trees.getNumTrees
    for x in got[:3]:
        v = [c.value for c in x.contributions]
        want = sum(w * by_subsets(table, t, v, 6) for t, w in enumerate(weights))
        assert np.allclose([c.contribution for c in x.contributions], want, atol=1e-8)


def test_summaries(spark):
    rows = [(1, [("a", 1.0, 3.0), ("b", 2.0, -1.0), ("c", 0.0, 0.0)]), (2, [("a", 1.0, -1.0), ("b", 2.0, -3.0), ("c", 0.0, 0.0)]), (3, [("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0)])]
    df = spark.createDataFrame(rows, f"id int, contributions {explain.PARTS}")
    got = {x.feature: tuple(x)[1:] for x in explain.importance(df).collect()}
    assert got == {"a": (0.667, 1.333, 50.0, 33.33, 33.33), "b": (-1.333, 1.333, 50.0, 0.0, 66.67), "c": (0.0, 0.0, 0.0, 0.0, 0.0)}
    own = {x.id: x for x in explain.drivers(df, 1).collect()}
    assert [(d.feature, d.share_pct, d.direction) for d in own[1].top_drivers] == [("a", 75.0, "positive")]
    assert [d.feature for d in own[2].negative_drivers] == ["b", "a"] and own[2].positive_drivers == [] and own[3].top_drivers == []
    assert explain.importance(df.limit(0)).count() == 0


def test_models_of_all_targets_and_horizons(rows):
    targets = {"y": {1: "y", 6: "y6"}, "few": {1: "few"}}
    fitted, gates = models.trained_all(rows, NAMES, targets)
    assert set(fitted) == {("y", h, k) for h in (1, 6) for k in ("random_forest", "gbt")}
    assert {(x.target, x.horizon): (x.n_train, x.n_validation, x.n_test, x.trained) for x in gates.collect()} == {("y", 1): (600, 150, 150, True), ("y", 6): (600, 150, 150, True), ("few", 1): (40, 0, 0, False)}
    said = models.answers(rows, fitted, targets, {"y": "a", "few": "a"})
    table = {(x.target, x.horizon, x.model): x for x in models.metrics(said).collect()}
    assert set(table) == {("y", h, k) for h in (1, 6) for k in ("persistence", "random_forest", "gbt")}
    whole = rows.where("split = 'test' and a is not null").count()
    for x in table.values():
        assert x.n_test == whole and 0 < x.test_mae <= x.test_rmse and 0.5 < x.test_coverage <= 1
    assert table["y", 1, "gbt"].test_r2 > 0.8 > table["y", 1, "persistence"].test_r2
    again, _ = models.trained_all(rows, NAMES, {"y": {1: "y"}}, kinds=("gbt",))
    first, second = (models.scored(m, rows).agg(F.sum("p")).first()[0] for m in (fitted["y", 1, "gbt"], again["y", 1, "gbt"]))
    assert first == second
    nothing, gates = models.trained_all(rows, NAMES, {"few": {1: "few"}})
    assert nothing == {} and models.answers(rows, nothing, targets, {"few": "a"}).count() == 0


def test_folds_never_train_on_what_follows(spark, rows):
    df = rows.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int), 0)"))
    parts = models.time_folds(df, "ts", 5, 12).groupBy("fold").agg(F.max(F.when(F.col("part") == "train", F.col("id"))).alias("a"), F.min(F.when(F.col("part") == "test", F.col("id"))).alias("b"), F.count_if(F.col("part") == "test").alias("n")).collect()
    assert sorted(x.fold for x in parts) == [1, 2, 3, 4, 5] and all(x.b - x.a == 13 for x in parts) and sum(x.n for x in parts) == 750
    scores = models.fold_scores(df, NAMES, "y", "ts", "gbt", 5, 12).orderBy("fold").collect()
    assert [x.n for x in scores] == [150] * 5 and scores[-1].mae < scores[0].mae

"""Feature attributions of fitted forests and boosted trees, and their summaries.

A model's node table, which Spark ML writes beside it, is bounded by trees times 2**depth whatever the rows; it
becomes one box per leaf (an interval of each feature on its path, with the share of training rows that go its way).
Rows are explained in Arrow batches: a leaf gives every row the same path weights as all rows that meet the same of
its intervals, so the recursion over path weights runs once for each such pattern of a batch. Contributions and the
base value add up to the prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephyrlake.sources.shared import shared_dir

PARTS = "array<struct<feature:string,value:double,contribution:double>>"


@dataclass(frozen=True)
class Leaf:
    """A leaf's value by its tree's weight, its features, the interval (low, high] of each, and the share of rows that each leaves on the path."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(spark: SparkSession, trees) -> DataFrame:
    """tree, id, feature (-1 at leaves), threshold, left, right, value, rows of a fitted tree model, as Spark ML saves it."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    trees.write().save(path)
    node, split = "nodeData", "nodeData.split"
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{node}.id").alias("id"), F.col(f"{split}.featureIndex").alias("feature"), F.try_element_at(F.col(f"{split}.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
        F.col(f"{node}.leftChild").alias("left"), F.col(f"{node}.rightChild").alias("right"), F.col(f"{node}.prediction").alias("value"), F.col(f"{node}.rawCount").cast("double").alias("rows"),
    )


def leaves_of(nodes: DataFrame, weights: list[float]) -> tuple[list[Leaf], float]:
    """All leaves, and the base value: the mean over training rows of each tree, by the trees' weights."""
    table = {(x.tree, x.id): x for x in nodes.collect()}  # bounded by the model
    leaves, base = [], 0.0
    for tree, weight in enumerate(weights):
        stack = [(table[tree, 0], {}, 1.0)]
        while stack:
            node, path, reach = stack.pop()
            if node.feature < 0:
                f = np.array(sorted(path), np.int64)
                box = np.array([path[i] for i in f.tolist()], float).reshape(-1, 3)
                leaves.append(Leaf(weight * node.value, f, box[:, 0], box[:, 1], box[:, 2]))
                base += weight * node.value * reach
                continue
            low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
            for child, a, z in ((node.left, low, min(high, node.threshold)), (node.right, max(low, node.threshold), high)):
                below = table[tree, child]
                part = below.rows / node.rows
                stack.append((below, path | {node.feature: (a, z, share * part)}, reach * part))
    return leaves, base


def path_weights(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """[pattern, feature]: each feature's contribution at a leaf of value 1, where ``met`` says which intervals hold.

    The weight of the subsets of each size grows feature by feature along the path; taking one feature out again
    gives the weight of the subsets without it.
    """
    m = len(share)
    one = met.astype(float)
    w = np.ones((len(met), 1))
    for j in range(m):
        k = np.arange(j + 1)
        longer = np.zeros((len(met), j + 2))
        longer[:, :-1] = share[j] * w * (j + 1 - k) / (j + 2)
        longer[:, 1:] += one[:, j : j + 1] * w * (k + 1) / (j + 2)
        w = longer
    out = np.empty((len(met), m))
    for j in range(m):
        hit, after, total = met[:, j], w[:, m].copy(), np.zeros(len(met))
        for k in range(m - 1, -1, -1):
            with_it = after * (m + 1) / (k + 1)
            without = w[:, k] / (share[j] * (m - k) / (m + 1))
            total += np.where(hit, with_it, without)
            after = np.where(hit, w[:, k] - with_it * share[j] * (m - k) / (m + 1), after)
        out[:, j] = total * (one[:, j] - share[j])
    return out


def explained(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """[row, feature]: contributions of every feature to every row's prediction."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not len(leaf.features):
            continue
        v = x[:, leaf.features]
        met = (v > leaf.low) & (v <= leaf.high)
        code = met @ (1 << np.arange(len(leaf.features), dtype=np.int64))
        patterns, first, which = np.unique(code, return_index=True, return_inverse=True)
        out[:, leaf.features] += leaf.value * path_weights(leaf.share, met[first])[which]
    return out


def contributions(df: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """Adds prediction p, base and contributions (feature, value as the model saw it, contribution) to every row.

    model: a pipeline whose last stage is a forest or boosted trees of single-threshold splits over a vector of
    ``features``. base plus all contributions is p. Rows, also repeated ones, stay; columns of these names go.
    """
    trees = model.stages[-1]
    weights = list(trees.treeWeights)
    weights = weights if isinstance(trees, GBTRegressionModel) else [w / sum(weights) for w in weights]
    leaves, base = leaves_of(node_table(df.sparkSession, trees), weights)
    keep = [c for c in df.columns if c not in ("p", "base", "contributions")]
    rows = model.transform(df.select(*keep)).select(*keep, F.col(trees.getPredictionCol()).alias("p"), vector_to_array(trees.getFeaturesCol()).alias("__x"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "base double", f"contributions {PARTS}"])
    kind = pa.struct([("feature", pa.string()), ("value", pa.float64()), ("contribution", pa.float64())])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("__x").flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(len(batch), len(features))
            names = pa.array(features * len(batch), pa.string())
            parts = pa.StructArray.from_arrays([names, flat.cast(pa.float64()), pa.array(explained(x, leaves).ravel())], fields=list(kind))
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(features))
            columns = [batch.column(c) for c in [*keep, "p"]] + [pa.array(np.full(len(batch), base)), pa.ListArray.from_arrays(ends, parts)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "p", "base", "contributions"])

    return rows.mapInArrow(explain, schema)


def importance(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """feature, mean_shap, mean_abs_shap, mean_abs_share_pct, pct_rows_positive, pct_rows_negative per key, from one aggregation over all rows."""
    keys = keys or []
    c = F.col("__x.contribution")
    rows = df.select(*keys, F.explode("contributions").alias("__x"))
    share = lambda holds: F.bround(100.0 * F.avg(holds.cast("double")), 2)
    out = rows.groupBy(*keys, F.col("__x.feature").alias("feature")).agg(F.avg(c).alias("m"), F.avg(F.abs(c)).alias("a"), share(c > 0).alias("pct_rows_positive"), share(c < 0).alias("pct_rows_negative"))
    total = F.sum("a").over(Window.partitionBy(*(keys or [F.lit(1)])))  # one row per feature
    return out.select(*keys, "feature", F.bround("m", 3).alias("mean_shap"), F.bround("a", 3).alias("mean_abs_shap"), F.bround(100.0 * F.col("a") / F.when(total != 0, total), 2).alias("mean_abs_share_pct"), "pct_rows_positive", "pct_rows_negative")


def drivers(df: DataFrame, most: int = 6) -> DataFrame:
    """Adds positive_drivers (largest first), negative_drivers (least first) and top_drivers (the ``most`` largest, with their direction), each with its share of all absolute contributions in per cent.

    Shares are null where a row has no contribution other than zero, which has no drivers.
    """
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + F.abs(x["contribution"]))
    rows = df.withColumn("__total", total)

    def listed(holds, order):
        shaped = F.transform(F.filter("contributions", holds), lambda x: F.struct(order(x).alias("o"), x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution")))
        pct = lambda x: F.bround(100.0 * F.abs(x["contribution"]) / F.when(F.col("__total") > 0, F.col("__total")), 2)
        way = lambda x: F.when(x["contribution"] > 0, "positive").otherwise("negative")
        return F.transform(F.array_sort(shaped), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), F.bround(x["contribution"], 4).alias("contribution"), pct(x).alias("share_pct"), way(x).alias("direction")))

    up = listed(lambda x: x["contribution"] > 0, lambda x: -x["contribution"])
    down = listed(lambda x: x["contribution"] < 0, lambda x: x["contribution"])
    top = F.slice(listed(lambda x: x["contribution"] != 0, lambda x: -F.abs(x["contribution"])), 1, most)
    return rows.withColumns({"positive_drivers": up, "negative_drivers": down, "top_drivers": top}).drop("__total")

"""Forecast models on Spark ML: forests and boosted trees for each target and horizon, held-out scores, and folds in time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrlake.operators import evaluate
from zephyrlake.operators.series import micros
from zephyrlake.sources.shared import shared_dir


def regressor(kind: str, target: str, predicted: str = "p", seed: int = 42):
    """An unfitted forest or boosted trees."""
    if kind == "random_forest":
        return RandomForestRegressor(labelCol=target, featuresCol="features", predictionCol=predicted, numTrees=20, maxDepth=8, seed=seed)
    if kind == "gbt":
        return GBTRegressor(labelCol=target, featuresCol="features", predictionCol=predicted, maxIter=20, maxDepth=4, seed=seed)
    raise ValueError(f"unknown kind of model: {kind}")


def vectors(features: list[str]) -> Pipeline:
    """Missing features take their training median; then all make one vector."""
    filled = [f"{c}__filled" for c in features]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")])


def trained(df: DataFrame, features: list[str], target: str, kind: str = "random_forest", seed: int = 42) -> PipelineModel:
    """A model of the training rows (column split) with a target; missing features take their training median."""
    rows = df.where((F.col("split") == "train") & F.col(target).isNotNull())
    return Pipeline(stages=[*vectors(features).getStages(), regressor(kind, target, seed=seed)]).fit(rows)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with prediction p."""
    return model.transform(df).select(*df.columns, "p")


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, largest first."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def side_by_side(jobs: list[Callable], parallel: int) -> list:
    """Runs the driver's side of several fits at once, so that small ones don't leave the cluster idle."""
    with ThreadPoolExecutor(max(1, min(parallel, len(jobs) or 1))) as pool:
        return list(pool.map(lambda f: f(), jobs))


def trained_all(df: DataFrame, features: list[str], targets: dict[str, dict[int, str]], kinds: tuple[str, ...] = ("random_forest", "gbt"), least_train: int = 100, least_test: int = 10, parallel: int = 4, seed: int = 42) -> tuple[dict[tuple[str, int, str], PipelineModel], DataFrame]:
    """One model per target, horizon and kind; and a row (target, horizon, n_train, n_validation, n_test, trained) for each target and horizon.

    targets: for each target the label column of each horizon. A pair with fewer than ``least_train`` training or
    ``least_test`` test rows with a label, or without a validation row, gets no model. Features are made a vector once
    and kept for all fits; the rows of all pairs are counted in one pass.
    """
    pairs = [(t, h, c) for t, own in targets.items() for h, c in own.items()]
    vector = vectors(features).fit(df.where("split = 'train'"))
    rows = vector.transform(df).select("split", "features", *dict.fromkeys(c for *_, c in pairs)).persist()
    names = ("train", "validation", "test")
    counts = rows.agg(*[F.count_if((F.col("split") == s) & F.col(c).isNotNull()).alias(f"{c}|{s}") for c in dict.fromkeys(c for *_, c in pairs) for s in names]).first()
    table = [(t, h, *[counts[f"{c}|{s}"] for s in names]) for t, h, c in pairs]
    fit = [(t, h, c, k) for (t, h, c), (*_, n, v, m) in zip(pairs, table, strict=True) if n >= least_train and v and m >= least_test for k in kinds]
    jobs = [lambda c=c, k=k: PipelineModel([*vector.stages, regressor(k, c, seed=seed).fit(rows.where((F.col("split") == "train") & F.col(c).isNotNull()))]) for _, _, c, k in fit]
    models = dict(zip([(t, h, k) for t, h, _, k in fit], side_by_side(jobs, parallel), strict=True))
    rows.unpersist()
    done = {(t, h) for t, h, _ in models}
    gates = df.sparkSession.createDataFrame([(*x, (x[0], x[1]) in done) for x in table], "target string, horizon int, n_train long, n_validation long, n_test long, trained boolean")
    return models, gates


def answers(df: DataFrame, models: dict[tuple[str, int, str], PipelineModel], targets: dict[str, dict[int, str]], last: dict[str, str]) -> DataFrame:
    """Columns of df, then target, horizon, model, y, p: the answers of persistence and of all models on the rows on which each of them has one.

    last: for each target the column with its last known value, which persistence repeats. Vectors are made once, the
    models answer side by side on them, and wide rows become long ones without a shuffle. Columns of these names go.
    """
    pairs = sorted({(t, h) for t, h, _ in models})
    if not pairs:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("target", "string"), ("horizon", "int"), ("model", "string"), ("y", "double"), ("p", "double"))]
        return df.where(F.lit(False)).select(*[c for c in df.columns if c not in ("target", "horizon", "model", "y", "p")], *none)
    rows = PipelineModel(next(iter(models.values())).stages[:-1]).transform(df)
    out = []
    for (t, h, k), model in models.items():
        rows = model.stages[-1].copy({model.stages[-1].predictionCol: f"__{t}_{h}_{k}"}).transform(rows)
    for t, h in pairs:
        kinds = {"persistence": F.col(last[t])} | {k: F.col(f"__{t}_{h}_{k}") for a, b, k in models if (a, b) == (t, h)}
        out.append(F.struct(F.lit(t).alias("target"), F.lit(h).alias("horizon"), F.col(targets[t][h]).cast("double").alias("y"), F.array(*[F.struct(F.lit(k).alias("model"), p.cast("double").alias("p")) for k, p in kinds.items()]).alias("a")))
    rows = rows.select(*df.columns, F.explode(F.array(*out)).alias("__x")).where(F.col("__x.y").isNotNull() & ~F.exists("__x.a", lambda a: a["p"].isNull()))
    rows = rows.withColumn("__a", F.explode("__x.a"))
    made = {"target": "__x.target", "horizon": "__x.horizon", "model": "__a.model", "y": "__x.y", "p": "__a.p"}
    return rows.select(*[c for c in df.columns if c not in made], *[F.col(c).alias(name) for name, c in made.items()])


def metrics(said: DataFrame, coverage: float = 0.85) -> DataFrame:
    """target, horizon, model, n_train, n_val, n_test, val_mae, test_mae, test_rmse, test_r2, test_mape, quantile, test_coverage from answers with their split: one row per model.

    quantile: half the width of the interval that held the given share of validation rows; test_coverage: the share of
    test rows within it.
    """
    keys = ["target", "horizon", "model"]
    per = evaluate.errors(said, [*keys, "split"])
    wide = per.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(name) for s, m, name in (
        ("train", "n", "n_train"), ("validation", "n", "n_val"), ("test", "n", "n_test"), ("validation", "mae", "val_mae"), ("test", "mae", "test_mae"), ("test", "rmse", "test_rmse"), ("test", "r2", "test_r2"), ("test", "mape", "test_mape"))])
    held = evaluate.conformal_linear(said.withColumn("r", F.col("y") - F.col("p")), keys, "split", coverage=coverage)
    return wide.join(held.select(*keys, "quantile", "test_coverage"), keys, "left")


def time_folds(df: DataFrame, ts: str, folds: int = 5, gap_hours: float = 0.0) -> DataFrame:
    """Rows of every fold with fold (from 1) and part: ``test`` in the fold's span of time, ``train`` in all earlier ones.

    Time between the first and the last row is cut into folds + 1 equal spans; span k is tested by what lies before
    it, less ``gap_hours`` so that labels which reach ahead don't leak. No training row lies after a test row.
    """
    edges = df.agg(F.min(micros(ts)).alias("__a"), F.max(micros(ts)).alias("__b"))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("__t", micros(ts))  # one row
    start = lambda k: F.col("__a") + F.floor((F.col("__b") - F.col("__a")) * k / (folds + 1))
    gap = int(gap_hours * 3_600_000_000)
    test = lambda k: (F.col("__t") >= start(k)) & ((F.col("__t") < start(k + 1)) | F.lit(k == folds))
    at = [F.when(test(k), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("part"))).when(F.col("__t") < start(k) - gap, F.struct(F.lit(k).alias("fold"), F.lit("train").alias("part"))) for k in range(1, folds + 1)]
    return rows.select(*df.columns, F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias("__f")).select(*df.columns, "__f.fold", "__f.part")


def fold_scores(df: DataFrame, features: list[str], target: str, ts: str, kind: str = "random_forest", folds: int = 5, gap_hours: float = 0.0, parallel: int = 4, seed: int = 42) -> DataFrame:
    """fold, n, mae, rmse, r2, mape, nmae on each fold's test rows, of models fitted side by side on what lies before them."""
    path = shared_dir(df.sparkSession, "folds")
    time_folds(df.where(F.col(target).isNotNull()), ts, folds, gap_hours).select(*features, target, "fold", "part").write.partitionBy("fold").parquet(path)
    rows = df.sparkSession.read.parquet(path)

    def answered(k: int) -> DataFrame | None:
        own = rows.where(F.col("fold") == k)
        train = own.where("part = 'train'")
        if train.isEmpty():
            return None
        return Pipeline(stages=[*vectors(features).getStages(), regressor(kind, target, seed=seed)]).fit(train).transform(own.where("part = 'test'")).select("fold", F.col(target).alias("y"), "p")

    found = [x for x in side_by_side([lambda k=k: answered(k) for k in range(1, folds + 1)], parallel) if x is not None]
    if not found:
        return evaluate.errors(rows.where(F.lit(False)).select("fold", F.col(target).alias("y"), F.col(target).alias("p")), ["fold"])
    said = found[0]
    for x in found[1:]:
        said = said.unionByName(x)
    return evaluate.errors(said, ["fold"])

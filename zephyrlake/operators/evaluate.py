"""Forecast evaluation: errors, category scores, conformal intervals, baselines and ablation differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrlake.functions import aqi


def errors(df: DataFrame, keys: list[str], actual: str = "y", predicted: str = "p") -> DataFrame:
    """n, mae, rmse, r2, mape, nmae per key over rows with both values, in one pass.

    r2 is 0 where the actual values don't vary, mape counts positive ones only and is 0 without any, nmae is 0
    at a mean of 0.
    """
    y, p = F.col(actual), F.col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("v"), F.avg(y).alias("m"), F.avg(F.when(y > 0, F.abs(y - p) / y)).alias("mape"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(0.0)
    return out.select(*keys, "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"), F.coalesce(100.0 * F.col("mape"), F.lit(0.0)).alias("mape"), F.when(F.col("m") != 0, F.col("mae") / F.col("m")).otherwise(0.0).alias("nmae"))


def answered_by_all(df: DataFrame, actual: str, models: dict[str, str]) -> DataFrame:
    """Columns of df, then model, y, p: one row per model for each row on which the actual value and every model's answer are there.

    models: the column of each model's answers. All models are compared on the same rows; they become long rows
    without a shuffle.
    """
    whole = df.where(F.col(actual).isNotNull())
    for c in models.values():
        whole = whole.where(F.col(c).isNotNull())
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    return whole.withColumn("__m", F.explode(each)).select(*df.columns, "__m.model", F.col(actual).cast("double").alias("y"), "__m.p")


def compared(df: DataFrame, keys: list[str], actual: str, models: dict[str, str], split: str | None = None, coverage: float = 0.85) -> DataFrame:
    """The errors of every model per key on the rows that all of them answer, from one aggregation; with a split also the interval of each.

    split: a column that says validation or test; errors are those of test rows, and quantile and test_coverage those of
    ``conformal_linear``.
    """
    rows = answered_by_all(df, actual, models)
    own = [*keys, "model"]
    if split is None:
        return errors(rows, own)
    held = conformal_linear(rows.withColumn("r", F.col("y") - F.col("p")), own, split, coverage=coverage)
    return errors(rows.where(F.col(split) == "test"), own).join(held.select(*own, "quantile", "test_coverage"), own, "left")


def category_scores(df: DataFrame, actual: str = "y", predicted: str = "p", strict: bool = False) -> DataFrame:
    """category, precision, recall, f1, support per index category.

    As it is reported: every sample of a category counts as a hit of it, wrong ones besides as a miss of it and
    a false hit of the predicted one. strict gives the textbook scores.
    """
    rows = df.select(aqi.gap_category(F.col(actual)).alias("t"), aqi.gap_category(F.col(predicted)).alias("p"))
    pairs = rows.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))  # at most the square of the labels
    wrong = F.col("t") != F.col("p")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("c"), (F.col("n") if not strict else F.when(~wrong, F.col("n")).otherwise(0)).alias("tp"), F.when(wrong, F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("support")), F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"), F.when(wrong, F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("support")))).alias("x")).select("x.*")
    out = sides.groupBy(F.col("c").alias("category")).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "support")])
    safe = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    precision, recall = safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("category", F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(safe(2 * precision * recall, precision + recall), 4).alias("f1"), "support")


def conformal_higher(df: DataFrame, keys: list[str], residual: str = "r", coverage: float = 0.85) -> DataFrame:
    """n, quantile, empirical_coverage per key: the absolute residual at position ceil(level * (n - 1)), level min(1, (n + 1) coverage / n)."""
    rows = df.where(F.col(residual).isNotNull()).withColumn("__a", F.abs(residual))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"__k": F.row_number().over(w.orderBy("__a")) - 1, "__n": F.count(F.lit(1)).over(w)})
    at = F.ceil(F.least(F.lit(1.0), (F.col("__n") + 1) * coverage / F.col("__n")) * (F.col("__n") - 1) - 1e-9)
    rows = rows.withColumn("__q", F.max(F.when(F.col("__k") == at, F.col("__a"))).over(w))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("__q").alias("quantile"), F.avg((F.col("__a") <= F.col("__q")).cast("double")).alias("empirical_coverage"))


def conformal_linear(df: DataFrame, keys: list[str], split: str, residual: str = "r", coverage: float = 0.85) -> DataFrame:
    """n_cal, quantile of the validation rows' absolute residuals, n_test and the share of test rows within it, per key."""
    rows = df.where(F.col(residual).isNotNull()).withColumn("__a", F.abs(residual))
    q = rows.where(F.col(split) == "validation").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cal"), F.percentile("__a", coverage).alias("quantile"))
    test = rows.where(F.col(split) == "test").join(q, keys)
    out = test.groupBy(*keys, "n_cal", "quantile").agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("__a") <= F.col("quantile")).cast("double")).alias("test_coverage"))
    return out.select(*keys, "n_cal", "quantile", "n_test", "test_coverage")


def intervals(df: DataFrame, q: DataFrame, keys: list[str], predicted: str = "p", low: float = 0.0, high: float = 1000.0, fallback: float = 60.0) -> DataFrame:
    """Predictions clipped to a range with lower and upper bounds a quantile away; ``fallback`` where a key has none."""
    rows = df.join(q.select(*keys, F.col("quantile").alias("__q")), keys, "left")
    width = F.coalesce("__q", F.lit(fallback))
    bound = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    return rows.select(*df.columns, bound(F.col(predicted) - width).alias("lower"), bound(F.col(predicted) + width).alias("upper"))


def baselines(df: DataFrame, keys: list[str], ts: str, value: str, split: str) -> DataFrame:
    """Test rows with two persistence baselines: the last training value of the key, and the value of the row before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = df.withColumn("lag1", F.lag(value).over(w))
    last = df.where(F.col(split) == "train").groupBy(*keys).agg(F.max_by(value, ts).alias("constant"))
    return rows.where(F.col(split) == "test").join(last, keys)


def ablation(scores: DataFrame, keys: list[str], metric: str, materiality: float = 0.005) -> DataFrame:
    """with minus without (column variant) of a metric per key, absolute and relative, and whether it matters."""
    out = scores.groupBy(*keys).agg(F.max(F.when(F.col("variant") == "with", F.col(metric))).alias("with"), F.max(F.when(F.col("variant") == "without", F.col(metric))).alias("without"))
    delta = F.col("with") - F.col("without")
    relative = delta / F.when(F.col("without") != 0, F.abs("without"))
    return out.select(*keys, "with", "without", delta.alias("delta"), relative.alias("relative"), F.coalesce(F.abs(relative) >= materiality, F.lit(False)).alias("material"))

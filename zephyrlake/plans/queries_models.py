"""Queries: trained models, their explanations, comparisons on the same rows and folds in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrlake.operators import evaluate, explain, models, series, training
from zephyrlake.plans import views as v
from zephyrlake.plans.queries_training import SPLIT
from zephyrlake.sources.shared import shared_dir

QUERIES, SQL = {}, {}
FEATURES = ["pm25", "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_mean6", "wind_speed", "pbl_height", "temperature", "humidity"]
HORIZONS = [1, 6]
TARGETS = {p: {h: f"{p}_t{h}" for h in HORIZONS} for p in ("pm25", "no2")}
METRICS = ("val_mae", "test_mae", "test_rmse", "test_r2", "test_mape", "quantile", "test_coverage")


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names, digits=6):
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def model_rows(spark, sf):
    """Lags, trailing means, weather, labels of both targets at all horizons, and the split in time.

    Written once and read again: a row per station and hour, which fits, counts, answers and scores read many times,
    each of which would go over all events and line items otherwise.
    """
    path = shared_dir(spark, "model_rows")
    derived_rows(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def derived_rows(spark, sf):
    """The rows of models as they follow from the tables."""
    rows = v.panel(spark, sf).where("pm25 is not null").select("station", "hour", "pm25", "no2")
    rows = series.lags(rows, ["station"], "hour", "pm25", [1, 3, 6])
    rows = series.trailing_stats(rows, ["station"], "hour", "pm25", [6])
    rows = rows.join(v.weather(spark, sf).withColumnRenamed("ts", "hour"), ["station", "hour"], "left")
    for target in TARGETS:
        rows = series.targets(rows, ["station"], "hour", target, HORIZONS)
    return series.chronological_split(rows, "hour", ["station"])


# ---- not expressible in SQL: trained models


def train_score(spark, sf, kind):
    rows = model_rows(spark, sf)
    out = models.scored(models.trained(rows, FEATURES, "pm25_t1", kind), rows.where("split = 'test' and pm25_t1 is not null"))
    return evaluate.errors(out, ["station"], "pm25_t1", "p")


@query(None)
def rf_train_score(spark, sf):
    return train_score(spark, sf, "random_forest")


@query(None)
def gbt_train_score(spark, sf):
    return train_score(spark, sf, "gbt")


@query(None)
def horizon_metrics(spark, sf):
    """Every target, horizon and model: held-out errors and intervals on the rows that all models of the pair answer."""
    rows = model_rows(spark, sf)
    fitted, _ = models.trained_all(rows, FEATURES, TARGETS)
    said = models.answers(rows, fitted, TARGETS, {t: t for t in TARGETS})
    return rounded(models.metrics(said), *METRICS)


@query(None)
def training_gates(spark, sf):
    """Rows of each split with a label, and whether the pair of target and horizon has enough to be trained."""
    return models.trained_all(model_rows(spark, sf), FEATURES, TARGETS, kinds=("random_forest",))[1]


@query(None)
def fold_scores(spark, sf):
    """Errors of each fold in time, six hours apart from what it is trained on."""
    out = models.fold_scores(model_rows(spark, sf), FEATURES, "pm25_t1", "hour", folds=4, gap_hours=6)
    return rounded(out, "mae", "rmse", "r2", "mape", "nmae")


def explained_rows(spark, sf):
    rows = model_rows(spark, sf)
    fitted = models.trained(rows, FEATURES, "pm25_t1", "gbt")
    return explain.contributions(rows.where("split = 'test' and pm25_t1 is not null").select("station", "hour", *FEATURES), fitted, FEATURES)


@query(None)
def shap_importance(spark, sf):
    """Mean, absolute mean, share and sign of each feature's contributions over all test rows."""
    return explain.importance(explained_rows(spark, sf))


@query(None)
def shap_drivers(spark, sf):
    """The six largest contributions to each test row's prediction, and the base they start from."""
    rows = explain.drivers(explained_rows(spark, sf))
    return rows.select("station", "hour", F.round("p", 4).alias("p"), F.round("base", 4).alias("base"), F.posexplode("top_drivers").alias("place", "d")).select("station", "hour", "p", "base", "place", "d.feature", "d.contribution", "d.share_pct", "d.direction")


# ---- the same rows for every model, folds


PSEUDO = "pr AS (SELECT *, lag(pm25) OVER w AS persistence, 2 * lag(pm25) OVER w - lag(pm25, 2) OVER w AS trend, avg(pm25) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS mean6 FROM s WHERE pm25 IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY hour)), al AS (SELECT * FROM pr WHERE persistence IS NOT NULL AND trend IS NOT NULL AND mean6 IS NOT NULL), st AS (" + " UNION ALL ".join(f"SELECT split, station, hour, '{m}' AS model, pm25 AS y, {m} AS p FROM al" for m in ("persistence", "trend", "mean6")) + "), q AS (SELECT model, quantile_cont(abs(y - p), 0.85) AS quantile FROM st WHERE split = 'validation' GROUP BY 1)"
ERRORS = "count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - p) * (y - p)) / var_pop(y) ELSE 0 END, 6) AS r2, round(coalesce(100 * avg(CASE WHEN y > 0 THEN abs(y - p) / y END), 0), 6) AS mape, round(CASE WHEN avg(y) <> 0 THEN avg(abs(y - p)) / avg(y) ELSE 0 END, 6) AS nmae"


def pseudo_forecasts(spark, sf):
    rows = training.split_by_span(v.panel(spark, sf), "hour").where("pm25 is not null").select("station", "hour", "pm25", "split")
    rows = series.lags(rows, ["station"], "hour", "pm25", [1, 2])
    w = series.ordered(["station"], "hour").rowsBetween(-6, -1)
    return rows.withColumns({"persistence": F.col("pm25_lag1"), "trend": 2 * F.col("pm25_lag1") - F.col("pm25_lag2"), "mean6": F.avg("pm25").over(w)})


@query(v.with_views("panel", more=f"{SPLIT}, {PSEUDO}") + f"SELECT x.*, round(q.quantile, 6) AS quantile, round(c.test_coverage, 6) AS test_coverage FROM (SELECT model, {ERRORS} FROM st WHERE split = 'test' GROUP BY 1) x LEFT JOIN q ON q.model = x.model LEFT JOIN (SELECT st.model, avg(CASE WHEN abs(y - p) <= q.quantile THEN 1.0 ELSE 0.0 END) AS test_coverage FROM st JOIN q ON q.model = st.model WHERE split = 'test' GROUP BY 1) c ON c.model = x.model")
def same_row_comparison(spark, sf):
    out = evaluate.compared(pseudo_forecasts(spark, sf), [], "pm25", {m: m for m in ("persistence", "trend", "mean6")}, "split")
    return rounded(out, "mae", "rmse", "r2", "mape", "nmae", "quantile", "test_coverage")


@query(v.with_views("panel", more=f"{SPLIT}, {PSEUDO}") + f"SELECT station, split, model, {ERRORS} FROM st GROUP BY 1, 2, 3")
def comparison_by_station(spark, sf):
    return rounded(evaluate.compared(pseudo_forecasts(spark, sf), ["station", "split"], "pm25", {m: m for m in ("persistence", "trend", "mean6")}), "mae", "rmse", "r2", "mape", "nmae")


@query(v.with_views("panel", more="e AS (SELECT min(epoch_us(hour)) AS a, max(epoch_us(hour)) AS b FROM panel WHERE pm25 IS NOT NULL), f AS (SELECT k AS fold, a + CAST(floor((b - a) * k / CAST(5 AS DOUBLE)) AS BIGINT) AS lo, a + CAST(floor((b - a) * (k + 1) / CAST(5 AS DOUBLE)) AS BIGINT) AS hi FROM e, generate_series(1, 4) g(k)), m AS (SELECT CAST(fold AS INT) AS fold, hour, CASE WHEN epoch_us(hour) >= lo AND (epoch_us(hour) < hi OR fold = 4) THEN 'test' WHEN epoch_us(hour) < lo - CAST(21600000000 AS BIGINT) THEN 'train' END AS part FROM panel, f WHERE pm25 IS NOT NULL)") + "SELECT fold, part, count(*) AS n, min(hour) AS first_hour, max(hour) AS last_hour FROM m WHERE part IS NOT NULL GROUP BY 1, 2")
def time_folds(spark, sf):
    rows = models.time_folds(v.panel(spark, sf).where("pm25 is not null"), "hour", 4, 6)
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))

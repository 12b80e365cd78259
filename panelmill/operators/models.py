"""Statistical and learned operators, through pyspark.ml where it has them."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.operators.metrics import assign_folds, capped_score


def standardise(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation of the fit rows; a deviation of 0 counts as 1 (M1)."""
    stats = (fit if fit is not None else df).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m_"), F.stddev_pop(c).alias(f"{c}_s_"))))
    out = df.join(F.broadcast(stats))
    return out.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"{c}_m_")) / F.when(F.col(f"{c}_s_") > 0, F.col(f"{c}_s_")).otherwise(1.0)).alias(c) for c in columns))


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df.fillna(0.0, columns))


def principal(df: DataFrame, columns: list[str], k: int, fit: DataFrame | None = None, log: bool = True) -> tuple[DataFrame, list[float]]:
    """``pc_1`` .. ``pc_k`` of centred columns, and the variance explained.

    Fitted on ``fit`` rows, applied to all; a component's sign is such that its largest loading is positive.
    """
    ready = lambda d: d.withColumns({c: F.coalesce(F.log1p(F.greatest(F.col(c), F.lit(0.0))) if log else F.col(c), F.lit(0.0)) for c in columns})
    own, base = ready(df), ready(fit if fit is not None else df)
    means = base.agg(*(F.avg(c).alias(c) for c in columns)).first()
    centre = lambda d: assemble(d.withColumns({c: F.col(c) - F.lit(means[c]) for c in columns}), columns)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(centre(base))
    load = model.pc.toArray()
    sign = [1.0 if load[np.argmax(np.abs(load[:, j])), j] >= 0 else -1.0 for j in range(k)]
    pcs = vector_to_array("pcs")
    out = model.transform(centre(own)).select(*(c for c in df.columns if c not in columns), *((pcs[j] * sign[j]).alias(f"pc_{j + 1}") for j in range(k)))
    return out, [float(v) for v in model.explainedVariance.toArray()]


def clusters(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """``cluster`` by k-means on standardised columns."""
    keep = [c for c in df.columns if c not in columns]
    ready = assemble(standardise(df, columns), columns)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(ready).transform(ready).select(*keep, "cluster")


def tweedie(train: DataFrame, columns: list[str], target: str, power: float = 1.3, weight: str | None = None):
    """Generalised linear regression with Tweedie loss, log link (M2, the exact loss)."""
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=target, featuresCol="features", regParam=1e-3, maxIter=25)
    return (glm.setWeightCol(weight) if weight else glm).fit(assemble(train, columns))


def boosted(train: DataFrame, columns: list[str], target: str, weight: str | None = None, seed: int = 29, **params):
    """Gradient-boosted trees, squared loss (M2, the shape; Spark has no Tweedie or monotone trees)."""
    gbt = GBTRegressor(labelCol=target, featuresCol="features", seed=seed, **{"maxDepth": 4, "maxIter": 20, **params})
    return (gbt.setWeightCol(weight) if weight else gbt).fit(assemble(train, columns))


def ridge(train: DataFrame, columns: list[str], target: str, alpha: float = 0.5):
    """Ridge regression on standardised columns (M7)."""
    n = max(train.count(), 1)
    return LinearRegression(labelCol=target, featuresCol="features", regParam=alpha / n, elasticNetParam=0.0, solver="normal").fit(assemble(train, columns))


def monotone_vector(columns: list[str], rising: set[str], falling: set[str] = frozenset()) -> list[int]:
    """1, -1 or 0 per column (M6), for learners that take such constraints; Spark's own trees take none."""
    return [(c in rising) - (c in falling) for c in columns]


def gains(spark: SparkSession, model, columns: list[str], name: str) -> DataFrame:
    """(model, feature, gain) of a fitted tree model (M8)."""
    return spark.createDataFrame([(name, c, float(g)) for c, g in zip(columns, model.featureImportances.toArray())], "model string, feature string, gain double")


def save(model, path: str) -> None:
    """Write a fitted model of any kind, through Spark, so that any store will do."""
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str):
    """A model that ``save`` wrote; its class is read from its metadata."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def ols(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, coefficient, std_error, t, p_value) of least squares on several columns, the intercept last (M9)."""
    fitted = LinearRegression(labelCol=target, featuresCol="features", solver="normal").fit(assemble(df, columns))
    s = fitted.summary
    values = zip([*columns, "(intercept)"], [*fitted.coefficients.toArray(), fitted.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)
    return df.sparkSession.createDataFrame([(n, *map(float, v)) for n, *v in values], "feature string, coefficient double, std_error double, t double, p_value double")


def validated(df: DataFrame, folds: list, learners: dict, columns: list[str], target: str, naive: str, month: str = "month") -> DataFrame:
    """(model, fold, score): each learner is fitted on a fold's training months and scored on its validation months.

    ``learners``: name to a function from training rows to a model, or None for column ``naive`` as it is. The folds' rows
    are filters of one table, which the caller writes out first if making it is dear.
    """
    out = None
    for fold in folds:
        own = assign_folds(df, [fold], month)
        train, valid = own.where("role = 'train'"), own.where("role = 'valid'")
        for name, fit in learners.items():
            guess = valid.withColumn("prediction", F.col(naive)) if fit is None else fit(train).transform(assemble(valid, columns))
            score = guess.agg(capped_score(target, "prediction").alias("score")).select(F.lit(name).alias("model"), F.lit(fold.name).alias("fold"), "score")
            out = score if out is None else out.unionByName(score)
    return out


def random_search(space: dict[str, Callable[[random.Random], object]], score: Callable[[dict], float], trials: int = 25, seed: int = 29) -> tuple[dict, float, list[dict]]:
    """Best of ``trials`` random settings, and the log of all (M3). ``score`` fits and validates; higher is better."""
    rng, log = random.Random(seed), []
    for i in range(trials):
        config = {k: draw(rng) for k, draw in space.items()}
        log.append({"trial": i, "config": config, "score": score(config)})
    best = max(log, key=lambda r: r["score"])
    return best["config"], best["score"], log


def sample_weight(month: str, first: str, last: str, weight: float = 1.8):
    """``weight`` within the months, else 1 (M5)."""
    return F.when(F.col(month).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(weight)).otherwise(F.lit(1.0))


def ensemble(predictions: DataFrame, on: list[str], prediction: str) -> DataFrame:
    """Mean of the models' predictions, cut at 0 (M4)."""
    return predictions.groupBy(*on).agg(F.greatest(F.avg(prediction), F.lit(0.0)).alias(prediction))


def trend(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2 per group by least squares (M9)."""
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, mean_abs_phi): |coefficient| times the mean distance from the mean."""
    means = df.agg(*(F.avg(c).alias(f"{c}_m_") for c in coefficients))
    rows = df.join(F.broadcast(means)).agg(*((F.avg(F.abs(F.col(c) - F.col(f"{c}_m_"))) * abs(b)).alias(c) for c, b in coefficients.items()))
    return rows.unpivot([], list(coefficients), "feature", "mean_abs_phi")


def cusum(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Greatest |cumulated residual| of the linear trend over sigma * sqrt(n) (M15); two parameters are fitted."""
    w = Window.partitionBy(group) if group else Window.partitionBy()
    e = F.col(y) - (F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * F.col(x))
    rows = df.where(F.col(y).isNotNull()).withColumn("e_", e)
    run = rows.withColumn("c_", F.sum("e_").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)))
    by = [group] if group else []
    return run.groupBy(*by).agg((F.max(F.abs("c_")) / (F.sqrt(F.sum(F.col("e_") * F.col("e_")) / (F.count("*") - 2)) * F.sqrt(F.count("*")))).alias("statistic"))


def kolmogorov_tail(statistic: float) -> float:
    """P(sup |bridge| > statistic)."""
    if statistic <= 0:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * statistic**2)), 0, 1))


def split_series(y: np.ndarray, least: int = 6, penalty: float = 3.0) -> list[int]:
    """Break points by binary segmentation with squared error: split while the gain exceeds penalty * ln n * variance."""
    n = len(y)
    s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y**2)])
    cost = lambda a, b: s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)
    limit = penalty * np.log(max(n, 2)) * (np.var(y) if n else 0.0)
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        gains = [(cost(a, b) - cost(a, t) - cost(t, b), t) for t in range(a + least, b - least + 1)]
        if gains and max(gains)[0] > limit > 0:
            t = max(gains)[1]
            out.append(t)
            todo += [(a, t), (t, b)]
    return sorted(out)


def breaks(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at, when): break points per series (M14). A series is one entity's months."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at = split_series(pdf[value].fillna(0.0).to_numpy(float))
        return pd.DataFrame({key: pdf[key].iloc[at].to_numpy(), "at": np.array(at, np.int32), "when": pdf[order].iloc[at].to_numpy()})

    kind, when = dict(df.dtypes)[key], dict(df.dtypes)[order]
    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, at int, when {when}")


def factorise(matrix: np.ndarray, k: int = 5, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors by multiplicative updates (M13); for small matrices such as months x keywords."""
    rng = np.random.default_rng(seed)
    a, b = rng.random((matrix.shape[0], k)) + 0.1, rng.random((k, matrix.shape[1])) + 0.1
    for _ in range(rounds):
        b *= (a.T @ matrix) / np.maximum(a.T @ a @ b, 1e-12)
        a *= (matrix @ b.T) / np.maximum(a @ b @ b.T, 1e-12)
    return a, b


def topics(wide: DataFrame, time: str, columns: list[str], k: int = 5, most: int = 100_000) -> DataFrame:
    """(time, topic, weight) of a small wide table of one row per time (M13); refuses more than ``most`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            n += len(batch)
            if n > most:
                raise ValueError(f"more than {most} rows to factorise")
            held.append(batch)
        pdf = pd.concat(held).sort_values(time)
        a, _ = factorise(pdf[columns].fillna(0.0).clip(lower=0).to_numpy(float), k)
        yield pd.DataFrame([{time: t, "topic": j, "weight": w} for t, row in zip(pdf[time], a) for j, w in enumerate(row)])

    return wide.select(time, *columns).coalesce(1).mapInPandas(run, f"{time} {dict(wide.dtypes)[time]}, topic int, weight double")


def seasonal_forecast(df: DataFrame, key: str, value: str, horizon: int, season: int = 12, month: str = "month") -> DataFrame:
    """(key, month, forecast): the value a season ago plus the mean yearly step of the last season (M16's stand-in)."""
    w = Window.partitionBy(key).orderBy(F.desc(month))
    tail = df.select(key, month, value, F.row_number().over(w).alias("age")).where(F.col("age") <= 2 * season)
    step = F.avg(F.when(F.col("age") <= season, F.col(value))) - F.avg(F.when(F.col("age") > season, F.col(value)))
    base = tail.groupBy(key).agg(step.alias("step"), F.max(month).alias("last"), F.sort_array(F.collect_list(F.when(F.col("age") <= season, F.struct("age", value)))).alias("year"))
    ahead = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    back = F.get(F.col("year"), season - 1 - F.pmod(F.col("h") - 1, F.lit(season)))[value]
    return ahead.select(key, F.add_months("last", F.col("h")).alias(month), F.greatest(back + F.coalesce("step", F.lit(0.0)) * F.ceil(F.col("h") / season), F.lit(0.0)).alias("forecast"))

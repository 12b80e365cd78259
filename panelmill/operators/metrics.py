"""Forecast scores and fold tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ape(truth: Column, guess: Column, floor: float = 1e-9) -> Column:
    return F.abs(truth - guess) / F.greatest(F.abs(truth), F.lit(floor))


def capped_score(truth: str, guess: str) -> Column:
    """Mean of 1 - APE where APE is at most 1, else 0; predictions cut at 0, divisors of at least 1 where truth is not
    positive, null truth left out, a missing prediction scored 0; in 0..1, and 0 without rows (A16a)."""
    y, p = F.col(truth), F.when(F.col(guess).isNotNull(), F.greatest(F.col(guess), F.lit(0.0)))
    error = F.abs(y - p) / F.when(y > 0, y).otherwise(F.lit(1.0))
    mean = F.avg(F.when(y.isNotNull(), F.when(error <= 1, 1 - error).otherwise(F.lit(0.0))))
    return F.coalesce(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def two_stage_score(truth: str, guess: str, floor: float = 1e-9, clip: bool = False) -> Column:
    """0 if over 30 % of APEs exceed 1, else 1 - mean of the others over their share."""
    y, p = F.col(truth), F.col(guess)
    error = F.when(y.isNotNull(), ape(y, p, floor))
    bad = F.avg(F.when(error.isNotNull(), (error > 1).cast("double")))
    mean = F.avg(F.when(error <= 1, error))
    score = F.when(bad.isNull() | (bad > 0.30), F.lit(0.0)).otherwise(1 - mean / (1 - bad))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) if clip else score


def regression(truth: str, guess: str) -> list[Column]:
    """mae, rmse, mape, smape, r2 in one aggregate."""
    y, p = F.col(truth), F.col(guess)
    ok = y.isNotNull() & p.isNotNull()
    e = F.when(ok, p - y)
    sst = F.var_pop(F.when(ok, y))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1e-6))).alias("mape"),
        F.avg(2 * F.abs(e) / (F.abs(y) + F.abs(p) + 1e-6)).alias("smape"),
        (1 - F.try_divide(F.avg(e * e), sst)).alias("r2"),
    ]


def error_shares(truth: str, guess: str) -> list[Column]:
    """Shares of APEs up to 1 and over 1, zero truths left out."""
    y = F.col(truth)
    error = F.when(y.isNotNull() & (y != 0), ape(y, F.col(guess)))
    return [F.avg(F.when(error.isNotNull(), (error <= 1).cast("double"))).alias("d_ratio"), F.avg(F.when(error.isNotNull(), (error > 1).cast("double"))).alias("ape_gt1_ratio")]


class ScoreEvaluator(Evaluator):
    """The capped score as an ML evaluator."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(capped_score(self.label, self.prediction)).first()[0])

    def isLargerBetter(self) -> bool:
        return True


@dataclass(frozen=True)
class Fold:
    """Validation months; training ends before the purged months that precede them."""

    name: str
    first: str
    last: str
    purge: int = 1


def expanding_folds(last: str, folds: int, months: int, purge: int = 1) -> list[Fold]:
    """``folds`` consecutive validation spans of ``months``, the last ending in month ``last``."""
    y, m = map(int, last.split("-")[:2])
    end = y * 12 + m - 1
    at = lambda i: f"{i // 12:04d}-{i % 12 + 1:02d}-01"
    return [Fold(f"fold_{k + 1}", at(end - (folds - k) * months + 1), at(end - (folds - k - 1) * months), purge) for k in range(folds)]


def assign_folds(df: DataFrame, folds: list[Fold], month: str = "month") -> DataFrame:
    """A row per (row, fold, role), role train, purge or valid (C24); the fold list is exploded in place, not joined."""
    rows = []
    for f in folds:
        first, last = F.lit(f.first).cast("date"), F.lit(f.last).cast("date")
        cut = F.add_months(first, -f.purge)
        role = F.when(F.col(month) < cut, "train").when(F.col(month) < first, "purge").when(F.col(month) <= last, "valid")
        rows.append(F.struct(F.lit(f.name).alias("fold"), role.alias("role")))
    return df.select("*", F.inline(F.array(*rows))).where(F.col("role").isNotNull())


def importance(df: DataFrame, model: str, feature: str, value: str, n: int = 50) -> DataFrame:
    """Importances normalised per model, summed per feature, the top ``n``."""
    share = F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(model)))
    return df.withColumn("s_", share).groupBy(feature).agg(F.sum("s_").alias("importance")).orderBy(F.desc("importance"), feature).limit(n)


def best_of_folds(scores: DataFrame) -> DataFrame:
    """(model, fold, score) with mean_score per model, best_model and best_fold, its fold of greatest score (A21); ties by name.

    A row per model and fold: a table of a few dozen rows.
    """
    means = scores.groupBy("model").agg(F.avg("score").alias("mean_score"), F.max_by("fold", F.struct("score", F.transform(F.split("fold", ""), lambda c: -F.ascii(c)))).alias("top_"))
    best = means.orderBy(F.desc("mean_score"), "model").limit(1).select(F.col("model").alias("best_"))
    out = scores.join(F.broadcast(means), "model").join(F.broadcast(best))
    return out.select("model", "fold", "score", "mean_score", (F.col("model") == F.col("best_")).alias("best_model"), (F.col("fold") == F.col("top_")).alias("best_fold"))

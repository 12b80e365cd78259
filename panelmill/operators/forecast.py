"""Recursive forecasts: each month's prediction becomes history for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recursive_forecast(panel: DataFrame, target: str, key: str, months: list[str], features: Callable[[DataFrame], DataFrame], predict: Callable[[DataFrame, str], DataFrame], cut: Callable[[DataFrame], DataFrame], tail: int = 13, month: str = "month") -> DataFrame:
    """(key, month, prediction) for every horizon month.

    ``features`` derives columns from a panel; ``predict`` gets the month's rows and its name and adds ``prediction``
    (it may refit there: a walk-forward run). Only the last ``tail`` months are carried through the features. ``cut``
    ends the lineage of a small table each step, by writing it out or by checkpoint().
    """
    first = F.lit(months[0]).cast("date")
    known = panel.where((F.col(month) < first) & (F.col(month) >= F.add_months(first, -tail)))
    blank = panel.where(F.col(month) >= first).withColumn(target, F.lit(None).cast("double"))
    done = None
    for m in months:
        now = F.lit(m).cast("date")
        window = known.where(F.col(month) >= F.add_months(now, -tail)).unionByName(blank.where(F.col(month) == now))
        got = cut(predict(features(window).where(F.col(month) == now), m).select(key, month, F.greatest("prediction", F.lit(0.0)).alias("prediction")))
        row = blank.where(F.col(month) == now).join(got, [key, month], "left").withColumn(target, F.coalesce("prediction", target)).drop("prediction")
        known = cut(known.unionByName(row))
        done = got if done is None else done.unionByName(got)
    return done


def submission(sample: DataFrame, predictions: DataFrame, on: str = "id") -> DataFrame:
    """Predictions in the sample's rows (J10); fails, when run, on a row without one."""
    out = sample.select(on).join(predictions, on, "left")
    ok = F.when(F.col("prediction").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(on))).cast("double")).otherwise(F.col("prediction"))
    return out.select(on, ok.alias("prediction"))

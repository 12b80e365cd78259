"""Cross-sections of a month: weighted means, shares, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions.columns import mean_across
from panelmill.operators.windows import SMALL


def weight(population: str, scale: str) -> Column:
    """Population if positive, else the scale if positive, else 1."""
    return F.when(F.col(population) > 0, F.col(population)).when(F.col(scale) > 0, F.col(scale)).otherwise(F.lit(1.0))


def weighted_share(df: DataFrame, columns: list[str], weights: Column, month: str = "month") -> DataFrame:
    """``x_wmean`` and ``x_share`` per month (A6, W15): one aggregate, joined back.

    A null value leaves the numerator only. A null mean falls back to the month's mean, the overall mean, then 0;
    shares that are undefined are 0.
    """
    w = df.withColumn("w_", weights)
    sums = w.groupBy(month).agg(*(x for c in columns for x in (F.try_divide(F.coalesce(F.sum(F.col(c) * F.col("w_")), F.lit(0.0)), F.sum("w_")).alias(f"{c}_a_"), F.avg(c).alias(f"{c}_b_"))))
    overall = df.agg(*(F.avg(c).alias(f"{c}_c_") for c in columns))
    out = df.join(F.broadcast(sums.join(F.broadcast(overall))), month, "left")
    mean = {c: F.coalesce(f"{c}_a_", f"{c}_b_", f"{c}_c_", F.lit(0.0)) for c in columns}
    made = [x for c in columns for x in (mean[c].alias(f"{c}_wmean"), F.coalesce(F.col(c) / (mean[c] + SMALL), F.lit(0.0)).alias(f"{c}_share"))]
    return out.select(*df.columns, *made)


def group_gap(df: DataFrame, column: str, group: list[str]) -> DataFrame:
    """Value less the mean of its group (C19: an entity against those nearby)."""
    near = F.avg(column).over(Window.partitionBy(*group))
    return df.select("*", near.alias(f"{column}_nearby"), (F.col(column) - near).alias(f"{column}_minus_nearby"))


def density_search(df: DataFrame, densities: list[str], scores: list[str]) -> DataFrame:
    """``x_x_search``: each density times the mean of the search scores (C20); null scores are left out of the mean."""
    return df.select("*", *((F.col(c) * mean_across(scores)).alias(f"{c}_x_search") for c in densities))


def row_shares(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Each of ``columns`` as a share of their sum; 0 where the sum is 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return wide.select(*(c for c in wide.columns if c not in columns), *(F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), total), F.lit(0.0)).alias(c) for c in columns))

"""Keyword logs: long to wide, smoothing, shares and derived series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.windows import bfill, ffill, pct_change, rolling


def totals(log: DataFrame, time: str, keyword: str, volume: str) -> DataFrame:
    """Sum over sources per time and keyword (A1); rows without key go."""
    return log.na.drop(subset=[time, keyword]).groupBy(time, keyword).agg(F.sum(volume).alias(volume))


def top_keywords(log: DataFrame, keyword: str, volume: str, n: int = 30) -> DataFrame:
    """The ``n`` keywords of greatest variance (A7, O3); ties by name."""
    return log.groupBy(keyword).agg(F.var_pop(volume).alias("variance")).orderBy(F.desc("variance"), keyword).limit(n)


def pivot(long: DataFrame, time: str, keyword: str, volume: str, names: list[str]) -> DataFrame:
    """One column per name (A12); the names are given, so no scan is spent to find them."""
    return long.groupBy(time).pivot(keyword, names).agg(F.sum(volume))


def smooth(wide: DataFrame, columns: list[str], time: str) -> DataFrame:
    """Forward, then backward fill, then mean of the last three with this one, then 0 (W22). One row per time."""
    w = Window.orderBy(time)
    filled = wide.select(time, *(F.coalesce(ffill(c, w), bfill(c, w)).alias(c) for c in columns))
    return filled.select(time, *(F.coalesce(rolling(c, 3, "mean", w, 1, True), F.lit(0.0)).alias(c) for c in columns))


def shares(long: DataFrame, time: str, keyword: str, volume: str) -> DataFrame:
    """Share of each keyword in its time's total."""
    total = F.sum(volume).over(Window.partitionBy(time))
    return long.select(time, keyword, volume, F.coalesce(F.try_divide(F.col(volume), total), F.lit(0.0)).alias("share"))


def derived(wide: DataFrame, columns: list[str], time: str) -> DataFrame:
    """lag 1, mean of the previous three, change, z-score per keyword (C21). One row per time."""
    w = Window.orderBy(time)
    made = []
    for c in columns:
        mean, std = rolling(c, 3, "mean", w), rolling(c, 3, "std", w)
        made += [F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)).alias(f"{c}_lag_1"), F.coalesce(mean, F.lit(0.0)).alias(f"{c}_mean_3"), F.coalesce(pct_change(c, 1, w), F.lit(0.0)).alias(f"{c}_pct_1"), F.coalesce((F.col(c) - mean) / (std + 1e-6), F.lit(0.0)).alias(f"{c}_z_3")]
    return wide.select(time, *made)


def uncorrelated(wide: DataFrame, ranked: list[str], n: int = 12, limit: float = 0.98) -> list[str]:
    """Greedy choice in the given order, skipping columns correlated over ``limit`` with one chosen.

    All pairs are one aggregate; only their few numbers reach the driver.
    """
    pairs = [(a, b) for i, a in enumerate(ranked) for b in ranked[:i]]
    if not pairs:
        return ranked[:n]
    got = wide.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    r = {p: got[str(i)] for i, p in enumerate(pairs)}
    out: list[str] = []
    for c in ranked:
        if len(out) < n and all(r[c, o] is None or abs(r[c, o]) <= limit for o in out):
            out.append(c)
    return out


def folds_of_months(df: DataFrame, time: str, n: int = 3) -> DataFrame:
    """Distinct times in ``n`` runs of near equal length, longer ones first."""
    return df.select(time).distinct().select(time, F.ntile(n).over(Window.orderBy(time)).alias("bucket"))  # few rows: distinct times


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 8) -> DataFrame:
    """(column, mi) by quantile bins, in nats (C22, M17). Binned, not by neighbours: it stays one aggregate per column set.

    Constant columns have 0.
    """
    edges = df.agg(*(F.array_distinct(F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000)).alias(c) for c in [*columns, target]))
    cut = df.join(F.broadcast(edges.select(*(F.col(c).alias(f"{c}_e_") for c in [*columns, target]))))
    bin_of = lambda c: F.size(F.filter(f"{c}_e_", lambda e: e < F.col(c)))
    long = cut.where(F.col(target).isNotNull()).select(bin_of(target).alias("t_"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), bin_of(c)).alias("b_")) for c in columns)))).where("b_ is not null")
    joint = long.groupBy("column", "b_", "t_").agg(F.count("*").alias("n"))
    by_b, by_t, all_ = Window.partitionBy("column", "b_"), Window.partitionBy("column", "t_"), Window.partitionBy("column")
    terms = joint.select("column", "n", F.sum("n").over(by_b).alias("nb"), F.sum("n").over(by_t).alias("nt"), F.sum("n").over(all_).alias("na"))
    return terms.groupBy("column").agg(F.greatest(F.sum(F.col("n") / F.col("na") * F.log(F.col("n") * F.col("na") / (F.col("nb") * F.col("nt")))), F.lit(0.0)).alias("mi"))


def informative(df: DataFrame, columns: list[str], target: str, time: str, n: int = 12, folds: int = 3) -> DataFrame:
    """(column, mi): the ``n`` columns of greatest mean mutual information over the folds of months but the first."""
    own = df.join(F.broadcast(folds_of_months(df, time, folds)), time)  # a row per month
    scores = None
    for k in range(2, folds + 1):
        one = mutual_information(own.where(F.col("bucket") == k), columns, target)
        scores = one if scores is None else scores.unionByName(one)
    return scores.groupBy("column").agg(F.avg("mi").alias("mi")).orderBy(F.desc("mi"), "column").limit(n)

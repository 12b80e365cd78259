"""Feature plans: ordered stages of columns, a catalogue of what each made, and budget and guard passes over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import log1p_feature
from panelmill.operators.windows import growth, lags, rolled, series, zscore


@dataclass
class FeaturePlan:
    """Stages are functions from a frame to new columns; each becomes one projection."""

    stages: list[tuple[str, Callable[[DataFrame], list[Column]]]] = field(default_factory=list)
    catalogue: dict[str, list[str]] = field(default_factory=dict)

    def stage(self, category: str, make: Callable[[DataFrame], list[Column]]) -> "FeaturePlan":
        self.stages.append((category, make))
        return self

    def build(self, df: DataFrame) -> DataFrame:
        for category, make in self.stages:
            before = set(df.columns)
            df = df.select("*", *make(df))
            self.catalogue.setdefault(category, []).extend(c for c in df.columns if c not in before)
        return df

    def drop(self, df: DataFrame, names: set[str]) -> DataFrame:
        for own in self.catalogue.values():
            own[:] = [c for c in own if c not in names]
        return df.drop(*names)

    def guard(self, df: DataFrame, bases: list[str]) -> DataFrame:
        """Drop derived columns of the given base columns; lags stay (C14)."""
        gone = {c for own in self.catalogue.values() for c in own for b in bases if c.startswith(f"{b}_") and "_lag_" not in c}
        return self.drop(df, gone)

    def budget(self, df: DataFrame, most: int, order: tuple[str, ...] = ("_log1p", "_std_", "_z_")) -> DataFrame:
        """Drop columns, by name patterns in the given order and then from the end, until at most ``most`` are left."""
        names = [c for own in self.catalogue.values() for c in own]
        ranked = [c for p in order for c in names if p in c] + names[::-1]
        gone: set[str] = set()
        for c in ranked:
            if len(names) - len(gone) <= most:
                break
            gone.add(c)
        return self.drop(df, gone)

    def inventory(self, least: int = 0, most: int | None = None) -> dict[str, int]:
        """Columns per category; raises outside the bounds (C17)."""
        counts = {k: len(v) for k, v in self.catalogue.items()}
        total = sum(counts.values())
        if total < least or (most is not None and total > most):
            raise ValueError(f"{total} features; allowed are {least} to {most}")
        return counts


def standard_plan(columns: list[str], key: str, month: str = "month") -> FeaturePlan:
    """Lags, rolling statistics, growth, z-scores and logarithms over one shared window."""
    w = series(key, month)
    return (
        FeaturePlan()
        .stage("lags", lambda df: lags(columns, (1, 3, 6, 12), w))
        .stage("rolling", lambda df: rolled(columns, (3, 6, 12), ("mean", "std"), w, 2))
        .stage("growth", lambda df: [growth(c, k, w).alias(f"{c}_growth_{k}") for c in columns for k in (1, 3)])
        .stage("zscore", lambda df: [zscore(c, 3, w).alias(f"{c}_z_3") for c in columns])
        .stage("log1p", lambda df: [log1p_feature(c) for c in columns])
    )


def category_counts(plan: FeaturePlan, df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(plan.inventory().items()), "category string, n long").orderBy(F.col("category"))

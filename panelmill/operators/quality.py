"""Data-quality suite: profiles, anomalies, coverage, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share) of columns with nulls: one aggregate for all (A10)."""
    counts = df.agg(F.count("*").alias("n_"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.unpivot(["n_"], columns, "column", "missing").where("missing > 0").select("column", "missing", F.try_divide("missing", "n_").alias("share"))


def negatives(df: DataFrame, ids: list[str], columns: list[str], table: str) -> DataFrame:
    """A row per negative value."""
    long = df.unpivot(ids, columns, "column", "value").where("value < 0")
    return long.select(*ids, "value", "column", F.lit("negative").alias("issue"), F.lit(table).alias("source_table"))


def missing_months(df: DataFrame, key: str, month: str = "month") -> DataFrame:
    """(key, month) that no row has, within the table's span."""
    from panelmill.operators.spine import spine

    return spine(df, key, month).join(df.select(key, month), [key, month], "left_anti")


def profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, distinct, min, max, mean and deviation per key."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys held by several rows (S3)."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose size or SHA-256 differs from the manifest (S13). ``files``: format binaryFile; manifest: name, size, sha256."""
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("seen_size"), F.sha2("content", 256).alias("seen_sha256"))
    bad = ~(F.col("size").eqNullSafe(F.col("seen_size")) & F.col("sha256").eqNullSafe(F.col("seen_sha256")))
    return manifest.join(seen, "name", "left").where(bad)

"""Exact quantiles by selection: no task gathers the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = float("-inf"), float("inf")


def exact_quantile(df: DataFrame, column: str, q: float = 0.5, by: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """(by..., value, n): the interpolated quantile of the non-null values of each group, and their number.

    A mergeable sketch brackets the quantile between two values whose ranks surely enclose it; values outside the
    bracket only count, and what lies inside is counted value by value before one task
    sees it: some 4 / ``accuracy`` of a group's distinct values. Without a group, an empty table gives one null row.
    """
    by, margin = by or [], 2.0 / accuracy
    known = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x_"))
    ends = known.groupBy(*by).agg(F.percentile_approx("x_", [max(q - margin, 0.0), min(q + margin, 1.0)], accuracy).alias("e_"))
    if by:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        rows = known.alias("a").join(ends.alias("b"), same).select(*(F.col(f"a.{c}") for c in by), "x_", "e_")
    else:
        rows = known.join(F.broadcast(ends))  # one row
    cut = F.when(F.col("x_") < F.col("e_")[0], F.lit(LOW)).when(F.col("x_") > F.col("e_")[1], F.lit(HIGH)).otherwise(F.col("x_"))
    # those outside stand by their value next to the bracket, with which the quantile may be interpolated
    counts = rows.groupBy(*by, cut.alias("v_")).agg(F.count("*").alias("c_"), F.min("x_").alias("least_"), F.max("x_").alias("most_"))
    counts = counts.withColumn("v_", F.when(F.col("v_") == LOW, F.col("most_")).otherwise(F.col("least_")))
    return counts.groupBy(*by).agg(F.percentile("v_", q, F.col("c_")).alias("value"), F.coalesce(F.sum("c_"), F.lit(0)).alias("n"))


def exact_quantiles(df: DataFrame, columns: list[str], q: float = 0.5, by: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """(by..., <column>_q, <column>_n) for several columns, in the two passes that one takes."""
    by = by or []
    cells = F.array(*(F.struct(F.lit(c).alias("column_"), F.col(c).cast("double").alias("value_")) for c in columns))
    long = exact_quantile(df.select(*by, F.inline(cells)), "value_", q, [*by, "column_"], accuracy)
    pick = lambda c, x: F.max(F.when(F.col("column_") == c, F.col(x)))
    return long.groupBy(*by).agg(*(x for c in columns for x in (pick(c, "value").alias(f"{c}_q"), F.coalesce(pick(c, "n"), F.lit(0)).alias(f"{c}_n"))))

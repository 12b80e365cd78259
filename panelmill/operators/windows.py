"""Ordered-frame operators per entity. All columns of a call share one window and one projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SMALL = 1e-6


def series(key: str | None, order: str | list[str] = "month") -> WindowSpec:
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(key).orderBy(*order) if key else Window.orderBy(*order)


def lags(columns: Iterable[str], ks: Iterable[int], w: WindowSpec) -> list[Column]:
    """x_lag_k (W1)."""
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in columns for k in ks]


def filled_lags(column: str, ks: Iterable[int], w: WindowSpec) -> list[Column]:
    """Lags with 0 for null and a flag for that."""
    out = []
    for k in ks:
        x = F.lag(column, k).over(w)
        out += [F.coalesce(x, F.lit(0.0)).alias(f"{column}_lag_{k}"), x.isNull().cast("int").alias(f"{column}_lag_{k}_was_imputed")]
    return out


_STATS = {"mean": F.avg, "std": F.stddev_pop, "std_sample": F.stddev_samp, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5), "sum": F.sum}


def rolling(column: str, n: int | None, stat: str, w: WindowSpec, least: int = 1, inclusive: bool = False) -> Column:
    """A statistic of the previous ``n`` rows (all, with None), or of the last ``n`` with this one.

    Null with fewer than ``least`` non-null values; ``count`` is 0 on the first row.
    """
    frame = w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1 if inclusive else n), 0 if inclusive else -1)
    if stat == "count":
        return F.count(column).over(frame)
    return F.when(F.count(column).over(frame) >= least, _STATS[stat](column).over(frame))


def rolled(columns: Iterable[str], ns: Iterable[int], stats: Iterable[str], w: WindowSpec, least: int = 1) -> list[Column]:
    return [rolling(c, n, s, w, least).alias(f"{c}_roll_{s}_{n}") for c in columns for n in ns for s in stats]


def ffill(column: str, w: WindowSpec) -> Column:
    return F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(column: str, w: WindowSpec) -> Column:
    return F.first(column, True).over(w.rowsBetween(0, Window.unboundedFollowing))


def growth(column: str, k: int, w: WindowSpec) -> Column:
    """(x - lag) / (|lag| + small); 0 where undefined."""
    lag = F.lag(column, k).over(w)
    return F.coalesce((F.col(column) - lag) / (F.abs(lag) + SMALL), F.lit(0.0))


def pct_change(column: str, k: int, w: WindowSpec) -> Column:
    """Change against the row ``k`` back (column already padded); null where undefined."""
    return F.try_divide(F.col(column), F.lag(column, k).over(w)) - 1


def zscore(column: str, n: int, w: WindowSpec) -> Column:
    """This value against mean and deviation of the previous ``n`` (W14); 0 where undefined."""
    return F.coalesce((F.col(column) - rolling(column, n, "mean", w)) / (rolling(column, n, "std", w) + SMALL), F.lit(0.0))


def masked_fill(column: Column, name: str, history: Column, w: WindowSpec, df: DataFrame) -> DataFrame:
    """History rows: forward fill, then 0; others untouched."""
    raw = df.withColumn(name, column)
    past = F.last(F.when(history, F.col(name)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(name, F.when(history, F.coalesce(past, F.lit(0.0))).otherwise(F.col(name)))


def interpolate(df: DataFrame, column: str, w: WindowSpec) -> DataFrame:
    """Linear between known rows, nearest known beyond them; ``*_was_interpolated`` marks filled rows."""
    df = df.withColumn("rn_", F.row_number().over(w))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col("rn_"))
    df = df.withColumns({"a_": F.last(column, True).over(before), "ra_": F.last(at, True).over(before), "b_": F.first(column, True).over(after), "rb_": F.first(at, True).over(after)})
    line = F.col("a_") + (F.col("b_") - F.col("a_")) * F.try_divide(F.col("rn_") - F.col("ra_"), F.col("rb_") - F.col("ra_"))
    return df.withColumns({f"{column}_was_interpolated": F.col(column).isNull().cast("int"), column: F.coalesce(F.col(column), line, F.col("a_"), F.col("b_"))}).drop("rn_", "a_", "b_", "ra_", "rb_")


def streaks(df: DataFrame, flag: Column, key: str, month: str = "month") -> DataFrame:
    """(key, streak, end_month) of consecutive months with ``flag`` (W19, gaps and islands)."""
    rows = df.where(flag).select(key, month, F.add_months(month, -F.row_number().over(series(key, month))).alias("island"))
    return rows.groupBy(key, "island").agg(F.count("*").alias("streak"), F.max(month).alias("end_month")).drop("island")


def extremes(df: DataFrame, column: str, group: str, key: str, n: int = 5) -> DataFrame:
    """Top and bottom ``n`` rows of each group, ties by key."""
    rows = df.where(F.col(column).isNotNull())
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(column), key))
    worst = F.row_number().over(Window.partitionBy(group).orderBy(F.asc(column), key))
    rows = rows.withColumns({"top_rank": best, "bottom_rank": worst})
    return rows.where((F.col("top_rank") <= n) | (F.col("bottom_rank") <= n))


def calendar(month: str = "month", origin: str = "month_index_origin") -> list[Column]:
    """Month index from ``origin``, and calendar parts."""
    return [
        ((F.year(month) - F.year(origin)) * 12 + F.month(month) - F.month(origin)).cast("long").alias("month_index"),
        F.day(F.last_day(month)).cast("long").alias("days_in_month"),
        F.quarter(month).cast("long").alias("quarter"),
        (F.month(month) == 1).cast("int").alias("is_year_start"),
        (F.month(month) == 12).cast("int").alias("is_year_end"),
    ]

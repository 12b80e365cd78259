"""Layered imputation. Every policy returns the filled column and ``<column>_src``: the layer that filled the cell.

Layers: 0 observed, 1 forward fill, 2 rolling median, 3 group median, 4 global median, 5 zero, null: left alone.
Counts per layer are then one aggregate (``audit``). Each layer takes its medians from the column as filled so far.

Policies that fill forward first have no rolling medians of earlier rows: after the fill a cell is null only where its
entity has no earlier value at all, so such a layer can fill nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.quantiles import exact_quantile
from panelmill.operators.windows import ffill, rolling, series

FFILL, ROLLING, GROUP, GLOBAL, ZERO = 1, 2, 3, 4, 5


def _layer(df: DataFrame, column: str, value: Column, code: int, mask: Column | None = None) -> DataFrame:
    fill = F.col(column).isNull() & (mask if mask is not None else F.lit(True))
    df = df.withColumn("fill_", F.when(fill, value))
    return df.withColumns({f"{column}_src": F.when(F.col("fill_").isNotNull(), F.lit(code)).otherwise(F.col(f"{column}_src")), column: F.coalesce(column, "fill_")}).drop("fill_")


def _start(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_src", F.when(F.col(column).isNotNull(), F.lit(0)))


def _group_median(df: DataFrame, column: str, by: list[str | Column]) -> Column:
    """For groups that are short series: an entity's months."""
    return F.percentile(column, 0.5).over(Window.partitionBy(*by))


def _with_month_median(df: DataFrame, column: str, month: str) -> DataFrame:
    """Adds ``month_``: the month's median, aggregated first; one row per month is joined back."""
    medians = exact_quantile(df, column, by=[month]).select(month, F.col("value").alias("month_"))
    return df.join(F.broadcast(medians), month, "left").select(*df.columns, "month_")


def _with_global(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Adds ``global_``: one aggregated row, broadcast."""
    rows = df.where(where) if where is not None else df
    return df.join(F.broadcast(exact_quantile(rows, column).select(F.col("value").alias("global_"))))


def fill_history(df: DataFrame, column: str, key: str, before: str, month: str = "month") -> DataFrame:
    """Rows before the forecast start only: forward fill, history median, zero."""
    history = F.col(month) < F.lit(before).cast("date")
    df = _layer(_start(df, column), column, ffill(column, series(key, month)), FFILL, history)
    df = _layer(_with_global(df, column, history), column, F.col("global_"), GLOBAL, history).drop("global_")
    return _layer(df, column, F.lit(0.0), ZERO, history)


def fill_counts(df: DataFrame, column: str, key: str, month: str = "month") -> DataFrame:
    """All rows: forward fill, month median, global median, zero."""
    df = _layer(_start(df, column), column, ffill(column, series(key, month)), FFILL)
    df = _layer(_with_month_median(df, column, month), column, F.col("month_"), GROUP).drop("month_")
    df = _layer(_with_global(df, column), column, F.col("global_"), GLOBAL).drop("global_")
    return _layer(df, column, F.lit(0.0), ZERO)


def fill_ungrouped(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Forward fill in row order across entities, as a compatibility mode (W9): an entity may inherit from its neighbour.

    No task sees the whole table: rows are parted by range of ``order``, each part is filled by itself, and what a part
    begins with comes from the last known value of the parts before it (one row per part).
    """
    parts = df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    own = F.last(column, True).over(Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = parts.groupBy("part_").agg(F.max_by(F.when(F.col(column).isNotNull(), F.col(column)), F.when(F.col(column).isNotNull(), F.struct(*order))).alias("last_"))
    ends = last.agg(F.array_sort(F.collect_list(F.struct("part_", "last_"))).alias("ends_"))  # one struct per part
    known = F.filter("ends_", lambda e: (e["part_"] < F.col("part_")) & e["last_"].isNotNull())
    out = parts.withColumn("own_", own).join(F.broadcast(ends)).withColumn("before_", F.try_element_at(known, F.lit(-1))["last_"])
    return out.select(*(F.coalesce("own_", "before_").alias(c) if c == column else F.col(c) for c in df.columns))


def fill_by_entity(df: DataFrame, column: str, key: str, month: str = "month") -> DataFrame:
    """All rows: forward fill, entity median, global median, zero (C7; also periods and prices of C6)."""
    df = _layer(_start(df, column), column, ffill(column, series(key, month)), FFILL)
    df = _layer(df, column, _group_median(df, column, [key]), GROUP)
    df = _layer(_with_global(df, column), column, F.col("global_"), GLOBAL).drop("global_")
    return _layer(df, column, F.lit(0.0), ZERO)


def fill_expanding(df: DataFrame, column: str, key: str, month: str = "month") -> DataFrame:
    """Median of the entity's earlier values, else of all its values, else 0 (W16, C6 without its forward fill)."""
    w = series(key, month)
    df = _layer(_start(df, column), column, rolling(column, None, "median", w), ROLLING)
    df = _layer(df, column, _group_median(df, column, [key]), GROUP)
    return _layer(df, column, F.lit(0.0), ZERO)


def fill_city(df: DataFrame, column: str, before: str, month: str = "month") -> DataFrame:
    """A series of one row per month: forward fill, month-of-year median, history median."""
    history = F.col(month) < F.lit(before).cast("date")
    df = _layer(_start(df, column), column, ffill(column, Window.orderBy(month)), FFILL, history)  # one row per month
    df = _layer(df, column, F.percentile(F.when(history, F.col(column)), 0.5).over(Window.partitionBy(F.month(month))), GROUP, history)
    return _layer(_with_global(df, column, history), column, F.col("global_"), GLOBAL, history).drop("global_")


def fill_search(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null to 0 on all rows, flagged (C4)."""
    return df.select("*", *(F.col(c).isNull().cast("int").alias(f"{c}_was_missing") for c in columns)).fillna(0.0, columns)


def extend_future(dense: DataFrame, column: str, key: str, after: str, month: str = "month") -> DataFrame:
    """Fill a spine that reaches beyond the data; ``*_synthetic`` marks filled rows after ``after``."""
    was = F.col(column).isNull() & (F.col(month) > F.lit(after).cast("date"))
    return fill_counts(dense.withColumn(f"{column}_synthetic", was.cast("int")), column, key, month)


def audit(filled: DataFrame, column: str, before: str, month: str = "month") -> DataFrame:
    """(layer, stage, filled): cells per layer, before the forecast start (observed) and from it on."""
    stage = F.when(F.col(month) < F.lit(before).cast("date"), "observed").otherwise("forecast")
    return filled.where(F.col(f"{column}_src") > 0).groupBy(F.col(f"{column}_src").alias("layer"), stage.alias("stage")).agg(F.count("*").alias("filled"))

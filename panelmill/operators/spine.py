"""Dense calendars, joins onto them, and expansion of coarser series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.sources import files


def months_between(df: DataFrame, month: str = "month", until: str | None = None) -> DataFrame:
    """Every month from the first to the last in ``df``, or to ``until``."""
    ends = df.agg(F.min(month).alias("lo"), F.greatest(F.max(month), F.lit(until).cast("date")).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(month))


def spine(facts: DataFrame, key: str, month: str = "month", until: str | None = None) -> DataFrame:
    """months x distinct keys (J1): a month list exploded in each key's row, so no join and no single task."""
    months = months_between(facts, month, until).agg(F.sort_array(F.collect_list(month)).alias("months"))
    return facts.select(key).distinct().join(F.broadcast(months)).select(key, F.explode("months").alias(month))


def densify(facts: DataFrame, key: str, month: str = "month", until: str | None = None) -> DataFrame:
    """``facts`` on their spine; cells without a fact are null."""
    return spine(facts, key, month, until).join(facts, [key, month], "left")


def join_unique(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that raises, when run, if ``right`` has a key twice."""
    n = right.groupBy(*on).agg(F.count("*").alias("n_"), *(F.first(c).alias(c) for c in right.columns if c not in on))
    ok = F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("several rows for "), F.concat_ws(",", *on))).cast("boolean")).otherwise(F.lit(True))
    return left.join(n.where(ok).drop("n_"), on, "left")


def uncovered(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*on).distinct().join(right, on, "left_anti")


def require_covered(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    """Raise if a key of ``left`` is missing from ``right`` (S3)."""
    if found := uncovered(left, right, on).limit(5).collect():
        raise ValueError(f"without a match: {[tuple(r) for r in found]}")


def keep_one(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``; reverse the order to keep the last."""
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return df.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def annual_to_monthly(annual: DataFrame, year: str, values: list[str], months: DataFrame, month: str = "month") -> DataFrame:
    """Repeat annual values over months, carrying the last year on.

    ``*_was_interpolated`` is 0 in January and 1 in other months.
    """
    every = annual.select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m_"), year, *values).select(F.make_date(year, "m_", F.lit(1)).alias(month), *values)
    carried = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar month
    return months.join(every, month, "left").select(
        month,
        *(F.last(v, True).over(carried).alias(v) for v in values),
        *((F.month(month) != 1).cast("int").alias(f"{v}_was_interpolated") for v in values),
    )


def extrapolate_annual(annual: DataFrame, year: str, value: str, until: int) -> DataFrame:
    """Years up to ``until``; missing later ones grow once from the last observed year.

    The rate is compound over the last three observed years when first and last are positive, else the mean change is
    added; with one year the value stays. ``is_extrapolated`` marks the added years.
    """
    seen = annual.where(F.col(value).isNotNull()).groupBy().agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))))), 1, 3).alias("t"))  # one row per year
    first, last = F.element_at("t", -1), F.element_at("t", 1)
    span = last["y"] - first["y"]
    nxt = F.when(span <= 0, last["v"]).when((first["v"] > 0) & (last["v"] > 0), last["v"] * F.pow(F.try_divide(last["v"], first["v"]), F.try_divide(F.lit(1.0), span))).otherwise(last["v"] + F.try_divide(last["v"] - first["v"], span))
    more = seen.select(F.explode(F.when(last["y"] < until, F.sequence(last["y"] + 1, F.lit(until).cast("long")))).alias(year), nxt.alias(value), F.lit(1).alias("is_extrapolated"))
    return annual.select(F.col(year).cast("long").alias(year), value, F.lit(0).alias("is_extrapolated")).unionByName(more)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` and its row number in ``order``, from 1 (O1, O2), without a window over the whole table.

    Rows are parted by range, sorted and numbered within each part, and written; the parts' sizes, one row each, make the
    offsets. Written, because the borders between parts are sampled: a second pass over the rows draws others.
    """
    path = files.scratch_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("part_", F.shiftright("place_", 33))
    sizes = rows.groupBy("part_").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("part_", "n")).alias("sizes_"))
    before = F.aggregate(F.filter("sizes_", lambda s: s["part_"] < F.col("part_")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    offsets = sizes.select("sizes_", F.explode("sizes_.part_").alias("part_")).select("part_", before.alias("before_"))
    own = F.col("place_").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(offsets), "part_").select(*df.columns, (F.col("before_") + own).cast("int").alias(name))

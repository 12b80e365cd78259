"""Forward projection of exogenous columns with provenance, drift and back-tests.

Tiers by the number n of non-null history values of an entity: n >= 12 weighted mean of the last twelve (weights
0.7^age, source 1); 6 to 11 mean (2); 3 to 5 median (2); else the median of its city in that month of the year if it
rests on three values (3); else the global median, else 0 (4). Values are cut at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.quantiles import exact_quantile, exact_quantiles

DECAY, TAIL = 0.7, 12


def _tail_mean(values: str) -> Column:
    """Mean of the last twelve of an array in time order, weighted by 0.7^age."""
    last = F.reverse(F.slice(F.reverse(F.col(values)), 1, TAIL))
    weights = [DECAY**i for i in range(TAIL - 1, -1, -1)]
    pairs = F.zip_with(last, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.lit(sum(weights))


def _median(values: str) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2


def _tiers(values: str, city: Column, city_n: Column, overall: Column) -> tuple[Column, Column]:
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    wide = F.coalesce(city_n, F.lit(0)) >= 3
    value = F.when(n >= TAIL, _tail_mean(values)).when(n >= 6, total / n).when(n >= 3, _median(values)).when(wide, city).otherwise(F.coalesce(overall, F.lit(0.0)))
    source = F.when(n >= TAIL, 1).when(n >= 3, 2).when(wide, 3).otherwise(4)
    return F.greatest(value, F.lit(0.0)), source


def project(panel: DataFrame, columns: list[str], start: str, key: str, city: str, month: str = "month") -> DataFrame:
    """``panel`` with each column replaced from ``start`` on, and ``*_proj_source``, ``*_proj_overridden``.

    One aggregate per tier for all columns; an entity's history is bounded by its months. Medians of cities and of the
    whole are selected without gathering their values in a task (``exact_quantiles``).
    """
    history = panel.where(F.col(month) < F.lit(start).cast("date"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(month).alias("t"), F.col(c).cast("double").alias("x")))
    arrays = [F.sort_array(F.collect_list(known(c))).alias(f"{c}_h_") for c in columns]
    own = history.groupBy(key).agg(*arrays)
    near = exact_quantiles(history.withColumn("moy_", F.month(month)), columns, by=[city, "moy_"])
    near = near.select(city, "moy_", *(x for c in columns for x in (F.col(f"{c}_q").alias(f"{c}_m_"), F.col(f"{c}_n").alias(f"{c}_n_"))))
    overall = exact_quantiles(history, columns).select(*(F.col(f"{c}_q").alias(f"{c}_g_") for c in columns))
    rows = panel.withColumn("moy_", F.month(month)).join(own, key, "left").join(near, [city, "moy_"], "left").join(F.broadcast(overall))
    rows = rows.withColumns({f"{c}_h_": F.coalesce(F.transform(f"{c}_h_", lambda s: s["x"]), F.array().cast("array<double>")) for c in columns})
    future = F.col(month) >= F.lit(start).cast("date")
    made = []
    for c in columns:
        value, source = _tiers(f"{c}_h_", F.col(f"{c}_m_"), F.col(f"{c}_n_"), F.col(f"{c}_g_"))
        made += [F.when(future, value).otherwise(F.col(c)).alias(c), F.when(future, source).otherwise(0).alias(f"{c}_proj_source"), (future & F.col(c).isNotNull()).cast("int").alias(f"{c}_proj_overridden")]
    return rows.select(*(x for x in panel.columns if x not in columns), *made)


def drift(original: DataFrame, projected: DataFrame, columns: list[str], start: str, key: str, month: str = "month") -> DataFrame:
    """Per column: errors of the projection where the truth is known, and shares of sources."""
    future = F.col(month) >= F.lit(start).cast("date")
    truth = original.where(future).select(key, month, *columns).unpivot([key, month], columns, "column", "actual")
    guess = projected.where(future).select(key, month, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"{c}_proj_source").alias("source")) for c in columns))).alias("s")).select(key, month, "s.*")
    rows = guess.join(truth, [key, month, "column"], "left").withColumn("err", F.col("value") - F.col("actual"))
    return rows.groupBy("column").agg(
        F.count("err").alias("n"),
        F.avg(F.abs("err")).alias("mae"),
        F.avg(F.abs("err") / F.greatest(F.abs("actual"), F.lit(1.0))).alias("mape"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.percentile("err", 0.1).alias("p10"),
        F.percentile("err", 0.9).alias("p90"),
        F.avg((F.col("source") == 3).cast("double")).alias("proj_source_3_ratio"),
        F.avg((F.col("source") == 4).cast("double")).alias("proj_source_4_ratio"),
        F.max(F.when(F.col("actual").isNotNull(), F.col(month))).alias("latest_month"),
    )


def backtest(panel: DataFrame, column: str, key: str, city: str, month: str = "month") -> DataFrame:
    """Every known value against its projection from strictly earlier months: value, source, ape.

    Only known rows take part. The entity's tiers need its last twelve known values and their number, in one bounded
    frame. The city's and the global median are made only for the months that some row with fewer than three earlier
    values asks for, each from the earlier rows, selected without gathering them.
    """
    index = (F.year(month) * 12 + F.month(month)).alias("t_")
    own = Window.partitionBy(key).orderBy(month)
    known = panel.where(F.col(column).isNotNull()).select(key, month, F.col(city).alias("city_"), F.month(month).alias("moy_"), index, F.col(column).alias("x_"))
    rows = known.withColumns({"h_": F.transform(F.collect_list("x_").over(own.rowsBetween(-TAIL, -1)), lambda x: x.cast("double"))})
    short = rows.where(F.size("h_") < 3)
    places = ["city_", "moy_"]
    asked = short.groupBy(*places).agg(F.collect_set("t_").alias("asked_"))  # a city's years
    later = F.explode(F.filter("asked_", lambda t: t > F.col("t_"))).alias("at_")
    near = exact_quantile(known.join(asked, places).select(*places, "x_", later), "x_", by=[*places, "at_"]).select(*places, F.col("at_").alias("t_"), F.col("value").alias("m_"), F.col("n").alias("n_"))
    few = short.join(near, [*places, "t_"], "left").where(F.coalesce("n_", F.lit(0)) < 3)
    months = few.agg(F.collect_set("t_").alias("asked_"))  # months
    overall = exact_quantile(known.join(F.broadcast(months)).select("x_", later), "x_", by=["at_"]).select(F.col("at_").alias("t_"), F.col("value").alias("g_"))
    rows = rows.join(near, [*places, "t_"], "left").join(F.broadcast(overall), "t_", "left")
    value, source = _tiers("h_", F.col("m_"), F.col("n_"), F.col("g_"))
    out = rows.select(key, month, F.col("x_").alias("actual"), value.alias("value"), source.alias("source"))
    return out.withColumn("ape", F.abs(F.col("value") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1.0)))


def suppressed(drifts: DataFrame, apes: DataFrame, share: float = 0.85, q: float = 0.8) -> list[str]:
    """Columns whose derived features should go: error above the back-test's quantile, or too much fallback (C14)."""
    limit = apes.agg(F.percentile("ape", q)).first()[0]
    rows = drifts.select("column", "mape", (F.col("proj_source_3_ratio") + F.col("proj_source_4_ratio")).alias("fallback")).collect()  # a row per column
    return sorted(r["column"] for r in rows if (limit is not None and r["mape"] is not None and r["mape"] > limit) or r["fallback"] > share)


def dependence(projected: DataFrame, columns: list[str], start: str, limit: float = 0.85, month: str = "month") -> DataFrame:
    """(month, share, too_high): share of cells that are projections, per forecast month."""
    used = [F.avg((F.col(f"{c}_proj_source") > 0).cast("double")) for c in columns]
    share = sum(used[1:], used[0]) / len(used)
    return projected.where(F.col(month) >= F.lit(start).cast("date")).groupBy(month).agg(share.alias("share")).withColumn("too_high", (F.col("share") > limit).cast("int"))

"""Named queries over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import columns as fn
from panelmill.operators import cross, forecast, impute, metrics, models, project, quality, search, spine
from panelmill.operators import windows as win
from panelmill.plans.feature_plan import category_counts, standard_plan
from panelmill.plans.shared import shared
from panelmill.sources import files
from panelmill.streaming.events import windowed_totals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _as_decimals(sql: str) -> str:
    """``round(x, 6)`` of the SQL rounds decimals, as ``r6`` does (see there)."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while depth or end == start + 5:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = _as_decimals(sql[start + 6 : end - 1])
        exact = f"cast(round(cast({inner[:-3]} as decimal(38, 8)), 6) as double)" if inner.endswith(", 6") else f"round({inner})"
        out, at = out + sql[at:start] + exact, end
    return out + sql[at:]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _ORACLES[f.__name__] = _as_decimals(oracle)
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str) -> Column:
    """Rounded to six digits, by way of eight: means of exact decimals can end in a 5 at the seventh digit, and their
    doubles lie on either side of it; as decimals of eight digits they are that 5 in any engine."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("decimal(38,8)"), 6).cast("double").alias(name)


# base facts
FACT = "sum(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(18,2)))"


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month"), F.col("l_suppkey").alias("k")).agg(F.expr(FACT).cast("double").alias("amt"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.count("*").alias("n"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, "supplier_panel", [f"{sf_dir}/lineitem.parquet"], lambda: spine.densify(supplier_facts(spark, sf_dir), "k"))


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amt"))


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: most cells are null."""
    return shared(spark, "customer_panel", [f"{sf_dir}/orders.parquet"], lambda: spine.densify(customer_facts(spark, sf_dir), "k"))


def with_city(spark: SparkSession, sf_dir: str, panel: DataFrame) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("int").alias("city"))
    return spine.join_unique(panel, nation, ["k"])


def monthly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    total = rows.groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("month")).agg(F.expr(FACT).cast("double").alias("amt"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))
    return shared(spark, "monthly_total", [f"{sf_dir}/lineitem.parquet"], lambda: total)


P = f"""f as (select cast(date_trunc('month', l_shipdate) as date) as month, l_suppkey as k, cast({FACT} as double) as amt,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, count(*) as n from lineitem group by 1, 2),
m as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from (select min(month) lo, max(month) hi from f)),
p as (select s.k, m.month, f.amt, f.qty, f.n from (select distinct k from f) s cross join m left join f on f.k = s.k and f.month = m.month)"""
PC = """cf as (select cast(date_trunc('month', o_orderdate) as date) as month, o_custkey as k, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as amt from orders group by 1, 2),
cm as (select cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as month from (select min(month) lo, max(month) hi from cf)),
pc as (select s.k, cm.month, cf.amt from (select distinct k from cf) s cross join cm left join cf on cf.k = s.k and cf.month = cm.month)"""
TOTAL = f"""t as (select cast(date_trunc('month', l_shipdate) as date) as month, cast({FACT} as double) as amt, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty from lineitem group by 1)"""
CITY = "pn as (select p.*, cast(s_nationkey as int) as city from p left join supplier on s_suppkey = p.k)"
NAIVE = f"{P}, nv as (select k, month, amt as y, lag(amt) over (partition by k order by month) as yhat from p)"


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    return supplier_panel(spark, sf_dir).select("k", "month", F.col("amt").alias("y"), F.lag("amt").over(w).alias("yhat"))


# scans, joins, projections
@query(f"with {P} select month, k, cast(amt is not null as int) as has_fact from p")
def panel_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).select("month", "k", F.col("amt").isNotNull().cast("int").alias("has_fact"))


@query(f"""with {P}, {TOTAL}, {CITY} select pn.month, pn.k, pn.city, n_name as nation, coalesce(pn.amt, 0) as target_filled, cast(pn.amt is null as int) as target_filled_was_missing,
  t.amt as city_amt, cast(pn.month > date '2001-05-01' as int) as is_future, case when pn.month <= date '2001-05-01' then pn.amt end as target
  from pn left join nation on n_nationkey = pn.city left join t on t.month = pn.month""")
def panel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_city(spark, sf_dir, supplier_panel(spark, sf_dir))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("city"), F.col("n_name").alias("nation"))
    total = monthly_total(spark, sf_dir).select("month", F.col("amt").alias("city_amt"))
    out = spine.join_unique(p, nation, ["city"]).join(F.broadcast(total), "month", "left")  # one row per month
    future = F.col("month") > F.lit("2001-05-01").cast("date")
    return out.select("month", "k", "city", "nation", F.coalesce("amt", F.lit(0.0)).alias("target_filled"), fn.missing_flag("amt").alias("target_filled_was_missing"), "city_amt", future.cast("int").alias("is_future"), F.when(~future, F.col("amt")).alias("target"))


@query(f"with {P} select month, k, strftime(month, '%Y %b') || '_sector ' || k as id, month as id_month, cast(k as int) as id_sector from p")
def panel_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = supplier_panel(spark, sf_dir).select("month", "k", fn.panel_id("month", "k").alias("id"))
    return out.select("*", fn.id_month("id").alias("id_month"), fn.id_sector("id").alias("id_sector"))


@query(f"with {PC} select k, month, cast(amt is null as int) as amt_was_missing, cast(coalesce(amt = 0, false) as int) as amt_is_zero from pc")
def zero_and_missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_panel(spark, sf_dir).select("k", "month", fn.missing_flag("amt"), fn.zero_flag("amt"))


@query("""select c_custkey as id, c_acctbal as value, 'c_acctbal' as "column", 'negative' as issue, 'customer' as source_table from customer where c_acctbal < 0
  union all select s_suppkey, s_acctbal, 's_acctbal', 'negative', 'supplier' from supplier where s_acctbal < 0""")
def negative_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quality.negatives(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), ["id"], ["c_acctbal"], "customer")
    return a.unionByName(quality.negatives(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id"), ["id"], ["s_acctbal"], "supplier"))


@query(f"with {PC} select 'amt' as \"column\", count(*) - count(amt) as missing, round((count(*) - count(amt)) / count(*), 6) as share from pc having count(*) > count(amt)")
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_profile(customer_panel(spark, sf_dir), ["amt", "k"]).select("column", "missing", r6("share", "share"))


@query(f"with {P} select k, month from p where n is null")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_months(supplier_facts(spark, sf_dir), "k")


@query("select c_custkey as k from customer where c_custkey not in (select o_custkey from orders)")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.uncovered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""select 'both' as part, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders)
  union all select 'any', count(*) from (select c_custkey from customer union select o_custkey from orders)
  union all select 'first_only', count(*) from (select c_custkey from customer except select o_custkey from orders)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    parts = {"both": a.intersect(b), "any": a.union(b).distinct(), "first_only": a.subtract(b)}
    out = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""with v as (select p_brand, var_pop(p_retailprice) as variance from part group by 1 order by 2 desc, 1 limit 30)
  select p_partkey, p_brand from part where p_brand in (select p_brand from v)""")
def semi_top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.join(F.broadcast(search.top_keywords(parts, "p_brand", "p_retailprice")), "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("""select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, round(min(l_extendedprice), 6) as least, round(max(l_extendedprice), 6) as most,
  cast(count(distinct l_suppkey) as bigint) as suppliers from lineitem group by 1, 2""")
def summary_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), r6(F.min("l_extendedprice"), "least"), r6(F.max("l_extendedprice"), "most"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(f"with {P} select k, cast(count(amt) as bigint) as n, cast(count(distinct amt) as bigint) as n_distinct, min(amt) as least, max(amt) as most, round(avg(amt), 6) as mean, round(stddev_pop(amt), 6) as std from p group by k")
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(supplier_panel(spark, sf_dir), "k", "amt").select("k", "n", "n_distinct", "least", "most", r6("mean", "mean"), r6("std", "std"))


# keyword logs
EVENTS = "ev as (select cast(ts as date) as day, event_type, cast(sum(cast(value as decimal(18,6))) as double) as volume from events group by 1, 2)"
TYPES = ["click", "error", "purchase", "signup", "view"]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", F.col("value").cast("decimal(18,6)").alias("volume"))
    return search.totals(rows, "day", "event_type", "volume").withColumn("volume", F.col("volume").cast("double"))


def event_types(spark: SparkSession, sf_dir: str) -> list[str]:
    """The keywords are a small fixed set; they name columns, so they are needed before the plan."""
    return TYPES


_SUMS = ", ".join(f"sum(case when event_type = '{t}' then volume end) as {t}" for t in TYPES)


@query(f"with {EVENTS} select day, {', '.join(f'round({c}, 6) as {c}' for c in TYPES)} from (select day, {_SUMS} from ev group by day)")
def search_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = search.pivot(event_log(spark, sf_dir), "day", "event_type", "volume", event_types(spark, sf_dir))
    return wide.select("day", *(r6(c, c) for c in TYPES))


_FILL = ", ".join(f"coalesce(last_value({c} ignore nulls) over (order by day rows between unbounded preceding and current row), first_value({c} ignore nulls) over (order by day rows between current row and unbounded following)) as {c}" for c in TYPES)
_MEAN3 = ", ".join(f"round(coalesce(avg({c}) over (order by day rows between 2 preceding and current row), 0), 6) as {c}" for c in TYPES)


@query(f"with {EVENTS}, w as (select day, {_SUMS} from ev group by day), g as (select day, {_FILL} from w) select day, {_MEAN3} from g")
def search_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = search.pivot(event_log(spark, sf_dir), "day", "event_type", "volume", event_types(spark, sf_dir))
    return search.smooth(wide, TYPES, "day").select("day", *(r6(c, c) for c in TYPES))


@query(f"with {EVENTS} select day, event_type, round(volume, 6) as volume, round(coalesce(volume / nullif(sum(volume) over (partition by day), 0), 0), 6) as share from ev")
def keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shares(event_log(spark, sf_dir), "day", "event_type", "volume").select("day", "event_type", r6("volume", "volume"), r6("share", "share"))


@query(f"""with {EVENTS}, w as (select day, {_SUMS} from ev group by day), d as (select day, click, lag(click) over (order by day) as l, avg(click) over (order by day rows between 3 preceding and 1 preceding) as m,
  stddev_pop(click) over (order by day rows between 3 preceding and 1 preceding) as s from w) select day, round(coalesce(l, 0), 6) as click_lag_1, round(coalesce(m, 0), 6) as click_mean_3,
  round(coalesce(click / nullif(l, 0) - 1, 0), 6) as click_pct_1, round(coalesce((click - m) / (s + 1e-6), 0), 3) as click_z_3 from d""")
def search_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = search.pivot(event_log(spark, sf_dir), "day", "event_type", "volume", event_types(spark, sf_dir))
    out = search.derived(wide, ["click"], "day")
    return out.select("day", r6("click_lag_1", "click_lag_1"), r6("click_mean_3", "click_mean_3"), r6("click_pct_1", "click_pct_1"), F.round("click_z_3", 3).alias("click_z_3"))


@query("select cast(date_trunc('day', ts) as date) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_totals(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("date").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


# annual series
ANNUAL = "an as (select year(o_orderdate) as yr, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v from orders group by 1)"


def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


@query(f"""with {P}, {ANNUAL} select m.month, last_value(an.v ignore nulls) over (order by m.month) as v, cast(month(m.month) <> 1 as int) as v_was_interpolated from m left join an on an.yr = year(m.month)""")
def annual_to_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spine.months_between(supplier_facts(spark, sf_dir))
    return spine.annual_to_monthly(annual_totals(spark, sf_dir).withColumn("yr", F.col("yr").cast("int")), "yr", ["v"], months)


@query(f"""with {ANNUAL}, l as (select * from an order by yr desc limit 3), g as (select max(yr) as ly, max_by(v, yr) as lv, min(yr) as fy, min_by(v, yr) as fv from l)
  select yr, round(v, 6) as v, 0 as is_extrapolated from an union all select unnest(generate_series(ly + 1, 2004)), round(lv * pow(lv / fv, 1.0 / (ly - fy)), 6) as v, 1 from g""")
def annual_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.extrapolate_annual(annual_totals(spark, sf_dir), "yr", "v", 2004).select("yr", r6("v", "v"), "is_extrapolated")


@query(f"""with {ANNUAL}, g as (select yr, case when yr in (1997, 1998) then null else v end as v, row_number() over (order by yr) as rn from an),
  h as (select *, last_value(v ignore nulls) over (order by yr) as a, last_value(case when v is not null then rn end ignore nulls) over (order by yr) as ra,
  first_value(v ignore nulls) over (order by yr rows between current row and unbounded following) as b, first_value(case when v is not null then rn end ignore nulls) over (order by yr rows between current row and unbounded following) as rb from g)
  select yr, round(coalesce(v, a + (b - a) * (rn - ra) / nullif(rb - ra, 0), a, b), 4) as v, cast(v is null as int) as v_was_interpolated from h""")
def interpolate_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = annual_totals(spark, sf_dir).withColumn("v", F.when(~F.col("yr").isin(1997, 1998), F.col("v")))
    return win.interpolate(gap, "v", Window.orderBy("yr")).select("yr", F.round("v", 4).alias("v"), "v_was_interpolated")


# imputation
START = "2001-03-01"
_FF = "last_value(amt ignore nulls) over (partition by k order by month rows between unbounded preceding and current row)"


@query(f"""with {PC}, a as (select k, month, amt, case when month < date '{START}' then {_FF} else amt end as f from pc), g as (select quantile_cont(f, 0.5) as g from a where month < date '{START}')
  select k, month, round(coalesce(f, case when month < date '{START}' then coalesce(g, 0) end), 6) as amt, case when amt is not null then 0 when f is not null then 1 when month < date '{START}' and g is not null then 4 when month < date '{START}' then 5 end as amt_src from a cross join g""")
def impute_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_history(customer_panel(spark, sf_dir), "amt", "k", START).select("k", "month", r6("amt", "amt"), "amt_src")


_V2 = f"""a as (select k, month, amt, {_FF} as f from pc), b as (select *, quantile_cont(f, 0.5) over (partition by month) as mm from a), c as (select *, coalesce(f, mm) as h from b), g as (select quantile_cont(h, 0.5) as g from c),
  filled as (select k, month, coalesce(h, g, 0) as v, case when amt is not null then 0 when f is not null then 1 when mm is not null then 3 when g is not null then 4 else 5 end as src from c cross join g)"""


@query(f"with {PC}, {_V2} select k, month, round(v, 6) as amt, src as amt_src from filled")
def impute_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_counts(customer_panel(spark, sf_dir), "amt", "k").select("k", "month", r6("amt", "amt"), "amt_src")


@query(f"with {PC}, {_V2} select src as layer, case when month < date '{START}' then 'observed' else 'forecast' end as stage, count(*) as filled from filled where src > 0 group by 1, 2")
def impute_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.audit(impute.fill_counts(customer_panel(spark, sf_dir), "amt", "k"), "amt", START)


@query(f"""with {PC}, a as (select k, month, amt, {_FF} as f from pc), b as (select *, quantile_cont(f, 0.5) over (partition by k) as mm from a)
  select k, month, round(coalesce(f, mm), 6) as amt, case when amt is not null then 0 when f is not null then 1 else 3 end as amt_src from b""")
def impute_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_by_entity(customer_panel(spark, sf_dir), "amt", "k").select("k", "month", r6("amt", "amt"), "amt_src")


@query(f"""with {PC}, a as (select k, month, amt, quantile_cont(amt, 0.5) over (partition by k order by month rows between unbounded preceding and 1 preceding) as e from pc),
  b as (select *, coalesce(amt, e) as f from a), c as (select *, quantile_cont(f, 0.5) over (partition by k) as s from b)
  select k, month, round(coalesce(f, s, 0), 6) as amt, case when amt is not null then 0 when e is not null then 2 else 3 end as amt_src from c""")
def impute_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_expanding(customer_panel(spark, sf_dir), "amt", "k").select("k", "month", r6("amt", "amt"), "amt_src")


@query(f"""with {TOTAL}, h as (select month, case when month(month) % 5 <> 0 or year(month) > 1997 then amt end as amt from t), a as (select month, amt, case when month < date '{START}' then last_value(amt ignore nulls) over (order by month) else amt end as f from h)
  select month, round(f, 6) as amt, case when amt is not null then 0 when f is not null then 1 end as amt_src from a""")
def impute_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = monthly_total(spark, sf_dir).select("month", F.when((F.month("month") % 5 != 0) | (F.year("month") > 1997), F.col("amt")).alias("amt"))
    return impute.fill_city(gaps, "amt", START).select("month", r6("amt", "amt"), "amt_src")


@query(f"""with {P}, e as (select cast(unnest(generate_series(lo, hi + interval 12 month, interval 1 month)) as date) as month from (select min(month) lo, max(month) hi from f)), b as (select max(month) as hi from f),
  x as (select s.k, e.month, f.amt from (select distinct k from f) s cross join e left join f on f.k = s.k and f.month = e.month), a as (select k, month, amt, last_value(amt ignore nulls) over (partition by k order by month) as f from x),
  c as (select *, coalesce(f, quantile_cont(f, 0.5) over (partition by month)) as h from a), g as (select quantile_cont(h, 0.5) as g from c)
  select k, month, round(coalesce(h, g, 0), 6) as amt, cast(amt is null and month > hi as int) as amt_synthetic from c cross join g cross join b""")
def future_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = supplier_panel(spark, sf_dir).where("n is not null")
    hi = facts.agg(F.max("month")).first()[0]
    until = f"{hi.year + 1:04d}-{hi.month:02d}-01"
    return impute.extend_future(spine.densify(facts, "k", until=until), "amt", "k", str(hi)).select("k", "month", r6("amt", "amt"), "amt_synthetic")


# windows
@query(f"""with {P} select k, month, coalesce(lag(amt, 1) over w, 0) as amt_lag_1, cast(lag(amt, 1) over w is null as int) as amt_lag_1_was_imputed, coalesce(lag(amt, 12) over w, 0) as amt_lag_12, cast(lag(amt, 12) over w is null as int) as amt_lag_12_was_imputed,
  round(case when count(amt) over r >= 2 then avg(amt) over r end, 6) as amt_mean_3 from p window w as (partition by k order by month), r as (partition by k order by month rows between 3 preceding and 1 preceding)""")
def target_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    return supplier_panel(spark, sf_dir).select("k", "month", *win.filled_lags("amt", (1, 12), w), r6(win.rolling("amt", 3, "mean", w, 2), "amt_mean_3"))


@query(f"with {P} select k, month, " + ", ".join(f"lag({c}, {k}) over w as {c}_lag_{k}" for c in ("amt", "qty") for k in (1, 3, 6, 12)) + " from p window w as (partition by k order by month)")
def metric_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).select("k", "month", *win.lags(["amt", "qty"], (1, 3, 6, 12), win.series("k")))


_SQL_STAT = {"mean": "avg(amt)", "std": "stddev_pop(amt)", "min": "min(amt)", "max": "max(amt)"}


@query(f"with {P} select k, month, " + ", ".join(f"round(case when count(amt) over w{n} >= 2 then {e} over w{n} end, {3 if s == 'std' else 6}) as amt_roll_{s}_{n}" for n in (3, 6, 12) for s, e in _SQL_STAT.items()) + ", cast(count(amt) over w6 as bigint) as amt_roll_count_6 from p window " + ", ".join(f"w{n} as (partition by k order by month rows between {n} preceding and 1 preceding)" for n in (3, 6, 12)))
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    return supplier_panel(spark, sf_dir).select("k", "month", *(F.round(x, 3).alias(name) if s == "std" else r6(x, name) for n in (3, 6, 12) for s in _SQL_STAT for x, name in [(win.rolling("amt", n, s, w, 2), f"amt_roll_{s}_{n}")]), win.rolling("amt", 6, "count", w).alias("amt_roll_count_6"))


@query(f"with {P} select k, month, round(case when count(amt) over r >= 3 then quantile_cont(amt, 0.5) over r end, 6) as median_12 from p window r as (partition by k order by month rows between 12 preceding and 1 preceding)")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).select("k", "month", r6(win.rolling("amt", 12, "median", win.series("k"), 3), "median_12"))


@query(f"with {P} select k, month, round(quantile_cont(amt, 0.5) over (partition by k order by month rows between unbounded preceding and 1 preceding), 6) as history_median from p")
def history_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_panel(spark, sf_dir).select("k", "month", r6(win.rolling("amt", None, "median", win.series("k")), "history_median"))


@query(f"""with {P}, a as (select k, month, amt, lag(amt) over w as l1, lag(amt, 3) over w as l3, avg(amt) over r as m, stddev_pop(amt) over r as s from p window w as (partition by k order by month), r as (partition by k order by month rows between 3 preceding and 1 preceding))
  select k, month, round(coalesce((amt - l1) / (abs(l1) + 1e-6), 0), 6) as growth_1, round(coalesce((amt - l3) / (abs(l3) + 1e-6), 0), 6) as growth_3, round(case when s > 1 then (amt - m) / (s + 1e-6) else 0 end, 6) as z_3 from a""")
def growth_and_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    safe = F.when(win.rolling("amt", 3, "std", w) > 1, (F.col("amt") - win.rolling("amt", 3, "mean", w)) / (win.rolling("amt", 3, "std", w) + 1e-6)).otherwise(F.lit(0.0))
    return supplier_panel(spark, sf_dir).select("k", "month", r6(win.growth("amt", 1, w), "growth_1"), r6(win.growth("amt", 3, w), "growth_3"), r6(safe, "z_3"))


@query(f"""with {P}, a as (select k, month, last_value(amt ignore nulls) over (partition by k order by month) as x from p)
  select k, month, round(x / nullif(lag(x) over w, 0) - 1, 6) as mom, round(x / nullif(lag(x, 12) over w, 0) - 1, 6) as yoy from a window w as (partition by k order by month)""")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    padded = supplier_panel(spark, sf_dir).select("k", "month", win.ffill("amt", w).alias("x"))
    return padded.select("k", "month", r6(win.pct_change("x", 1, w), "mom"), r6(win.pct_change("x", 12, w), "yoy"))


@query(f"""with {TOTAL} select month, round(case when count(amt) over r = 12 then avg(amt) over r end, 6) as mean_12, round(case when count(amt) over q = 3 then stddev_samp(amt) over q end, 4) as std_3
  from t window r as (order by month rows between 11 preceding and current row), q as (order by month rows between 2 preceding and current row)""")
def trailing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("month")  # one row per month
    return monthly_total(spark, sf_dir).select("month", r6(win.rolling("amt", 12, "mean", w, 12, True), "mean_12"), F.round(win.rolling("amt", 3, "std_sample", w, 3, True), 4).alias("std_3"))


@query(f"""with {PC}, z as (select k, month, row_number() over (partition by k order by month) as rn from pc where amt is null) select k, count(*) as streak, max(month) as end_month from (select k, month, month - to_months(cast(rn as int)) as g from z) group by k, g""")
def zero_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.streaks(customer_panel(spark, sf_dir), F.col("amt").isNull(), "k")


@query(f"""with {P}, a as (select k, month, last_value(amt ignore nulls) over (partition by k order by month) as x from p), y as (select k, month, round(x / nullif(lag(x, 12) over (partition by k order by month), 0) - 1, 6) as yoy from a),
  r as (select *, row_number() over (partition by month order by yoy desc, k) as top_rank, row_number() over (partition by month order by yoy, k) as bottom_rank from y where yoy is not null)
  select k, month, yoy, cast(top_rank as int) as top_rank, cast(bottom_rank as int) as bottom_rank from r where top_rank <= 5 or bottom_rank <= 5""")
def yoy_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.extremes(pct_change(spark, sf_dir).select("k", "month", "yoy"), "yoy", "month", "k")


@query(f"""with {TOTAL} select month, cast((year(month) - 1995) * 12 + month(month) - 1 as bigint) as month_index, cast(day(last_day(month)) as bigint) as days_in_month, cast(quarter(month) as bigint) as quarter, cast(month(month) = 1 as int) as is_year_start, cast(month(month) = 12 as int) as is_year_end,
  cast(ntile(3) over (order by month) as int) as bucket from t""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = search.folds_of_months(monthly_total(spark, sf_dir), "month").withColumn("month_index_origin", F.lit("1995-01-01").cast("date"))
    return months.select("month", *win.calendar(), "bucket")


# cross-sections
@query(f"""with {P}, {CITY}, w as (select month, k, amt, case when s_acctbal > 0 then s_acctbal else 1.0 end as wt from p left join supplier on s_suppkey = k), s as (select month, coalesce(sum(amt * wt), 0) / sum(wt) as m from w group by month)
  select k, w.month, round(m, 4) as amt_wmean, round(coalesce(amt / (m + 1e-6), 0), 6) as amt_share from w join s on s.month = w.month""")
def city_weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("pop"))
    p = spine.join_unique(supplier_panel(spark, sf_dir), bal, ["k"]).withColumn("scale", F.lit(0.0))
    out = cross.weighted_share(p, ["amt"], cross.weight("pop", "scale"))
    return out.select("k", "month", F.round("amt_wmean", 4).alias("amt_wmean"), r6("amt_share", "amt_share"))


@query(f"with {P}, {CITY} select k, month, round(avg(amt) over (partition by city, month), 6) as amt_nearby, round(amt - avg(amt) over (partition by city, month), 6) as amt_minus_nearby from pn")
def interaction_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.group_gap(with_city(spark, sf_dir, supplier_panel(spark, sf_dir)), "amt", ["city", "month"])
    return out.select("k", "month", r6("amt_nearby", "amt_nearby"), r6("amt_minus_nearby", "amt_minus_nearby"))


@query(f"with {P} select k, month, round(ln(1 + greatest(amt, 0)), 6) as amt_log1p, round(ln(1 + greatest(qty, 0)), 6) as qty_log1p from p where amt is not null")
def log1p_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = supplier_panel(spark, sf_dir).where("amt is not null")
    return out.select("k", "month", *(r6(fn.log1p_feature(c), f"{c}_log1p") for c in ("amt", "qty")))


@query("""with w as (select year(o_orderdate) as yr, sum(case when o_orderstatus = 'F' then 1 else 0 end) as f, sum(case when o_orderstatus = 'O' then 1 else 0 end) as o, sum(case when o_orderstatus = 'P' then 1 else 0 end) as p from orders group by 1)
  select cast(yr as int) as yr, round(coalesce(f / nullif(f + o + p, 0), 0), 6) as "F", round(coalesce(o / nullif(f + o + p, 0), 0), 6) as "O", round(coalesce(p / nullif(f + o + p, 0), 0), 6) as "P" from w""")
def pivot_row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return cross.row_shares(wide, ["F", "O", "P"]).select("yr", *(r6(c, c) for c in "FOP"))


# projection
_TIER = """case when n >= 12 then ew when n >= 6 then am when n >= 3 then md when coalesce(cn, 0) >= 3 then cmd else coalesce(gm, 0) end"""
_SRC = "case when n >= 12 then 1 when n >= 3 then 2 when coalesce(cn, 0) >= 3 then 3 else 4 end"
_PCN = "pcn as (select pc.*, cast(c_nationkey as int) as city from pc left join customer on c_custkey = pc.k)"
_PROJ = f"""h as (select cf.*, cast(c_nationkey as int) as city, row_number() over (partition by k order by month desc) as age from cf join customer on c_custkey = k where amt is not null and month < date '{START}'),
  o as (select k, count(*) as n, avg(amt) as am, quantile_cont(amt, 0.5) as md, sum(case when age <= 12 then amt * pow(0.7, age - 1) end) / ((1 - pow(0.7, 12)) / 0.3) as ew from h group by k),
  c as (select city, month(month) as moy, count(*) as cn, quantile_cont(amt, 0.5) as cmd from h group by 1, 2), g as (select quantile_cont(amt, 0.5) as gm from h),
  pj as (select x.k, x.month, x.amt as actual, case when x.month >= date '{START}' then greatest({_TIER}, 0) else x.amt end as amt, case when x.month >= date '{START}' then {_SRC} else 0 end as src
  from (select pcn.*, coalesce(o.n, 0) as n, am, md, ew from pcn left join o on o.k = pcn.k) x left join c on c.city = x.city and c.moy = month(x.month) cross join g)"""


def customers_in_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("city"))
    return spine.join_unique(customer_panel(spark, sf_dir), nation, ["k"])


@query(f"with {PC}, {_PCN}, {_PROJ} select k, month, round(amt, 6) as amt, src as amt_proj_source, cast(month >= date '{START}' and actual is not null as int) as amt_proj_overridden from pj")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project.project(customers_in_cities(spark, sf_dir), ["amt"], START, "k", "city")
    return out.select("k", "month", r6("amt", "amt"), "amt_proj_source", "amt_proj_overridden")


@query(f"""with {PC}, {_PCN}, {_PROJ} select 'amt' as "column", count(actual) as n, round(avg(abs(amt - actual)), 4) as mae, round(avg(abs(amt - actual) / greatest(abs(actual), 1)), 6) as mape, round(sqrt(avg((amt - actual) * (amt - actual))), 4) as rmse,
  round(quantile_cont(amt - actual, 0.1), 4) as p10, round(quantile_cont(amt - actual, 0.9), 4) as p90, round(avg(case when src = 3 then 1.0 else 0 end), 6) as proj_source_3_ratio, round(avg(case when src = 4 then 1.0 else 0 end), 6) as proj_source_4_ratio,
  max(case when actual is not null then month end) as latest_month from pj where month >= date '{START}'""")
def projection_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = customers_in_cities(spark, sf_dir)
    out = project.drift(panel, project.project(panel, ["amt"], START, "k", "city"), ["amt"], START, "k")
    return out.select("column", "n", *(F.round(c, 4).alias(c) for c in ("mae",)), r6("mape", "mape"), *(F.round(c, 4).alias(c) for c in ("rmse", "p10", "p90")), r6("proj_source_3_ratio", "proj_source_3_ratio"), r6("proj_source_4_ratio", "proj_source_4_ratio"), "latest_month")


@query(f"with {PC}, {_PCN}, {_PROJ} select month, round(avg(case when src > 0 then 1.0 else 0 end), 6) as share, cast(avg(case when src > 0 then 1.0 else 0 end) > 0.85 as int) as too_high from pj where month >= date '{START}' group by month")
def projection_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project.dependence(project.project(customers_in_cities(spark, sf_dir), ["amt"], START, "k", "city"), ["amt"], START)
    return out.select("month", r6("share", "share"), "too_high")


@query(f"""with {PC}, {_PCN}, x as (select *, year(month) * 12 + month(month) as mi from pcn),
  a as (select k, month, amt, city, mi, list(amt) filter (where amt is not null) over (partition by k order by month rows between unbounded preceding and 1 preceding) as hl,
  quantile_cont(amt, 0.5) over (partition by city, month(month) order by mi range between unbounded preceding and 1 preceding) as cmd, count(amt) over (partition by city, month(month) order by mi range between unbounded preceding and 1 preceding) as cn,
  quantile_cont(amt, 0.5) over (order by mi range between unbounded preceding and 1 preceding) as gm from x),
  b as (select *, coalesce(len(hl), 0) as n, list_avg(hl) as am, list_median(hl) as md, list_sum(list_transform(list_reverse(hl)[1:12], lambda v, i: v * pow(0.7, i - 1))) / ((1 - pow(0.7, 12)) / 0.3) as ew from a where amt is not null)
  select k, month, amt as actual, round(greatest({_TIER}, 0), 6) as value, {_SRC} as source, round(abs(greatest({_TIER}, 0) - amt) / greatest(abs(amt), 1), 6) as ape from b""")
def projection_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project.backtest(customers_in_cities(spark, sf_dir), "amt", "k", "city")
    return out.select("k", "month", "actual", r6("value", "value"), "source", r6("ape", "ape"))


# folds and scores
FOLDS = metrics.expanding_folds("2001-05", 4, 3)
_FOLD_SQL = ", ".join(f"('{f.name}', date '{f.first}', date '{f.last}')" for f in FOLDS)
_ROLE = "case when month < a - interval 1 month then 'train' when month < a then 'purge' when month <= b then 'valid' end"


@query(f"with {P}, fo(fold, a, b) as (values {_FOLD_SQL}), x as (select k, month, fold, {_ROLE} as role from p cross join fo) select * from x where role is not null")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.assign_folds(supplier_panel(spark, sf_dir).select("k", "month"), FOLDS)


@query(f"with {P}, fo(fold, a, b) as (values {_FOLD_SQL}), x as (select k, month, fold, {_ROLE} as role from p cross join fo) select fold, role, count(*) as n, min(month) as first, max(month) as last from x where role is not null group by 1, 2")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds(spark, sf_dir).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


_CAPPED = "round(least(greatest(avg(case when y is not null then case when abs(y - greatest(yhat, 0)) / case when y > 0 then y else 1 end <= 1 then 1 - abs(y - greatest(yhat, 0)) / case when y > 0 then y else 1 end else 0 end end), 0), 1), 6)"


@query(f"with {NAIVE} select {_CAPPED} as score from nv where yhat is not null")
def score_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir).where("yhat is not null").agg(r6(metrics.capped_score("y", "yhat"), "score"))


_E = "abs(y - yhat) / greatest(abs(y), 1e-9)"


@query(f"with {NAIVE}, e as (select k, {_E} as ape from nv where yhat is not null and y is not null) select k, round(case when avg(case when ape > 1 then 1.0 else 0 end) > 0.3 then 0 else 1 - avg(case when ape <= 1 then ape end) / avg(case when ape <= 1 then 1.0 else 0 end) end, 6) as score from e group by k")
def score_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(spark, sf_dir).where("yhat is not null and y is not null").groupBy("k").agg(r6(metrics.two_stage_score("y", "yhat"), "score"))


@query(f"""with {NAIVE}, e as (select k, y, yhat from nv where y is not null and yhat is not null) select k, round(avg(abs(yhat - y)), 6) as mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) as rmse, round(avg(abs(yhat - y) / greatest(abs(y), 1e-6)), 6) as mape,
  round(avg(2 * abs(yhat - y) / (abs(y) + abs(yhat) + 1e-6)), 6) as smape, round(1 - avg((yhat - y) * (yhat - y)) / nullif(var_pop(y), 0), 6) as r2, round(avg(case when y <> 0 then case when {_E} <= 1 then 1.0 else 0 end end), 6) as d_ratio, round(avg(case when y <> 0 then case when {_E} > 1 then 1.0 else 0 end end), 6) as ape_gt1_ratio from e group by k""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = naive(spark, sf_dir).where("y is not null and yhat is not null").groupBy("k").agg(*metrics.regression("y", "yhat"), *metrics.error_shares("y", "yhat"))
    return out.select("k", *(r6(c, c) for c in ("mae", "rmse", "mape", "smape", "r2", "d_ratio", "ape_gt1_ratio")))


@query(f"with {NAIVE}, e as (select month, {_E} as ape from nv where yhat is not null and y is not null) select month, count(*) as n, round(avg(ape), 6) as mean_ape, round(case when avg(case when ape > 1 then 1.0 else 0 end) > 0.3 then 0 else 1 - avg(case when ape <= 1 then ape end) / avg(case when ape <= 1 then 1.0 else 0 end) end, 6) as score from e group by month")
def naive_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = naive(spark, sf_dir).where("yhat is not null and y is not null")
    return rows.groupBy("month").agg(F.count("*").alias("n"), r6(F.avg(metrics.ape(F.col("y"), F.col("yhat"))), "mean_ape"), r6(metrics.two_stage_score("y", "yhat"), "score"))


@query(f"""with {P}, a as (select k, month, amt, lag(amt) over w as p1, avg(amt) over (partition by k order by month rows between 3 preceding and 1 preceding) as p2 from p window w as (partition by k order by month)),
  u as (select k, month, p1 as prediction from a where p1 is not null union all select k, month, p2 from a where p2 is not null)
  select k, month, round(greatest(avg(prediction), 0), 6) as prediction, cast(case when month between date '2001-03-01' and date '2001-05-01' then 1.8 else 1.0 end as double) as weight from u group by k, month""")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    p = supplier_panel(spark, sf_dir)
    both = [p.select("k", "month", c.alias("prediction")).where("prediction is not null") for c in (F.lag("amt").over(w), win.rolling("amt", 3, "mean", w))]
    out = models.ensemble(both[0].unionByName(both[1]), ["k", "month"], "prediction")
    return out.select("k", "month", r6("prediction", "prediction"), models.sample_weight("month", "2001-03-01", "2001-05-01").alias("weight"))


@query("""with s as (select o_orderpriority as feature, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v, o_orderstatus as model from orders group by 1, 3), n as (select feature, v / sum(v) over (partition by model) as s from s)
  select feature, round(sum(s), 6) as importance from n group by 1 order by 2 desc limit 50""")
def feature_importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("model")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return metrics.importance(rows, "model", "feature", "v").select("feature", r6("importance", "importance"))


# exploration
@query(f"with {TOTAL}, l as (select month, amt, " + ", ".join(f"lag(qty, {k}) over (order by month) as q{k}" for k in range(7)) + " from t) " + " union all ".join(f"select {k} as lag, round(corr(amt, q{k}), 6) as r from l" for k in range(7)))
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("month")  # one row per month
    lagged = monthly_total(spark, sf_dir).select("amt", *(F.lag("qty", k).over(w).alias(f"q{k}") for k in range(7)))
    wide = lagged.agg(*(F.corr("amt", f"q{k}").alias(f"{k}") for k in range(7)))
    return wide.unpivot([], [f"{k}" for k in range(7)], "lag", "r").select(F.col("lag").cast("int").alias("lag"), r6("r", "r"))


@query(f"with {P}, x as (select k, (year(month) - 1995) * 12 + month(month) - 1 as i, amt from p where amt is not null) select k, round(regr_slope(amt, i), 4) as slope, round(regr_intercept(amt, i), 4) as intercept, round(regr_r2(amt, i), 6) as r2 from x group by k")
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).where("amt is not null").withColumn("i", (F.year("month") - 1995) * 12 + F.month("month") - 1)
    return models.trend(rows, ["k"], "i", "amt").select("k", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2", "r2"))


@query(f"""with {TOTAL}, x as (select (year(month) - 1995) * 12 + month(month) - 1 as i, amt from t), b as (select regr_slope(amt, i) as s, regr_intercept(amt, i) as c, count(*) as n from x),
  e as (select i, amt - (c + s * i) as e, n from x cross join b), q as (select e, n, sum(e) over (order by i rows between unbounded preceding and current row) as c from e) select round(max(abs(c)) / (sqrt(sum(e * e) / (max(n) - 2)) * sqrt(max(n))), 6) as statistic from q""")
def cusum_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monthly_total(spark, sf_dir).withColumn("i", (F.year("month") - 1995) * 12 + F.month("month") - 1)
    return models.cusum(rows, "i", "amt").select(r6("statistic", "statistic"))


@query(f"with {P}, s as (select avg(amt) as ma, stddev_pop(amt) as sa, avg(qty) as mq, stddev_pop(qty) as sq from p) select k, month, round((amt - ma) / sa, 6) as amt, round((qty - mq) / sq, 6) as qty from p cross join s")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.standardise(supplier_panel(spark, sf_dir).select("k", "month", "amt", "qty"), ["amt", "qty"]).select("k", "month", r6("amt", "amt"), r6("qty", "qty"))


@query(f"with {P}, b as (select avg(amt) as ma, avg(qty) as mq from p) select 'amt' as feature, round(2.0 * avg(abs(amt - ma)), 4) as mean_abs_phi from p cross join b union all select 'qty', round(0.5 * avg(abs(qty - mq)), 4) from p cross join b")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.linear_contributions(supplier_panel(spark, sf_dir), {"amt": 2.0, "qty": -0.5})
    return out.select("feature", F.round("mean_abs_phi", 4).alias("mean_abs_phi"))


# text
@query("select doc_id, sha256(text) as digest, length(text) as size from documents")
def hash_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("size"))


@query("""select p_partkey, regexp_replace(lower(trim(p_name)), '[^0-9a-z]+', '_', 'g') as slug, cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') as int) as brand_no, case p_type when 'nothing' then 'x' else regexp_replace(lower(trim(p_type)), '[^0-9a-z]+', '_', 'g') end as kind, p_type <> 'nothing' as unknown from part""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, unknown = fn.mapped("p_type", {"nothing": "x"})
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower(F.trim("p_name")), "[^0-9a-z]+", "_").alias("slug"), fn.sector_id("p_brand").alias("brand_no"), kind.alias("kind"), unknown.alias("unknown"))


# no SQL: learned, iterative or of library functions
@query("""select doc_id, source, regexp_replace(regexp_replace(lower(lang || ' ' || source), '[^0-9a-z]+', '_', 'g'), '^_|_$', '', 'g') as slug from documents""")
def nfkc_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.select("doc_id", fn.nfkc("source").alias("source"), fn.slug(F.concat_ws(" ", "lang", "source")).alias("slug"))


@query()
def poi_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = supplier_panel(spark, sf_dir).groupBy("k").agg(*(f(c).alias(f"{n}_{c}") for c in ("amt", "qty") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("most", F.max))))
    return models.principal(stats, [c for c in stats.columns if c != "k"], 2)[0]


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = supplier_panel(spark, sf_dir).groupBy("k").agg(F.avg("amt").alias("a"), F.avg("qty").alias("q"))
    return models.clusters(stats, ["a", "q"])


@query()
def binseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.breaks(supplier_panel(spark, sf_dir), "k", "month", "amt")


@query()
def keyword_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = search.pivot(event_log(spark, sf_dir), "day", "event_type", "volume", event_types(spark, sf_dir))
    return models.topics(wide, "day", TYPES, 3)


@query()
def keyword_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.mutual_information(metric_lags(spark, sf_dir).join(supplier_panel(spark, sf_dir).select("k", "month", "amt"), ["k", "month"]), ["amt_lag_1", "amt_lag_3", "qty_lag_1"], "amt")


@query(f"""with {P}, x as (select k, month, coalesce(amt, 0) as amt, row_number() over (partition by k order by month desc) as age from p), b as (select k, max(month) as last, avg(case when age <= 12 then amt end) - avg(case when age between 13 and 24 then amt end) as step from x group by k)
  select b.k, cast(last + to_months(cast(13 - age as int)) as date) as month, round(greatest(x.amt + coalesce(step, 0), 0), 6) as forecast from b join x on x.k = b.k where age between 7 and 12""")
def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.seasonal_forecast(supplier_panel(spark, sf_dir).fillna(0.0, ["amt"]), "k", "amt", 6)
    return out.select("k", "month", r6("forecast", "forecast"))


@query()
def tweedie_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_lags(spark, sf_dir).join(supplier_panel(spark, sf_dir).select("k", "month", "amt"), ["k", "month"]).where("amt is not null and amt_lag_12_was_imputed = 0")
    cols = ["amt_lag_1", "amt_lag_12"]
    scaled = rows.withColumns({c: F.log1p(c) for c in cols})
    model = models.tweedie(scaled.where(F.col("month") < F.lit(START).cast("date")), cols, "amt")
    return model.transform(models.assemble(scaled.where(F.col("month") >= F.lit(START).cast("date")), cols)).select("k", "month", "amt", "prediction")


_AT = "max(a) filter (month = date '{}-01')".format


@query(f"""with {P}, q as (select k, month, coalesce(amt, 0) as a from p), y as (select k, {_AT('2001-03')} as a3, {_AT('2001-04')} as a4, {_AT('2001-05')} as a5, {_AT('2000-06')} as l6, {_AT('2000-07')} as l7, {_AT('2000-08')} as l8 from q group by k),
  f1 as (select *, greatest(((a3 + a4 + a5) / 3 + l6) / 2, 0) as x1 from y), f2 as (select *, greatest(((a4 + a5 + x1) / 3 + l7) / 2, 0) as x2 from f1), f3 as (select *, greatest(((a5 + x1 + x2) / 3 + l8) / 2, 0) as x3 from f2)
  select k, date '2001-06-01' as month, round(x1, 6) as prediction from f3 union all select k, date '2001-07-01', round(x2, 6) from f3 union all select k, date '2001-08-01', round(x3, 6) from f3""")
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = win.series("k")
    panel = supplier_panel(spark, sf_dir).select("k", "month", F.coalesce("amt", F.lit(0.0)).alias("amt"))
    features = lambda d: d.select("*", win.rolling("amt", 3, "mean", w).alias("m3"), F.lag("amt", 12).over(w).alias("l12"))
    predict = lambda d, _: d.withColumn("prediction", (F.coalesce("m3", F.lit(0.0)) + F.coalesce("l12", "m3", F.lit(0.0))) / 2)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelmill-"))  # none is named: a local run
    out = forecast.recursive_forecast(panel, "amt", "k", ["2001-06-01", "2001-07-01", "2001-08-01"], features, predict, lambda d: d.checkpoint())
    return out.select("k", "month", r6("prediction", "prediction"))


@query("select * from (values ('growth', 2), ('lags', 8), ('log1p', 1), ('rolling', 6), ('zscore', 1)) as t(category, n)")
def feature_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = standard_plan(["amt", "qty"], "k")
    out = plan.budget(plan.guard(plan.build(supplier_panel(spark, sf_dir).drop("n")), ["qty"]), 20)
    return category_counts(plan, out).withColumn("n", F.col("n").cast("int"))


# preparation
@query("""with r as (select p_partkey as id, 'sector ' || p_partkey as name, row_number() over (order by p_partkey) as natural_rank, row_number() over (order by 'sector ' || p_partkey) as text_rank from part)
  select id, cast(natural_rank as int) as natural_rank, cast(text_rank as int) as text_rank from r where natural_rank <= 500""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of ``sector N`` by its number and by its text: ordered runs, no window over the whole table."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("sector "), F.col("p_partkey")).alias("name"))
    last = lambda keys: [c.asc_nulls_last() for c in keys]
    return spine.ranked(spine.ranked(parts, last(fn.natural_key("name")), "natural_rank"), last([F.col("name")]), "text_rank").where("natural_rank <= 500").select("id", "natural_rank", "text_rank")


@query("select p_partkey, cast(p_size as tinyint) as p_size, cast(p_partkey % 30000 as smallint) as small_key from part")
def downcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 30000).alias("small_key"))
    return fn.downcast(rows, {"p_size": "tinyint", "small_key": "smallint"})


@query(f"with {PC} select k, month, last_value(amt ignore nulls) over (order by k, month rows between unbounded preceding and current row) as amt from pc")
def fill_in_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_ungrouped(customer_panel(spark, sf_dir), "amt", ["k", "month"]).select("k", "month", "amt")


@query(f"with {P} select k, month, coalesce(amt, 0) as amt, coalesce(qty, 0) as qty, cast(amt is null as int) as amt_was_missing, cast(qty is null as int) as qty_was_missing from p")
def search_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.fill_search(supplier_panel(spark, sf_dir).drop("n"), ["amt", "qty"]).select("k", "month", "amt", "qty", "amt_was_missing", "qty_was_missing")


@query(f"""with {PC}, h as (select k, month, case when month < date '{START}' then coalesce(last_value(case when month < date '{START}' then amt end ignore nulls) over (partition by k order by month), 0) else amt end as amt from pc) select * from h""")
def masked_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = win.masked_fill(F.col("amt"), "amt", F.col("month") < F.lit(START).cast("date"), win.series("k"), customer_panel(spark, sf_dir))
    return rows.select("k", "month", "amt")


@query("""with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) select o_custkey, o_orderkey, o_totalprice from r where rn = 1""")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"with {P} select k, month, amt, cast(0.0 as double) as absent, (coalesce(amt, 0) + coalesce(qty, 0)) / nullif(cast(amt is not null as int) + cast(qty is not null as int), 0) as mean from p")
def aligned_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir)
    return fn.align(rows.withColumn("mean", fn.mean_across(["amt", "qty"])), ["k", "month", "amt", "absent", "mean"])


@query("""with s as (select avg(p_retailprice) as mp, stddev_pop(p_retailprice) as sp, avg(p_size) as ms, stddev_pop(p_size) as ss from part)
  select p_partkey, round(p_size * ((p_retailprice - mp) / sp + (p_size - ms) / ss) / 2, 6) as density_x_search from part cross join s""")
def density_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("density"), F.col("p_retailprice").alias("z1"), F.col("p_size").cast("double").alias("z2"))
    out = cross.density_search(models.standardise(rows, ["z1", "z2"]), ["density"], ["z1", "z2"])
    return out.select("p_partkey", r6("density_x_search", "density_x_search"))


_TWO = """a as (select k, month, amt as y, lag(amt) over w as naive, avg(amt) over (partition by k order by month rows between 3 preceding and 1 preceding) as mean3 from p window w as (partition by k order by month)),
  u as (select 'naive' as model, k, month, y, naive as yhat from a union all select 'mean3', k, month, y, mean3 from a)"""


@query(f"""with {P}, {_TWO}, fo(fold, a, b) as (values {_FOLD_SQL}), s as (select model, fold, {_CAPPED} as score from u join fo on month between a and b group by 1, 2), mm as (select model, round(avg(score), 6) as mean_score from s group by 1)
  select s.model, fold, score, mean_score, s.model = (select model from mm order by mean_score desc, model limit 1) as best_model, row_number() over (partition by s.model order by score desc, fold) = 1 as best_fold from s join mm on mm.model = s.model""")
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per model and fold, mean scores, the best model and each model's best fold."""
    w = win.series("k")
    rows = supplier_panel(spark, sf_dir).select("k", "month", F.col("amt").alias("y"), F.lag("amt").over(w).alias("naive"), win.rolling("amt", 3, "mean", w).alias("mean3"))
    long = rows.unpivot(["k", "month", "y"], ["naive", "mean3"], "model", "yhat")
    valid = metrics.assign_folds(long, FOLDS).where("role = 'valid'")
    scores = valid.groupBy("model", "fold").agg(r6(metrics.capped_score("y", "yhat"), "score"))
    out = metrics.best_of_folds(scores)
    return out.select("model", "fold", "score", r6("mean_score", "mean_score"), "best_model", "best_fold")


@query(f"""with {P}, x as (select amt as y, qty as a, cast(n as double) as b from p where amt is not null), s as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) * count(*) as aa, var_pop(b) * count(*) as bb, covar_pop(a, b) * count(*) as ab, covar_pop(a, y) * count(*) as ay, covar_pop(b, y) * count(*) as by_, var_pop(y) * count(*) as yy from x),
  c as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as cb from s), e as (select *, (yy - ca * ay - cb * by_) / (n - 3) as s2 from c)
  select 'qty' as feature, round(ca, 3) as coefficient, round(sqrt(s2 * bb / (aa * bb - ab * ab)), 3) as std_error, round(ca / sqrt(s2 * bb / (aa * bb - ab * ab)), 3) as t from e
  union all select 'n', round(cb, 3), round(sqrt(s2 * aa / (aa * bb - ab * ab)), 3), round(cb / sqrt(s2 * aa / (aa * bb - ab * ab)), 3) from e""")
def ols_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.ols(supplier_panel(spark, sf_dir).where("amt is not null"), ["qty", "n"], "amt")
    return out.where("feature <> '(intercept)'").select("feature", *(F.round(c, 3).alias(c) for c in ("coefficient", "std_error", "t")))


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = target_lags(spark, sf_dir).join(supplier_panel(spark, sf_dir).select("k", "month", "amt"), ["k", "month"])
    return rows.where("amt is not null and amt_lag_12_was_imputed = 0").select("k", "month", "amt", "amt_lag_1", "amt_lag_12")


@query()
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of boosted trees, normalised."""
    rows = _lagged(spark, sf_dir)
    model = models.boosted(rows.where(F.col("month") < F.lit(START).cast("date")), ["amt_lag_1", "amt_lag_12"], "amt", maxIter=3)
    return metrics.importance(models.gains(spark, model, ["amt_lag_1", "amt_lag_12"], "boosted"), "model", "feature", "gain")


@query()
def learner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, validate and choose over purged folds: ridge and boosted learners against the naive forecast."""
    cols = ["amt_lag_1", "amt_lag_12"]
    learners = {"naive": None, "ridge": lambda d: models.ridge(d, cols, "amt"), "boosted": lambda d: models.boosted(d, cols, "amt", maxIter=3)}
    return metrics.best_of_folds(models.validated(_lagged(spark, sf_dir), FOLDS[-2:], learners, cols, "amt", "amt_lag_1"))


# files: written to the shared folder and read again
@query(f"with {P} select k, month, amt, qty, n, cast(year(month) as int) as year from p where month between date '1997-03-01' and date '1999-10-01'")
def panel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel by year, read between two months: partitions and row groups are pruned."""
    path = files.scratch_dir(spark)
    files.write_panel(supplier_panel(spark, sf_dir), path)
    return files.scan_parquet(spark, path, "1997-03-01", "1999-10-01").select("k", "month", "amt", "qty", "n", "year")


@query("""select cast(date_trunc('month', o_orderdate) as date) as month, cast(o_orderkey as varchar) as order_key, case when o_orderkey % 10 = 0 then null else cast(o_totalprice as double) end as total_price, o_orderpriority as priority_text from orders""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns with untidy names: typed, coerced and trimmed on the way in."""
    rows = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    text = rows.select(F.date_format("o_orderdate", "yyyy-MMM").alias("Month"), F.col("o_orderkey").alias("Order  Key"), price.alias("Total-Price"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("Priority (text)"))
    path = files.scratch_dir(spark)
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = files.scan_csv(spark, files.Source(path, ("order_key", "priority_text"), ("month", "total_price")))
    return out.select("month", "order_key", "total_price", F.trim("priority_text").alias("priority_text"))


@query("""select r_regionkey as id, r_name as name, null as nation, 'a' as part from region union all select n_nationkey, null, n_name, 'b' from nation""")
def scan_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs of files with different columns, united by name."""
    base = files.scratch_dir(spark)
    files.write_single(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("a").alias("part")), f"{base}/a")
    files.write_single(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"), F.lit("b").alias("part")), f"{base}/b")
    return files.scan_many(spark, f"{base}/a/*.parquet", f"{base}/b/*.parquet").select("id", "name", "nation", "part")


@query("select r_regionkey, cast(count(*) as bigint) as n from (select r_regionkey from region union all select r_regionkey from region where r_regionkey > 1) group by 1")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_dir(spark)
    rows = table(spark, sf_dir, "region").select("r_regionkey")
    files.append(rows, path)
    files.append(rows.where("r_regionkey > 1"), path)
    return spark.read.schema("r_regionkey bigint").json(path).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("select 'absent.txt' as name, cast(1 as bigint) as size, 'x' as sha256")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against a manifest of theirs and one file more."""
    path = files.scratch_dir(spark)
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.text(path)
    found = files.file_manifest(spark, f"{path}/part-*")
    more = spark.sql("select 'absent.txt' as name, 1L as size, 'x' as sha256")
    bad = quality.integrity(spark.read.format("binaryFile").load(f"{path}/part-*"), files.snapshot(found.unionByName(more), files.scratch_dir(spark)))
    return bad.select("name", "size", "sha256")


@query("select 'sector_' || n_nationkey as found from nation union all select 'sector_0' from nation where n_nationkey = 3")
def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch_dir(spark)
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("# see [sector_"), "n_nationkey", F.lit("] and"), F.when(F.col("n_nationkey") == 3, " [sector_0]").otherwise(" [other]")).alias("value"))
    lines.write.text(path)
    return files.extract_text(spark, path, r"\[(sector_\d+)\]")


@query(f"""with {P}, s as (select strftime(month, '%Y %b') || '_sector ' || k as id, coalesce(qty, 0) as prediction from p where month > date '2001-03-01') select * from s""")
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).select("month", fn.panel_id("month", "k").alias("id"), F.coalesce("qty", F.lit(0.0)).alias("prediction"))
    return forecast.submission(rows.where(F.col("month") > F.lit("2001-03-01").cast("date")).select("id"), rows.select("id", "prediction"))


@query(f"with {NAIVE} select {_CAPPED} as score from nv where yhat is not null")
def score_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = metrics.ScoreEvaluator("y", "yhat").evaluate(naive(spark, sf_dir).where("yhat is not null"))
    return spark.createDataFrame([(score,)], "score double").select(r6("score", "score"))


@query(f"""with {P}, x as (select amt as y, qty as a, cast(n as double) as b from p where amt is not null), s as (select covar_pop(a, b) as ab, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from x)
  select 'qty' as feature, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) as coefficient from s union all select 'n', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 3) from s""")
def ridge_without_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = models.ridge(supplier_panel(spark, sf_dir).where("amt is not null"), ["qty", "n"], "amt", 0.0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(["qty", "n"], model.coefficients)], "feature string, coefficient double").select("feature", F.round("coefficient", 3).alias("coefficient"))


@query("select 'price' as name union all select 'size' from part having abs(corr(p_retailprice, p_size)) <= 0.98")
def uncorrelated_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 2 + 1).alias("double"), F.col("p_size").cast("double").alias("size"))
    return spark.createDataFrame([(n,) for n in search.uncorrelated(rows, ["price", "double", "size"])], "name string")


@query("""with t as (select o_custkey as k, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1), r as (select *, row_number() over (order by total desc, k) as r from t)
  select k, total, cast((r - 1) // 16 as int) as page from r where r <= 40""")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 greatest totals, 16 to a page."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    best = totals.orderBy(F.desc("total"), "k").limit(40)
    return spine.ranked(best, [F.desc("total"), F.col("k")], "r").select("k", "total", F.floor((F.col("r") - 1) / 16).cast("int").alias("page"))


@query(f"""with {P}, t as (select k, month, amt, qty, n, lag(amt) over (partition by k order by month) as l from p) select k, month, round(coalesce(amt / nullif(l, 0), 0), 6) as ratio, round(amt - qty * 1000, 6) as residual from t""")
def ratios_and_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier_panel(spark, sf_dir).withColumn("l", F.lag("amt").over(win.series("k")))
    return rows.select("k", "month", r6(fn.ratio(F.col("amt"), F.col("l")), "ratio"), r6(F.col("amt") - F.col("qty") * 1000, "residual"))


@query()
def informative_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_lags(spark, sf_dir).join(supplier_panel(spark, sf_dir).select("k", "month", "amt"), ["k", "month"])
    return search.informative(rows, ["amt_lag_1", "amt_lag_3", "qty_lag_1", "qty_lag_12"], "amt", "month", 3)


@query()
def guarded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose derived features go, by drift and back-test."""
    gone = project.suppressed(projection_drift(spark, sf_dir), projection_backtest(spark, sf_dir))
    return spark.createDataFrame([(c, c in gone) for c in ("amt",)], "column string, suppressed boolean")


@query()
def random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of a ridge penalty, each scored on the last fold."""
    rows = metrics.assign_folds(_lagged(spark, sf_dir), FOLDS[-1:])
    cols = ["amt_lag_1", "amt_lag_12"]
    train, valid = rows.where("role = 'train'"), models.assemble(rows.where("role = 'valid'"), cols)
    score = lambda c: metrics.ScoreEvaluator("amt", "prediction").evaluate(models.ridge(train, cols, "amt", c["alpha"]).transform(valid))
    _, best, log = models.random_search({"alpha": lambda rng: rng.uniform(0, 5)}, score, 3)
    return spark.createDataFrame([(t["trial"], t["config"]["alpha"], float(t["score"]), t["score"] == best) for t in log], "trial int, alpha double, score double, best boolean")

"""Operators on small frames: the cases that the tables don't hold."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.functions import columns as fn
from panelmill.operators import impute, metrics, models, project, quality, quantiles, search, spine
from panelmill.operators import windows as win
from panelmill.plans import catalogue
from panelmill.plans.feature_plan import standard_plan
from panelmill.sources import files
from panelmill.streaming import events


def months(n, start=(2019, 1)):
    return [dt.date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1) for i in range(n)]


def frame(spark, values, key=1):
    return spark.createDataFrame([(key, m, v) for m, v in zip(months(len(values)), values)], "k int, month date, x double")


def column(df, name, order="month"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


@pytest.mark.parametrize("truth,guess,want", [([100, 200, 300, 400], [100, 200, 300, 400], 1.0), ([100, 200, 300, 400], [0, 200, 300, 400], 0.75), ([100, 200, 300, 400], [0, 0, 0, 0], 0.0), ([100, 200, 300, 400], [150, 210, 330, 410], 1 - np.mean([0.5, 0.05, 0.1, 0.025])), ([100, 200, 300, 400], [50, 450, 700, 380], 0.0)])
def test_two_stage(spark, truth, guess, want):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(truth, guess)], "y double, p double")
    assert df.agg(metrics.two_stage_score("y", "p", clip=True)).first()[0] == pytest.approx(want)


def test_scores_at_the_edges(spark):
    df = spark.createDataFrame([(100.0, 50.0), (200.0, 450.0), (300.0, 700.0), (400.0, 380.0), (None, 1.0)], "y double, p double")
    assert df.agg(metrics.capped_score("y", "p")).first()[0] == pytest.approx(0.3625)
    assert metrics.ScoreEvaluator("y", "p").evaluate(df) == pytest.approx(0.3625)
    none = df.where("y is null")
    assert none.agg(metrics.capped_score("y", "p"), metrics.two_stage_score("y", "p")).first()[:] == (0.0, 0.0)
    just = spark.createDataFrame([(1.0, 1.0)] * 7 + [(1.0, 3.0)] * 3, "y double, p double")
    assert just.agg(metrics.two_stage_score("y", "p")).first()[0] == 1.0
    zero = spark.createDataFrame([(0.0, -5.0), (0.0, 0.5)], "y double, p double")
    assert zero.agg(metrics.capped_score("y", "p")).first()[0] == pytest.approx(0.75)


@pytest.mark.parametrize("n", [1, 3, 6, 12])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_rolling_is_as_pandas(spark, n, least):
    rng = np.random.default_rng(n)
    values = [None if rng.random() < 0.3 else float(rng.integers(0, 50)) for _ in range(40)]
    w = win.series("k")
    df = frame(spark, values).select("month", *(win.rolling("x", n, s, w, min(least, n)).alias(s) for s in ("mean", "std", "min", "max", "median")), win.rolling("x", n, "count", w).alias("count"))
    shifted = pd.Series(values, dtype=float).shift(1)
    roll = shifted.rolling(n, min_periods=min(least, n))
    want = {"mean": roll.mean(), "std": roll.std(ddof=0), "min": roll.min(), "max": roll.max(), "median": roll.median(), "count": shifted.rolling(n, min_periods=0).count()}
    for name, series in want.items():
        got = pd.Series(column(df, name), dtype=float)
        np.testing.assert_allclose(got, series, atol=1e-6, err_msg=name)


def test_fills(spark):
    w = win.series("k")
    df = frame(spark, [None, 1.0, None, None, 4.0, None])
    out = df.select("month", win.ffill("x", w).alias("f"), win.bfill("x", w).alias("b"))
    assert column(out, "f") == [None, 1.0, 1.0, 1.0, 4.0, 4.0] and column(out, "b") == [1.0, 1.0, 4.0, 4.0, 4.0, None]
    line = win.interpolate(df, "x", w)
    assert column(line, "x") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0] and column(line, "x_was_interpolated") == [1, 0, 1, 1, 0, 1]
    masked = win.masked_fill(F.col("x"), "y", F.col("month") < F.lit("2019-05-01"), w, df)
    assert column(masked, "y") == [0.0, 1.0, 1.0, 1.0, 4.0, None]


def test_imputation_layers(spark):
    lead = frame(spark, [None, None, 3.0, None, 5.0, None]).unionByName(frame(spark, [None] * 6, 2))
    out = {(r.k, r.month.month): (r.x, r.x_src) for r in impute.fill_history(lead, "x", "k", "2019-06-01").collect()}
    assert [out[1, m] for m in range(1, 7)] == [(3.0, 4), (3.0, 4), (3.0, 0), (3.0, 1), (5.0, 0), (None, None)]
    assert out[2, 1] == (3.0, 4) and out[2, 6] == (None, None)
    assert {r.x for r in impute.fill_counts(frame(spark, [None] * 3), "x", "k").collect()} == {0.0}
    v2 = {(r.k, r.month.month): (r.x, r.x_src) for r in impute.fill_counts(lead, "x", "k").collect()}
    assert v2[1, 6] == (5.0, 1) and v2[2, 3] == (3.0, 3) and v2[1, 1][1] == 4
    counts = {(r.layer, r.stage): r.filled for r in impute.audit(impute.fill_counts(lead, "x", "k"), "x", "2019-06-01").collect()}
    assert sum(counts.values()) == 10


@pytest.mark.parametrize("n,source", [(0, 4), (1, 4), (2, 4), (3, 2), (5, 2), (6, 2), (11, 2), (12, 1), (13, 1)])
def test_projection_tiers(spark, n, source):
    values = [float(i * i % 17) for i in range(n)]
    rows = [(1, m, v, 7) for m, v in zip(months(14), [*values, *[None] * (14 - n)])]
    df = spark.createDataFrame(rows, "k int, month date, x double, city int")
    out = project.project(df, ["x"], "2020-02-01", "k", "city").where("month >= '2020-02-01'").first()
    w = np.array([0.7 ** (11 - i) for i in range(12)])
    want = w @ values[-12:] / w.sum() if n >= 12 else np.mean(values) if n >= 6 else np.median(values) if n >= 1 else 0.0
    assert out.x_proj_source == source and out.x == pytest.approx(max(want, 0)) and out.x_proj_overridden == 0


def test_projection_city_tier_and_cut(spark):
    rows = [(k, dt.date(2019, 2, 1), float(k), 7) for k in (1, 2, 3)] + [(4, dt.date(2020, 2, 1), 9.0, 7)] + [(5, m, -1.0, 8) for m in months(13)]
    out = {(r.k, r.month): r for r in project.project(spark.createDataFrame(rows, "k int, month date, x double, city int"), ["x"], "2020-01-01", "k", "city").collect()}
    got = out[4, dt.date(2020, 2, 1)]
    assert (got.x, got.x_proj_source, got.x_proj_overridden) == (2.0, 3, 1)
    assert out[5, dt.date(2020, 1, 1)].x == 0.0 and out[1, dt.date(2019, 2, 1)].x_proj_source == 0


def test_guard_lists(spark):
    drifts = spark.createDataFrame([("a", 0.9, 0.0, 0.0), ("b", 0.1, 0.5, 0.4), ("c", 0.1, 0.1, 0.1), ("d", None, 0.0, 0.0)], "column string, mape double, proj_source_3_ratio double, proj_source_4_ratio double")
    apes = spark.createDataFrame([(i / 10,) for i in range(11)], "ape double")
    assert project.suppressed(drifts, apes) == ["a", "b"]


def test_spines(spark):
    facts = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0), (2, dt.date(2020, 3, 1), 2.0)], "k int, month date, x double")
    assert spine.densify(facts, "k").count() == 6 and spine.densify(facts, "k", until="2020-05-01").count() == 10
    assert quality.missing_months(facts, "k").count() == 4
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, name string")
    with pytest.raises(Exception, match="several rows"):
        spine.join_unique(facts, twice, ["k"]).collect()
    with pytest.raises(ValueError):
        spine.require_covered(facts, twice, ["k"])
    last = spine.keep_one(twice.withColumn("line", F.monotonically_increasing_id()), ["k"], [F.desc("line")])
    assert [r.name for r in last.collect()] == ["b"]


def test_annual(spark):
    df = spark.createDataFrame([(2019, 100.0), (2020, 110.0), (2021, 121.0), (2022, None)], "yr int, v double")
    out = {r.yr: r.v for r in spine.extrapolate_annual(df, "yr", "v", 2023).where("is_extrapolated = 1").collect()}
    assert out == {2022: pytest.approx(133.1), 2023: pytest.approx(133.1)}
    down = spark.createDataFrame([(2019, -4.0), (2020, 0.0)], "yr int, v double")
    assert spine.extrapolate_annual(down, "yr", "v", 2021).where("yr = 2021").first().v == 4.0
    monthly = spine.annual_to_monthly(df.where("v is not null"), "yr", ["v"], spark.createDataFrame([(m,) for m in months(48)], "month date"))
    assert column(monthly, "v")[-1] == 121.0 and column(monthly, "v_was_interpolated")[:2] == [0, 1]


def test_texts(spark):
    df = spark.createDataFrame([(" Ｆｕｌｌ ", "买房 政策"), (None, None), ("é", "卖房")], "a string, b string")
    assert [tuple(r) for r in df.select(fn.nfkc("a"), fn.slug("b")).collect()] == [("Full", "买房_政策"), (None, None), ("é", "卖房")]
    assert fn.snake_case("﻿Total Price (per unit)") == "total_price_per_unit"
    parsed = spark.createDataFrame([("2019-Jan",), ("2019-03-15",), ("2024 Aug",), ("x",)], "m string").select(fn.month_of("m")).collect()
    assert [r[0] for r in parsed] == [dt.date(2019, 1, 1), dt.date(2019, 3, 1), dt.date(2024, 8, 1), None]
    assert [r[0] for r in spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "x string").select(fn.number("x")).collect()] == [1.5, None, None, None]
    assert fn.select_columns(["num_a", "b_dense", "c"], ("num_",), ("_dense",), {"num_x"}) == ["num_a", "b_dense"]


def test_models():
    y = np.concatenate([np.zeros(20), np.full(20, 5.0)]) + np.random.default_rng(1).normal(0, 0.1, 40)
    assert models.split_series(y) == [20] and models.split_series(np.ones(30)) == []
    m = np.random.default_rng(0).random((12, 3)) @ np.random.default_rng(1).random((3, 8))
    a, b = models.factorise(m, 3, 2000)
    assert np.abs(a @ b - m).max() < 0.05 and (a >= 0).all()
    assert models.kolmogorov_tail(1.36) == pytest.approx(0.049, abs=1e-3) and models.kolmogorov_tail(0) == 1.0
    best, score, log = models.random_search({"x": lambda r: r.uniform(-3, 3)}, lambda c: -((c["x"] - 1) ** 2), 40)
    assert len(log) == 40 and score == -((best["x"] - 1) ** 2) > -0.2


def test_learners(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), float(3 * a - b + 1)) for a, b in rng.normal(size=(200, 2))], "a double, b double, y double")
    ridge = models.ridge(df, ["a", "b"], "y", 0.01)
    assert ridge.coefficients.toArray() == pytest.approx([3, -1], abs=0.05)
    gbt = models.boosted(df, ["a", "b"], "y", maxIter=5)
    assert gbt.featureImportances.toArray()[0] > 0.5
    pcs, explained = models.principal(df, ["a", "b", "y"], 2, log=False)
    assert sum(explained) == pytest.approx(1, abs=1e-6) and pcs.count() == 200
    flat = models.standardise(df.withColumn("c", F.lit(4.0)), ["c"])
    assert {r.c for r in flat.collect()} == {0.0}


def test_keywords(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float((i * 37) % 11)) for i in range(30)], "a double, b double, c double")
    assert search.uncorrelated(df, ["a", "b", "c"]) == ["a", "c"]
    mi = {r["column"]: r.mi for r in search.mutual_information(df.withColumn("k", F.lit(1.0)), ["b", "c", "k"], "a").collect()}
    assert mi["b"] > mi["c"] >= 0 and mi["k"] == 0


def test_plan_budget_and_guard(spark):
    plan = standard_plan(["x"], "k")
    out = plan.build(frame(spark, [1.0] * 15))
    total = sum(plan.inventory().values())
    assert total == len(out.columns) - 3
    out = plan.budget(out, total - 3)
    assert sum(plan.inventory(most=total - 3).values()) == total - 3 == len(out.columns) - 3
    out = plan.guard(out, ["x"])
    assert all("_lag_" in c for own in plan.catalogue.values() for c in own)
    with pytest.raises(ValueError):
        plan.inventory(least=100)


def test_files(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("﻿Month,Sector,Amount New\n2019-Jan,sector 1,5\n2019-Feb,sector 2,bad\n", encoding="utf-8")
    df = files.scan_csv(spark, files.Source(str(csv), ("sector",)))
    assert [tuple(r) for r in df.orderBy("month").collect()] == [(dt.date(2019, 1, 1), "sector 1", 5.0), (dt.date(2019, 2, 1), "sector 2", None)]
    with pytest.raises(ValueError):
        files.scan_csv(spark, files.Source(str(csv), ("city",)))
    out = str(tmp_path / "panel")
    files.write_panel(df, out)
    assert files.scan_parquet(spark, out, since="2019-02-01").count() == 1 and os.path.isdir(f"{out}/year=2019")
    manifest = files.file_manifest(spark, str(csv))
    assert quality.integrity(spark.read.format("binaryFile").load(str(csv)), manifest).count() == 0
    assert quality.integrity(spark.read.format("binaryFile").load(str(csv)), manifest.withColumn("size", F.lit(1).cast("long"))).count() == 1
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append(df.select("sector"), log)
    assert spark.read.json(log).count() == 4
    assert files.markdown(df.select("sector")).startswith("| sector |")
    (tmp_path / "p.yaml").write_text("a: x/a.csv  # here\nb: /abs\n")
    paths = files.Paths.load(str(tmp_path / "p.yaml"))
    assert paths["a"] == str(tmp_path / "x/a.csv") and paths["b"] == "/abs"
    assert files.scan_many(spark, f"{out}/*/*.parquet").count() == 2
    assert sorted(r.found for r in files.extract_text(spark, str(csv), r"sector (\d)").collect()) == ["1", "2"]


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_totals(events.read_events(spark, str(tmp_path / "in"), batch.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(events.windowed_totals(batch))
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_window_without_partition_is_for_calendars_only(spark):
    w = Window.orderBy("month")
    assert column(frame(spark, [1.0, None]).select("month", win.ffill("x", w).alias("f")), "f") == [1.0, 1.0]


@pytest.mark.parametrize("accuracy", [100, 10_000])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 1.0])
def test_quantiles_by_selection(spark, q, accuracy):
    """Exact in groups of any size, with ties, nulls and a null group."""
    rng = np.random.default_rng(3)
    data = [(None if k == 9 else k, None if rng.random() < 0.1 else float(rng.choice([rng.normal(), 0.0, 7.0]))) for k in range(12) for _ in range(int(rng.choice([1, 2, 3, 50, 999])))]
    data += [(50, None)]
    df = spark.createDataFrame(data, "k int, x double")
    known = pd.DataFrame(data, columns=["k", "x"]).dropna(subset="x")
    known["k"] = known["k"].fillna(-1)
    want = {k: (np.percentile(x, 100 * q), len(x)) for k, x in known.groupby("k")["x"]}
    got = {-1 if r.k is None else r.k: (r.value, r.n) for r in quantiles.exact_quantile(df, "x", q, ["k"], accuracy).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(v), n) for k, (v, n) in want.items())
    assert quantiles.exact_quantile(df, "x", q, accuracy=accuracy).first()[:] == (pytest.approx(np.percentile(known["x"], 100 * q)), len(known))
    assert quantiles.exact_quantile(df.limit(0), "x").first()[:] == (None, 0)
    both = quantiles.exact_quantiles(df.withColumn("y", -F.col("x")), ["x", "y"], q).first()
    assert both.x_n == both.y_n == len(known) and both.y_q == pytest.approx(-np.percentile(known["x"], 100 * (1 - q)))


def test_missing_predictions_score_nothing(spark):
    df = spark.createDataFrame([(0.0, None), (10.0, 10.0), (5.0, None), (None, 1.0)], "y double, p double")
    assert df.agg(metrics.capped_score("y", "p")).first()[0] == pytest.approx(1 / 3)


def test_row_order_fill_and_ranks(spark):
    rng = np.random.default_rng(5)
    data = [(k, i, None if rng.random() < 0.6 or k == 1 else float(i)) for k in range(1, 40) for i in range(7)]
    df = spark.createDataFrame(data, "k int, i int, x double").repartition(5)
    got = impute.fill_ungrouped(df, "x", ["k", "i"]).orderBy("k", "i").collect()
    assert [r.x for r in got] == pd.Series([x for *_, x in data], dtype=float).ffill().replace({np.nan: None}).tolist()
    names = spark.createDataFrame([(f"sector {n}",) for n in (10, 9, 1, 100, 11)], "name string")
    assert [r.name for r in spine.ranked(names, fn.natural_key("name"), "r").orderBy("r").collect()] == [f"sector {n}" for n in (1, 9, 10, 11, 100)]


def test_ranks_of_more_rows_than_the_borders_sample(spark):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("sector "), F.col("id")).alias("name"), "id", F.sha1(F.col("id").cast("string")).alias("more"))
    got = spine.ranked(spine.ranked(df, fn.natural_key("name"), "number"), [F.desc("name")], "text").select("id", "number", "text").toPandas().set_index("id").sort_index()
    assert got.number.tolist() == list(range(1, n + 1))
    assert got.text.sort_values().index.tolist() == sorted(range(n), key=str, reverse=True) and set(got.text) == set(range(1, n + 1))


def test_natural_order_ranks_a_missing_key_last(spark, tmp_path):
    spark.createDataFrame([(10,), (None,), (9,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(map(tuple, catalogue.queries()["natural_order"](spark, str(tmp_path)).collect()), key=str) == [(10, 2, 1), (9, 1, 2), (None, 3, 3)]


def test_downcast_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1,), (None,)], "a long")
    assert dict(fn.downcast(df, {"a": "tinyint"}).dtypes) == {"a": "tinyint"}
    with pytest.raises(Exception, match="does not fit"):
        fn.downcast(spark.createDataFrame([(300,)], "a long"), {"a": "tinyint"}).collect()


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - (i % 3) + 1) for i in range(30)], "a double, b double, y double")
    model = models.ridge(df, ["a", "b"], "y", 0.0)
    models.save(model, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    assert type(again) is type(model) and np.allclose(again.coefficients.toArray(), model.coefficients.toArray())
    fitted = {r.feature: r.coefficient for r in models.ols(df.withColumn("y", F.col("y") + F.sin("a")), ["a", "b"], "y").collect()}
    x = np.array([[i, i % 3, 1.0] for i in range(30)])
    assert np.allclose([fitted[f] for f in ("a", "b", "(intercept)")], np.linalg.lstsq(x, np.array([2.0 * i - (i % 3) + 1 + np.sin(i) for i in range(30)]), rcond=None)[0])
    assert models.monotone_vector(["a", "b", "c"], {"a"}, {"c"}) == [1, 0, -1]


def test_density_and_search(spark):
    from panelmill.operators import cross

    df = spark.createDataFrame([(2.0, 1.0, 3.0), (4.0, None, 1.0), (1.0, None, None)], "d double, z1 double, z2 double")
    assert [r.d_x_search for r in cross.density_search(df, ["d"], ["z1", "z2"]).collect()] == [4.0, 4.0, None]


def test_nested_settings_folders_and_versions(spark, tmp_path):
    text = "# paths\n---\nbase:\n  raw: data/raw  # folder\n  deep:\n    a: 'it''s # here'\n  b: \"x: \\\"y\\\"\"\nseed: 29\nurl: s3://a/b#c\n"
    assert files.read_yaml(text) == {"base.raw": "data/raw", "base.deep.a": "it's # here", "base.b": 'x: "y"', "seed": "29", "url": "s3://a/b#c"}
    with pytest.raises(ValueError):
        files.read_yaml("- a\n- b\n")
    files.write_text(text, str(tmp_path / "c.yaml"))
    assert files.Paths.load(str(tmp_path / "c.yaml"))["base.raw"] == str(tmp_path / "data/raw")
    folder = files.fresh_folder(str(tmp_path / "out"))
    files.write_json({"a": {"b": [1, None, "é"]}}, f"{folder}/r.json")
    files.move(folder, str(tmp_path / "kept"))
    assert "é" in files.read_text(str(tmp_path / "kept" / "r.json"))
    with pytest.raises(FileExistsError):
        files.move(files.fresh_folder(folder), str(tmp_path / "kept"))
    assert files.snapshot(spark.range(3), str(tmp_path / "s")).count() == 3
    files.require_versions(spark, {"spark": "3.5", "numpy": "1.20"})
    with pytest.raises(RuntimeError):
        files.require_versions(spark, {"spark": "99.0"})

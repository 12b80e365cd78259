"""Every query against its SQL in DuckDB, and the ones without SQL by their invariants."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from panelmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, (bool, int, float)) or type(v).__name__ == "Decimal":
        return (1, float(v))
    return (2, str(v))


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in got)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    out = catalogue.queries()[name](spark, sf_dir)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(out.columns) == sorted(names)
    assert rows(out.columns, out.collect()) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql(spark, sf_dir, name):
    out = catalogue.queries()[name](spark, sf_dir)
    got = out.collect()
    assert got
    checks = {
        "poi_pca": lambda: abs(sum(r.pc_1 * r.pc_2 for r in got)) < 1e-6 * sum(r.pc_1**2 for r in got) + 1e-6,
        "kmeans": lambda: len({r.cluster for r in got}) <= 4,
        "keyword_topics": lambda: all(r.weight >= 0 for r in got),
        "keyword_information": lambda: all(0 <= r.mi <= math.log(8) + 1e-9 for r in got),
        "tweedie_forecast": lambda: all(r.prediction > 0 for r in got),
        "gain_importance": lambda: abs(sum(r.importance for r in got) - 1) < 1e-9,
        "learner_folds": lambda: len(got) == 6 and sum(r.best_fold for r in got) == 3 and len({r.model for r in got if r.best_model}) == 1 and all(0 <= r.score <= 1 for r in got),
        "informative_columns": lambda: len(got) == 3 and all(r.mi >= 0 for r in got),
        "random_search": lambda: len(got) == 3 and max(r.score for r in got) == next(r.score for r in got if r.best),
    }
    assert checks.get(name, lambda: True)()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_shared_tables_follow_their_sources(spark, tmp_path):
    from panelmill.plans.shared import shared

    source, made = str(tmp_path / "s.parquet"), []
    read = lambda: made.append(1) or spark.read.parquet(source).selectExpr("id * 2 as x")
    for n, again in ((3, 1), (3, 1), (5, 2)):
        if n != 3 or not made:
            spark.range(n).write.mode("overwrite").parquet(source)
        assert shared(spark, "x", [source], read).count() == n and len(made) == again

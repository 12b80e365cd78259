"""The queries against their SQL."""

import duckdb
import pytest

from panelmill.llm.oracles import ORACLES
from panelmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    out = QUERIES[name](spark, sf_dir)
    assert sorted(out.columns) == sorted(names)
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(cur.fetchall())

"""Every query that has SQL gives the SQL's rows, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import verify_oracles as v
from panelwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert v.rows(df.columns, df.collect()) == v.rows(cols, cur.fetchall())


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["mod_p2_shared_ridge_on_price", "mod_p3_ridge_on_price_by_item", "c7_control_kinds"])
def test_halves_are_rounded_as_in_sql(spark, name):
    # one mean here is 0.0646875
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    df = catalog.queries()[name](spark, "/root/testdata/sf0.01")
    cur = c.execute(catalog.oracle_sql()[name])
    assert v.rows(df.columns, df.collect()) == v.rows([x[0] for x in cur.description], cur.fetchall())

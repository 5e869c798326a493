import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r.demand_class for r in rows} <= {"Continuous", "Intermittent", "Lumpy"}


@pytest.mark.parametrize("name", ["cl3_demand_class", "tb5_monthly_territory_demand", "pr1_pareto_sku", "ft13_months_since_purchase", "os7_power_outlets"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, FOLDER).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    norm = lambda df: df[cols].apply(lambda c: c.astype(float) if c.dtype.kind in "iufb" else c)
    assert key(norm(got)) == key(norm(want))

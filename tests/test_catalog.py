import duckdb
import pytest

from veilstat.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    cols = sorted(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert want.equals(got.astype(want.dtypes.to_dict()))

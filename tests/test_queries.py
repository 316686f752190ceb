"""Every registered query runs; those with SQL equal DuckDB's rows."""

import duckdb
import numpy as np
import pytest

from loomgraph.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (float, np.floating)) else x.item() if isinstance(x, np.generic) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        rows = [sorted((tuple(plain(x) for x in r) for r in f[cols].itertuples(index=False)), key=repr) for f in (got, want)]
        assert rows[0] == rows[1]
